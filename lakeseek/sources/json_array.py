"""One large JSON document with an array of objects, read by many tasks.

The part from the array's first element on is cut into byte ranges, wherever they fall. A first pass says of each range, for
both answers to "does it begin inside a string?", how it changes the depth of brackets, how low that gets, and whether it ends
inside a string; one small row a range, from which each range's true state follows in order. In a second pass each task
reads the elements that begin in its range, the last one beyond its end. Bytes are read by position, so a
task holds a piece of its range and one element.

As for a document read as a whole, these raise: no such array at the top level, an array that isn't closed, an element that
isn't an object, and an element that isn't JSON. What follows the array isn't read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: What a scan looks at: a backslash with what it escapes, quotes, brackets.
_MARKS = re.compile(rb"\\.|[\"\[\]{}]", re.DOTALL)
_QUOTE, _OPEN, _CLOSE, _BACKSLASH = b'"', b"[{", b"]}", b"\\"
_STATES = "first long, last long, inside boolean, depth long"


def _opened(path: str) -> tuple[Any, int]:
    from pyarrow import fs

    plain = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    place, name = fs.FileSystem.from_uri(plain)
    return place.open_input_file(name), place.get_file_info(name).size


def _escaped(file: Any, at: int) -> bool:
    """Whether the byte at a place is escaped: an odd number of backslashes stands before it."""
    n = 0
    while n < at and file.read_at(1, at - n - 1) == _BACKSLASH:
        n += 1
    return n % 2 == 1


def _marks(file: Any, first: int, last: int, inside: bool, depth: int) -> Iterator[tuple[int, bytes, bool, int]]:
    """(place, mark, inside a string after it, depth after it) of each quote and of each bracket outside of strings."""
    at = first + int(first > 0 and _escaped(file, first))
    while at < last:
        data = file.read_at(min(READ_BYTES, last - at), at)
        if not data:
            return
        # No piece ends between a backslash and what it escapes.
        if (len(data) - len(data.rstrip(_BACKSLASH))) % 2 and at + len(data) < last:
            data += file.read_at(1, at + len(data))
        for m in _MARKS.finditer(data):
            mark = m[0]
            if mark == _QUOTE:
                inside = not inside
            elif inside or len(mark) > 1:
                continue
            else:
                depth += 1 if mark in _OPEN else -1
            yield at + m.start(), mark, inside, depth
        at += len(data)


def _summary(path: str, first: int, last: int) -> dict[str, int]:
    """How a range changes the state, by whether it begins inside a string (1) or not (0)."""
    file, _ = _opened(path)
    out = {}
    for begin in (0, 1):
        inside, depth, low = bool(begin), 0, 0
        for _, _, inside, depth in _marks(file, first, last, inside, depth):
            low = min(low, depth)
        out |= {f"inside{begin}": int(inside), f"depth{begin}": depth, f"low{begin}": low}
    return out


def _array_start(path: str, name: str) -> int:
    """The place behind the bracket of the top-level array of that name. Nothing behind it is read."""
    file, size = _opened(path)
    opened = closed = -1
    for place, mark, inside, depth in _marks(file, 0, size, False, 0):
        if mark == _QUOTE and depth == 1:
            opened, closed = (place, closed) if inside else (opened, place)
        elif mark == b"[" and depth == 2 and 0 <= opened < closed and closed - opened < 2 * READ_BYTES:
            between = file.read_at(place - closed - 1, closed + 1)
            if between.strip() == b":" and json.loads(file.read_at(closed - opened + 1, opened)) == name:
                return place + 1
    raise ValueError(f"no top-level array {name} in {path}")


def _elements(path: str, first: int, last: int, inside: bool, depth: int) -> Iterator[str]:
    """Elements that begin in a range of the array, which is at depth 2."""
    file, size = _opened(path)
    begun, edge = None, first if depth == 2 and not inside else None

    def gap(until: int) -> None:
        if file.read_at(until - edge, edge).strip(b" \t\r\n,"):
            raise ValueError("each element of the array must be an object")

    for place, mark, within, now in _marks(file, first, size, inside, depth):
        if begun is not None or edge is None:
            # In an element: of this range, or of one before.
            if now == 2 and mark in _CLOSE:
                if begun is not None:
                    text = file.read_at(place - begun + 1, begun).decode()
                    try:
                        json.loads(text)
                    except ValueError as problem:
                        raise ValueError(f"malformed JSON in {path}: {problem}") from problem
                    yield text
                begun, edge = None, place + 1
        elif now == 1:
            gap(place)
            return
        elif place >= last:
            return
        else:
            gap(place)
            if mark != b"{":
                raise ValueError("each element of the array must be an object")
            begun = place
    raise ValueError(f"the array in {path} is not closed")


def read_array(spark: SparkSession, path: str, name: str = "bids", schema: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects of a top-level array in one document, by many tasks: (value) as JSON text, or their fields if a schema is given."""
    start = _array_start(path, name)
    _, size = _opened(path)
    cuts = [*range(start, max(size, start + 1), range_bytes), max(size, start + 1)]
    ranges = spark.createDataFrame(list(zip(cuts, cuts[1:])), "first long, last long").repartition(len(cuts) - 1)  # noqa: B905
    kinds = ", ".join(f"{n}{i} long" for i in (0, 1) for n in ("inside", "depth", "low"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"first": a, "last": b} | _summary(path, a, b) for a, b in batch.itertuples(index=False)])

    # A row of eight numbers for each range: some 16,000 for a file of a terabyte.
    found = sorted(ranges.mapInPandas(summed, f"first long, last long, {kinds}").collect(), key=lambda r: r["first"])
    states, inside, depth = [], 0, 2
    for r in found:
        states.append((r["first"], r["last"], bool(inside), depth))
        if depth + r[f"low{inside}"] < 2:
            break  # the array ends here
        inside, depth = r[f"inside{inside}"], depth + r[f"depth{inside}"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, last, in_string, level in batch.itertuples(index=False):
                held, weight = [], 0
                for text in _elements(path, int(first), int(last), bool(in_string), int(level)):
                    held.append(text)
                    weight += len(text)
                    if weight > READ_BYTES:
                        yield pd.DataFrame({"value": held})
                        held, weight = [], 0
                if held:
                    yield pd.DataFrame({"value": held})

    rows = spark.createDataFrame(states, _STATES).repartition(len(states)).mapInPandas(read, "value string")
    return rows if schema is None else rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("bid")).select("bid.*")
