"""Vectorised text kernels that run inside Arrow batches.

Every kernel works on the byte buffer of a whole slice of texts at once, so the
per-word cost is a few NumPy passes and no Python object is made per word.

* A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; words never
  cross from one text into the next.
* Word and sequence hashes are polynomial prefix sums modulo 2**64 (the base is
  odd, so a span's value is recovered by one multiplication), finished with a
  64-bit avalanche.  Two seeds give independent 64-bit values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one NumPy pass works on; bounds the temporaries of a task.
SLICE_BYTES = 1 << 20

_BASE = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_table(seed: int, fold: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D) + U64(seed))
    if fold:
        table[65:91] = table[97:123]
    return table


_TABLES = {(seed, fold): _byte_table(seed * 7919 + 17, fold) for seed in (0, 1) for fold in (False, True)}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        inverse = U64(pow(int(_BASE[seed]), -1, 1 << 64))
        out = []
        for base in (_BASE[seed], inverse):
            run = np.full(size, base, U64)
            run[0] = 1
            out.append(np.cumprod(run, dtype=U64))
        have = _POWERS[seed] = (out[0], out[1])
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of values[starts[i]:ends[i]]; the order of values counts, and so does their number."""
    power, inverse = _powers(seed, len(values) + 1)
    prefix = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=prefix[1:], dtype=U64)
    raw = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


class Words:
    """The words of a slice of texts: byte bounds, and the range of words of each text."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0]
        inside = ~_SPACE[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = self.bounds[1:-1]
        cut = cut[(cut > 0) & (cut < len(self.data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: word range of each text
        self.docs = np.searchsorted(self.starts, self.bounds)

    def hashes(self, fold: bool, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; fold: A-Z count as a-z."""
        return span_hashes(_TABLES[seed, fold][self.data], self.starts, self.ends, seed)


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer single row is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The batch in slices of bounded bytes, each with its words."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(lengths):
        part = batch.slice(a, b - a)
        yield part, Words(part.column(column))


def gram_hashes(values: np.ndarray, docs: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive values inside one text, and the place of each; texts of fewer than k (but some) values give one for all of them."""
    n = np.diff(docs)
    starts = np.arange(len(values))
    owner = np.repeat(np.arange(len(n)), n)
    inside = starts + k <= docs[1:][owner] if len(values) else np.zeros(0, bool)
    keep = inside | ((starts == docs[:-1][owner]) & (n[owner] < k)) if len(values) else inside
    places = starts[keep]
    ends = np.minimum(places + k, docs[1:][owner[keep]]) if len(values) else places
    return span_hashes(values, places, ends, seed), places


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the smallest of values[i:i+width] by its top 40 bits, the leftmost of equals; of more than 2**24 values in overlapping chunks."""
    most = 1 << 24
    if len(values) > most:
        firsts = range(0, len(values) - width + 1, most - width + 1)
        return np.concatenate([sliding_argmin(values[s : s + most], width) + s for s in firsts])
    packed = (values & ~U64(0xFFFFFF)) | np.arange(len(values), dtype=U64)
    have, low = 1, packed
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: -(width - have)], low[width - have :])
    return (low & U64(0xFFFFFF)).astype(np.int64)
