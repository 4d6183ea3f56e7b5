"""Shared helpers: tables written to the shared folder, and text expressions."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word, and that line keys are stripped of: fixed values.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The most rows of a key table that may be broadcast; at 16 to 40 bytes a row this is under 16 MB.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than one in HOT_KEYS of all rows, and more than LEAST_HOT; so there are at most HOT_KEYS hot keys.
HOT_KEYS, LEAST_HOT = 10_000, 1000
#: Bytes of a batch handed to Python. Spark's default is 64 MB, of which each task's buffers in the JVM and in Python hold several.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()
_scratch: list[list[DataFrame]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-lakeseek-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/lakeseek/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again: the lineage ends, and a lost executor costs no earlier stage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stashed inside are deleted at the end, but for those made with the function given, the results."""
    results: list[DataFrame] = []
    _scratch.append([])

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stash(df, name)
        results.append(_scratch[-1].pop())
        return out

    try:
        yield keep
    finally:
        discard(*_scratch.pop())
        if _scratch:
            _scratch[-1].extend(results)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that are run inside hand Python batches of at most about BATCH_BYTES; afterwards the session is as it was. Results don't depend on it."""
    before = spark.conf.get(BATCH_CONF, None)
    own = int(re.match(r"-?\d+", before)[0]) if before and re.fullmatch(r"-?\d+b?", before) else 0
    if not 0 < own <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_CONF)
        else:
            spark.conf.set(BATCH_CONF, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by stash() that nothing still to be run reads."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/lakeseek/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where the cluster doesn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="spark-lakeseek-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if its counted rows are within the bound; else it takes part in shuffled joins."""
    return F.broadcast(df) if rows <= bound else df


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has a key once, by one key column that may be very unevenly filled.

    Keys with over 1 / HOT_KEYS of the rows of left (of ``counted``, if that is given instead) are at most HOT_KEYS: their
    rows of right are broadcast, and rows of left don't move for them. Only the others are shuffled. how: inner, left,
    left_semi. Null keys match nothing.
    """
    counted = left if counted is None else counted
    counts = counted.where(F.col(on).isNotNull()).groupBy(on).count().where(F.col("count") > LEAST_HOT)
    least = counted.count() / HOT_KEYS
    hot = stash(counts.where(F.col("count") > least).select(on), "hot-keys")
    if hot.isEmpty():
        return left.join(right, on, how)
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    often = marked.where("_hot").drop("_hot").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, how)
    return often.unionByName(marked.where("_hot is null").drop("_hot").join(right.join(F.broadcast(hot), on, "left_anti"), on, how))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() has a fast path for texts of one-byte characters, for which it means the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def word_count(text: Column) -> Column:
    """Words in a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
