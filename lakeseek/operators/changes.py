"""Change tracking between snapshots: classification, deltas, merging, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify(previous: DataFrame, current: DataFrame, key: str, hash_column: str) -> DataFrame:
    """(key, change): new, changed, unchanged or removed, by content hash; a current row without a hash (unreadable source) keeps what was there: failed."""
    a = previous.select(F.col(key), F.col(hash_column).alias("_old"), F.lit(True).alias("_had"))
    b = current.select(F.col(key), F.col(hash_column).alias("_new"), F.lit(True).alias("_has"))
    change = (
        F.when(F.col("_has").isNull(), "removed")
        .when(F.col("_new").isNull(), "failed")
        .when(F.col("_had").isNull(), "new")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def file_changes(known: DataFrame, listed: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(path, change) of known(path, document_hash, length, modified) against listed(path, length, modified): new, unchanged, removed, or changed.

    A known file of other length or time is ``suspect`` until hashes(path, document_hash) says whether its bytes changed, so contents
    are needed for suspects only, and a file that was merely touched is unchanged.
    """
    a = known.select("path", F.col("document_hash").alias("_old"), F.col("length").alias("_length"), F.col("modified").alias("_modified"), F.lit(True).alias("_had"))
    b = listed.select("path", "length", "modified", F.lit(True).alias("_has"))
    both = a.join(b, "path", "full_outer")
    both = both.withColumn("_new", F.lit(None).cast("string")) if hashes is None else both.join(hashes.select("path", F.col("document_hash").alias("_new")), "path", "left")
    same = F.col("_length").eqNullSafe(F.col("length")) & F.col("_modified").eqNullSafe(F.col("modified")) & F.col("_new").isNull()
    change = (
        F.when(F.col("_has").isNull(), "removed")
        .when(F.col("_had").isNull(), "new")
        .when(same | F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .when(F.col("_new").isNull(), "suspect")
        .otherwise("changed")
    )
    return both.select("path", change.alias("change"))


def sync_delta(previous: DataFrame, current: DataFrame, key: str, hash_column: str) -> DataFrame:
    """(key, op): upsert or delete, each key once, from whole snapshots, so that nothing an old path left behind stays."""
    changes = classify(previous, current, key, hash_column)
    op = F.when(F.col("change").isin("new", "changed"), "upsert").when(F.col("change") == "removed", "delete")
    return changes.select(key, op.alias("op")).where("op is not null")


def merge(snapshot: DataFrame, delta: DataFrame, upserts: DataFrame, key: str) -> DataFrame:
    """The snapshot after a delta: rows it names are gone, upserts among them are in; deletes come first."""
    kept = snapshot.join(delta.select(key), key, "left_anti")
    return kept.unionByName(upserts.join(delta.where("op = 'upsert'").select(key), key, "left_semi").select(*snapshot.columns))


def removed(previous: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """Rows of previous whose keys current lacks: removed bids, stale chunks, candidates not downloaded yet."""
    return previous.join(current.select(*keys).distinct(), list(keys), "left_anti")


def last_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key, the last in an explicit order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() for c in order]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with an id and a text that isn't blank."""
    return chunks.where((F.coalesce(F.col("chunk_id"), F.lit("")) != "") & F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S"))


def with_parent_metadata(chunks: DataFrame, bids: DataFrame, key: str = "bid_id") -> DataFrame:
    """A chunk's own metadata, else its bid's."""
    return chunks.join(bids.select(key, F.col("metadata").alias("_parent")), key, "left").withColumn("metadata", F.coalesce("metadata", "_parent")).drop("_parent")


def expiry_split(bids: DataFrame, active: DataFrame, key: str, forced: bool = False) -> DataFrame:
    """bids with expired: not in the live listing. An empty listing expires nothing unless forced: it is more likely a failed scan."""
    live = active.select(key).distinct().withColumn("_live", F.lit(True))
    some = live.agg((F.count("*") > 0).alias("_some"))
    joined = bids.join(live, key, "left").crossJoin(F.broadcast(some))
    return joined.withColumn("expired", F.col("_live").isNull() & (F.col("_some") | F.lit(forced))).drop("_live", "_some")


def expiry_report(split: DataFrame, chunks_column: str) -> DataFrame:
    """One row of counts from expiry_split(); chunks_column: number of chunks of a bid."""
    return split.agg(
        F.count_if(~F.col("expired")).alias("active_bid_count"),
        F.count_if("expired").alias("expired_bid_count"),
        F.coalesce(F.sum(F.when(F.col("expired"), F.col(chunks_column))), F.lit(0)).alias("expired_chunk_count"),
    )


def vector_metadata(rows: DataFrame, columns: list[str]) -> Column:
    """Metadata of a vector as a map of texts without nulls; what isn't scalar is JSON, a chunk_type that is missing is unknown."""
    scalar = ("string", "int", "bigint", "double", "float", "boolean")
    kinds = dict(rows.dtypes)
    value = lambda c: F.col(c).cast("string") if kinds[c] in scalar else F.to_json(c)
    made = F.create_map(*[x for c in columns for x in (F.lit(c), F.coalesce(value(c), F.lit("unknown")) if c == "chunk_type" else value(c))])
    return F.map_filter(made, lambda _, v: v.isNotNull())
