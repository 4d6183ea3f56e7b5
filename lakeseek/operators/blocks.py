"""The best k by BM25 without scoring every match.

Chunks are dealt to blocks of about BLOCK chunks of like length. For each term and block a
small table has the largest counts in title and text and the least length: no chunk
of the block can score more than these allow.  A search scores the blocks that promise
most, takes the k-th score found there, and then scores only blocks that can still beat it.
Counts of documents come from the same table, so scores are those of the whole index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.operators.lexical import B, K1, LEAST_IDF, TEXT_WEIGHT, TITLE_WEIGHT, LexicalIndex, bm25

BLOCK, FIRST = 128, 8
#: Classes of length: CLASSES for each doubling. A class's blocks have numbers of their own, at most BLOCKS.
CLASSES, BLOCKS = 4, 1 << 24


def _class(length: Column) -> Column:
    return F.floor(F.log2(F.greatest(length, F.lit(1))) * CLASSES)


def _impact(f: Column, length: Column) -> Column:
    """What a phrase adds for each unit of idf; grows with f, falls with the length."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.col("avgdl")))


@dataclass(frozen=True)
class BlockedIndex:
    """postings with a block; maxima(term, block, n, title, text, length); stats as in LexicalIndex."""

    postings: DataFrame
    maxima: DataFrame
    stats: DataFrame

    @classmethod
    def save(cls, index: LexicalIndex, path: str, block: int = BLOCK) -> None:
        """From an index that isn't stored yet the blocks are made at once: its postings are written as they come, and sorted only here."""
        spark = index.postings.sparkSession
        if index.made is not None:
            index.made.write.mode("overwrite").parquet(f"{path}/made")
            index = LexicalIndex.of(spark.read.schema(index.made.schema).parquet(f"{path}/made"), index.version)
        lengths = index.lengths.groupBy(_class(F.col("length")).alias("c")).count().collect()  # a row for each class of length
        blocks = F.create_map(*[F.lit(x) for r in lengths for x in (r.c, min(BLOCKS, -(-r["count"] // block)))])
        at = _class(F.col("length"))
        placed = index.postings.withColumn("block", at * BLOCKS + F.pmod(F.xxhash64("chunk_id"), F.try_element_at(blocks, at)))
        placed.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        most = lambda c, name: F.max(F.size(c)).alias(name)
        maxima = stored.groupBy("term", "block").agg(F.count("*").alias("n"), most("title_at", "title"), most("text_at", "text"), F.min("length").alias("length"))
        maxima.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/maxima")
        index.stats.write.mode("overwrite").parquet(f"{path}/stats")
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/made")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockedIndex:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "maxima", "stats")])

    def _corpus(self) -> DataFrame:
        return self.stats.select(F.col("n").alias("n_all"), "avgdl")

    def _promises(self, times: dict[str, int], title_weight: float, text_weight: float) -> DataFrame:
        """(block, promise): the most that a chunk of each block with a term can score."""
        rows = self.maxima.where(F.col("term").isin(*times))
        df = rows.groupBy("term").agg(F.sum("n").alias("df"))
        weights = F.create_map(*[F.lit(x) for item in times.items() for x in item])
        joined = rows.join(F.broadcast(df), "term").crossJoin(F.broadcast(self._corpus()))  # a row a term of the query, and one row
        most = _idf() * _impact(title_weight * F.col("title") + text_weight * F.col("text"), F.col("length"))
        return joined.groupBy("block").agg(F.sum(most * F.element_at(weights, F.col("term"))).alias("promise"))

    def _scored(self, times: dict[str, int], blocks: DataFrame, title_weight: float, text_weight: float) -> DataFrame:
        """(chunk_id, score) of the chunks in blocks(block)."""
        df = self.maxima.where(F.col("term").isin(*times)).groupBy("term").agg(F.sum("n").alias("df"))
        weights = F.create_map(*[F.lit(x) for item in times.items() for x in item])
        rows = self.postings.where(F.col("term").isin(*times)).join(blocks, "block", "left_semi").join(F.broadcast(df), "term").crossJoin(F.broadcast(self._corpus()))
        part = _idf() * _impact(title_weight * F.size("title_at") + text_weight * F.size("text_at"), F.col("length")) * F.element_at(weights, F.col("term"))
        # In the order of the terms, so that equal chunks have equal scores.
        parts = F.sort_array(F.collect_list(F.struct("term", part.alias("part"))))
        return rows.groupBy("chunk_id").agg((-F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"])).alias("score"))

    def search(self, phrases: list[list[str]], k: int, title_weight: float = TITLE_WEIGHT, text_weight: float = TEXT_WEIGHT, first: int = FIRST) -> tuple[DataFrame, dict[str, int]]:
        """The k best (chunk_id, score) of bm25(), and how many blocks there were and how many were scored. Phrases of several tokens have no bound here; a query with one is scored as a whole."""
        if not phrases or any(len(p) != 1 for p in phrases):
            whole = LexicalIndex(self.postings.drop("block"), self.stats)
            return bm25(whole, phrases, title_weight, text_weight).orderBy("score", "chunk_id").limit(k), {"blocks": -1, "scored": -1}
        times: dict[str, int] = {}
        for (term,) in phrases:
            times[term] = times.get(term, 0) + 1
        promises = self._promises(times, title_weight, text_weight)
        some = promises.orderBy(F.col("promise").desc(), "block").limit(first)
        found = [r.score for r in self._scored(times, some.select("block"), title_weight, text_weight).orderBy("score", "chunk_id").limit(k).collect()]
        # A block whose promise is the k-th score itself may hold an equal one with a smaller id.
        worth = promises if len(found) < k else promises.where(F.col("promise") >= -found[-1] * (1 - 1e-12))
        out = self._scored(times, worth.select("block"), title_weight, text_weight).orderBy("score", "chunk_id").limit(k)
        return out, {"blocks": promises.count(), "scored": worth.count()}


def _idf() -> Column:
    rare = F.log((F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.when(rare <= 0, LEAST_IDF).otherwise(rare)
