"""Fusing dense and lexical result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.operators.dense import confidence
from lakeseek.operators.lexical import STRONG

RRF_K, GATE = 60, 0.55


def _weighed(rank: str, weight: float, k: int, factor: Column | float = 1.0) -> Column:
    return F.coalesce(F.lit(weight) * factor / (k + F.col(rank)), F.lit(0.0))


def rrf(dense: DataFrame, lexical: DataFrame, k: int = RRF_K, dense_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """(chunk_id, score, dense_rank, lexical_rank) of dense(chunk_id, dense_rank) and lexical(chunk_id, lexical_rank): reciprocal ranks summed."""
    both = dense.select("chunk_id", "dense_rank").join(lexical.select("chunk_id", "lexical_rank"), "chunk_id", "full_outer")
    return both.select("chunk_id", (_weighed("dense_rank", dense_weight, k) + _weighed("lexical_rank", lexical_weight, k)).alias("score"), "dense_rank", "lexical_rank")


def confident(dense: DataFrame, lexical: DataFrame, k: int = RRF_K, dense_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """Fusion weighed by confidence, of dense(chunk_id, distance, dense_rank) and lexical(chunk_id, score, quality).

    Lexical rows under STRONG are dropped and the others ranked anew; dense rows
    without confidence are dropped but ranks keep their gaps.  Without a strong
    lexical row or a dense one of confidence GATE there is no answer at all.
    """
    d = dense.select("chunk_id", "dense_rank", confidence(F.col("distance")).alias("confidence"))
    strong = lexical.where(F.col("quality") >= STRONG)
    rank = F.row_number().over(Window.orderBy("score", "chunk_id")).cast("long")
    strong = strong.select("chunk_id", "quality", rank.alias("lexical_rank"))
    answered = d.where(F.col("confidence") >= GATE).select("chunk_id").unionByName(strong.select("chunk_id")).agg((F.count("*") > 0).alias("answered"))
    both = d.where("confidence > 0").join(strong, "chunk_id", "full_outer").crossJoin(F.broadcast(answered)).where("answered")
    score = _weighed("dense_rank", dense_weight, k, F.col("confidence")) + _weighed("lexical_rank", lexical_weight, k, 0.5 + 3.5 * F.col("quality"))
    return both.select("chunk_id", score.alias("score"), "dense_rank", "lexical_rank")


def confident_many(dense: DataFrame, lexical: DataFrame, k: int = RRF_K, dense_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """confident() for each query_id of dense(query_id, chunk_id, distance, dense_rank) and lexical(query_id, chunk_id, score, quality): a query without evidence has no rows."""
    d = dense.select("query_id", "chunk_id", "dense_rank", confidence(F.col("distance")).alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "chunk_id")).cast("long")
    strong = lexical.where(F.col("quality") >= STRONG).select("query_id", "chunk_id", "quality", rank.alias("lexical_rank"))
    both = d.where("confidence > 0").join(strong, ["query_id", "chunk_id"], "full_outer")
    evidence = (F.col("confidence") >= GATE) | F.col("quality").isNotNull()
    both = both.withColumn("_answered", F.max(F.coalesce(evidence, F.lit(False))).over(Window.partitionBy("query_id"))).where("_answered")
    score = _weighed("dense_rank", dense_weight, k, F.col("confidence")) + _weighed("lexical_rank", lexical_weight, k, 0.5 + 3.5 * F.col("quality"))
    return both.select("query_id", "chunk_id", score.alias("score"), "dense_rank", "lexical_rank")


def ordered_many(fused: DataFrame, limit: int) -> DataFrame:
    """The best of each query's fused list, with their place."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def ordered(fused: DataFrame, limit: int) -> DataFrame:
    """The best of a fused list; ties go by dense rank, then lexical rank, then id."""
    return fused.orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "chunk_id").limit(limit)
