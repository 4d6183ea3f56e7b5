"""Hybrid search: one lazy plan; the driver only parses the query text and the filter."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.functions.text import query_terms
from lakeseek.operators import dense, fusion, lexical, lexical_batch
from lakeseek.operators.lexical import LexicalIndex
from lakeseek.operators.present import date_range
from lakeseek.operators.where import where

#: What a passage-search model wants in front of a query: fixed value.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class Embedder(Protocol):
    """Turns texts into unit vectors; a model behind it is loaded once a process."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def search(
    chunks: DataFrame,
    index: LexicalIndex,
    query: str,
    *,
    vectors: DataFrame | None = None,
    query_embedding: list[float] | None = None,
    embedder: Embedder | None = None,
    limit: int = 10,
    condition: Mapping[str, Any] | None = None,
    dense_candidates: int | None = None,
    lexical_candidates: int | None = None,
    exclude_boilerplate: bool = True,
    rrf_k: int = fusion.RRF_K,
    dense_weight: float = 1.0,
    lexical_weight: float = 1.0,
    id_column: str | None = None,
    metric: str = "l2sq",
    mode: str = "post",
) -> DataFrame:
    """(chunk_id, score, dense_rank, lexical_rank) of the best chunks, best first. A blank query has none. vectors(chunk_id, embedding) may be columns of their own table."""
    if not query.strip():
        return chunks.select("chunk_id", F.lit(0.0).alias("score"), F.lit(None).cast("long").alias("dense_rank"), F.lit(None).cast("long").alias("lexical_rank")).limit(0)
    if query_embedding is None:
        if embedder is None:
            raise ValueError("a query needs an embedding or an embedder")
        query_embedding = embedder([QUERY_PREFIX + query])[0]
    test, candidates = where(condition), max(4 * limit, 40)
    real = ~F.coalesce(F.col("is_boilerplate"), F.lit(False)) if exclude_boilerplate and "is_boilerplate" in chunks.columns else F.lit(True)
    rows = chunks if vectors is None else vectors.select("chunk_id", "embedding").join(chunks.drop("title", "text", "embedding"), "chunk_id")
    near = dense.knn(rows, query_embedding, dense_candidates or candidates, test, metric).where(real)
    hits = lexical.search(index, chunks, query, lexical_candidates or candidates, test, id_column, mode).where(real)
    weighed = lexical.match_quality(hits, query, lexical.term_weights(index, query_terms(query)), id_column)
    return fusion.ordered(fusion.confident(near, weighed, rrf_k, dense_weight, lexical_weight), limit)


def search_many(
    chunks: DataFrame,
    index: LexicalIndex,
    queries: DataFrame,
    *,
    vectors: DataFrame | None = None,
    limit: int = 10,
    condition: Mapping[str, Any] | None = None,
    candidates: int | None = None,
    exclude_boilerplate: bool = True,
    rrf_k: int = fusion.RRF_K,
    dense_weight: float = 1.0,
    lexical_weight: float = 1.0,
    id_column: str | None = None,
    metric: str = "l2sq",
) -> DataFrame:
    """search() for each of queries(query_id, query, embedding): (query_id, rank, chunk_id, score, dense_rank, lexical_rank). Queries with a null embedding are lexical only, blank ones have no answer. Of the queries, vectors by blocks, phrases (up to lexical_batch.PHRASES) and hits (up to lexical_batch.HITS) pass through the driver, as broadcasts do; larger tables' phrases and hits are joined where they are."""
    test, n = where(condition), candidates or max(4 * limit, 40)
    asked = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    real = ~F.coalesce(F.col("is_boilerplate"), F.lit(False)) if exclude_boilerplate and "is_boilerplate" in chunks.columns else F.lit(True)
    usable = chunks.where(test) if condition else chunks
    # The filter comes before the nearest are taken, boilerplate goes after, as for one query.
    rows = usable if vectors is None else vectors.select("chunk_id", "embedding").join(usable.select("chunk_id"), "chunk_id")
    near = dense.knn_batch(rows, asked.where("embedding is not null").select("query_id", F.col("embedding").alias("query")), n, metric)
    near = near.join(chunks.where(real).select("chunk_id"), "chunk_id", "left_semi")
    hits = lexical_batch.search(index, chunks, asked, n, test if condition else None, id_column).where(real)
    weighed = lexical_batch.match_quality(hits, asked, lexical_batch.term_weights(index, asked), id_column)
    found = fusion.confident_many(near, weighed, rrf_k, dense_weight, lexical_weight)
    return fusion.ordered_many(found, limit).select("query_id", "rank", "chunk_id", "score", "dense_rank", "lexical_rank")


def search_between(chunks: DataFrame, index: LexicalIndex, query: str, start: Column, end: Column, first: Column | None = None, last: Column | None = None, limit: int = 10, **options: Any) -> DataFrame:
    """search() for bids within dates: four times the limit is fetched if a date is given, filtered by start and end (columns of chunks), then cut."""
    dated = first is not None or last is not None
    found = search(chunks, index, query, limit=4 * limit if dated else limit, **options)
    rows = found.join(chunks.select("chunk_id", start.alias("_start"), end.alias("_end")), "chunk_id")
    return fusion.ordered(date_range(rows, F.col("_start"), F.col("_end"), first, last).drop("_start", "_end"), limit)
