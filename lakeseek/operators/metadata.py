"""Searches on the stored form of a collection: collections, segments, rows and their metadata in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.functions.text import is_bid_id, query_phrases
from lakeseek.operators.lexical import EXACT_SCORE, LexicalIndex, bm25
from lakeseek.operators.present import eav_maps

#: The key under which a row's document is kept, and the scope of metadata segments: fixed values.
DOCUMENT_KEY, SCOPE = "chroma:document", "METADATA"


def members(embeddings: DataFrame, segments: DataFrame, collections: DataFrame, name: str) -> DataFrame:
    """Rows of embeddings(id, segment_id, embedding_id) in the metadata segments of a collection. Segments and collections have a row a collection, and are broadcast by their size."""
    own = collections.where(F.col("name") == name).select(F.col("id").alias("_collection"))
    parts = segments.where(F.col("scope") == SCOPE).join(own, F.col("collection") == F.col("_collection")).select(F.col("id").alias("segment_id"))
    return embeddings.join(parts, "segment_id", "left_semi").select("id", "embedding_id")


def scan(embeddings: DataFrame, segments: DataFrame, collections: DataFrame, metadata: DataFrame, name: str) -> DataFrame:
    """(embedding_id, document, metadata map) of a collection: four tables joined, long rows pivoted to one map a row."""
    rows = members(embeddings, segments, collections, name).join(metadata, "id")
    document = rows.where(F.col("key") == DOCUMENT_KEY).groupBy("embedding_id").agg(F.max("string_value").alias("document"))
    maps = eav_maps(rows.where(F.col("key") != DOCUMENT_KEY), "embedding_id")
    return maps.join(document, "embedding_id", "full_outer").select("embedding_id", F.coalesce("document", F.lit("")).alias("document"), "metadata")


def search(
    index: LexicalIndex, embeddings: DataFrame, segments: DataFrame, collections: DataFrame, metadata: DataFrame, name: str, query: str, limit: int, condition: Column | None = None
) -> DataFrame:
    """(embedding_id, score, metadata) of the best rows of a collection: full-text hits (index by row id), joined with rows, segments and collection, and rows whose bid_id is the query, before all others.
    The best 25 x limit are filtered by a condition on ``metadata``, then cut to limit."""
    rows = members(embeddings, segments, collections, name)
    best = bm25(index, query_phrases(query), 1.0, 1.0).withColumnRenamed("chunk_id", "id").join(rows, "id")
    best = best.orderBy("score", "id").limit(max(25 * limit, 250))
    if is_bid_id(query):
        same = metadata.where((F.col("key") == "bid_id") & (F.lower("string_value") == query.strip().lower())).select("id").distinct()
        exact = rows.join(same, "id").select("id", F.lit(EXACT_SCORE).alias("score"), "embedding_id")
        best = best.unionByName(exact).groupBy("id", "embedding_id").agg(F.min("score").alias("score"))
    maps = eav_maps(metadata.where(F.col("key") != DOCUMENT_KEY).join(best.select("id"), "id", "left_semi"))
    found = best.join(maps, "id", "left")
    if condition is not None:
        found = found.where(condition)
    return found.orderBy("score", "id").limit(limit).select("embedding_id", "score", "metadata")


def encode(metadata: Column) -> Column:
    """A metadata map as JSON text with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metadata))))


def decode(text: Column) -> Column:
    """JSON text as a metadata map of texts; what isn't an object is null."""
    return F.from_json(text, "map<string, string>")
