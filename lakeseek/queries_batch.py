"""Queries for tables of queries, the vector index, blocks of postings, and updates of stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek import fixtures
from lakeseek.functions.text import query_phrases
from lakeseek.operators import changes, extract, lexical_batch
from lakeseek.operators.blocks import BlockedIndex
from lakeseek.operators.vector_index import VectorIndex
from lakeseek.operators.where import where
from lakeseek.plans import hybrid
from lakeseek.queries_search import QUERY, _built, _index, _rounded
from lakeseek.sources import json_array, sinks
from lakeseek.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _asked(spark, sf_dir) -> DataFrame:
    """Every benchmark item as a query, with the vector of its number."""
    vectors = fixtures.vectors(spark, sf_dir).select(F.col("chunk_id").alias("item_id"), "embedding")
    items = fixtures.table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding")


@query
def lexical_search_many(spark, sf_dir):
    """SC-10 / WN-01 for a table of queries: the best ten chunks of each benchmark item."""
    chunks, index = _index(spark, sf_dir)
    found = lexical_batch.search(index, chunks, _asked(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", "score")


@query
def match_quality_many(spark, sf_dir):
    """SC-05 for a table of queries: every benchmark item with its best forty chunks."""
    chunks, index = _index(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    hits = lexical_batch.with_texts(lexical_batch.top(index, asked, 40), chunks, asked, 40)
    return _rounded(lexical_batch.match_quality(hits, asked, lexical_batch.term_weights(index, asked)).select("query_id", "chunk_id", "quality"), "quality")


@query
def hybrid_search_many(spark, sf_dir):
    """SC-09 for a table of queries."""
    chunks, index = _index(spark, sf_dir)
    found = hybrid.search_many(chunks, index, _asked(spark, sf_dir), vectors=fixtures.vectors(spark, sf_dir), limit=10)
    return _rounded(found, "score")


@query
def hybrid_search_many_filtered(spark, sf_dir):
    """SC-09 for a table of queries, with a metadata filter and boilerplate kept."""
    chunks, index = _index(spark, sf_dir)
    condition = {"$and": [{"lang": {"$in": ["en", "de"]}}, {"n_chars": {"$gte": 500}}]}
    found = hybrid.search_many(chunks, index, _asked(spark, sf_dir), vectors=fixtures.vectors(spark, sf_dir), limit=5, condition=condition, exclude_boilerplate=False)
    return _rounded(found, "score")


def _vector_index(spark, sf_dir, metric: str = "l2sq") -> VectorIndex:
    """The index of all vectors: built and stored once."""
    path = fixtures.stored(spark, sf_dir, f"vector-index-{metric}", lambda p: VectorIndex.save(fixtures.vectors(spark, sf_dir), p, metric=metric))
    return VectorIndex.load(spark, path)


@query
def knn_indexed(spark, sf_dir):
    """SC-12 from the stored index, exact."""
    rows = _vector_index(spark, sf_dir).search(fixtures.query_vector(spark, sf_dir), 40)
    return rows.select("chunk_id", F.round("distance", 6).alias("distance"), "dense_rank")


@query
def knn_indexed_filtered(spark, sf_dir):
    """SL-01 from the stored index: the filter comes before the ranking, cosine."""
    rows = _vector_index(spark, sf_dir, "cosine").search(fixtures.query_vector(spark, sf_dir), 20, where({"label": {"$in": [1, 2]}}))
    return rows.select("chunk_id", F.round("distance", 6).alias("distance"), "dense_rank")


@query
def knn_indexed_many(spark, sf_dir):
    """JN-18 from the stored index for many queries: every vector whose id is divisible by 50, against all."""
    queries = fixtures.vectors(spark, sf_dir).where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = _vector_index(spark, sf_dir).search_many(queries, 5)
    return rows.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "dense_rank")


@query
def bm25_blocks(spark, sf_dir):
    """SL-02 by blocks of postings: those that can't reach the k-th score aren't scored."""
    path = fixtures.stored(spark, sf_dir, "blocked-index", lambda p: BlockedIndex.save(_built(spark, sf_dir), p))
    found, _ = BlockedIndex.load(spark, path).search(query_phrases(QUERY), 40)
    return _rounded(found, "score")


@query
def file_changes(spark, sf_dir):
    """INC-01 / JN-09: pages as files, against a snapshot that lacks some, has some of another length or time, and some that are gone."""
    k, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    time = lambda shift: (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(k % 28).cast("int") + shift)).alias("modified")
    pages = fixtures.table(spark, sf_dir, "pages")
    path = F.format_string("pages/%d.pdf", k).alias("path")
    other = (k % 10).isin(1, 3)
    known = pages.where(k % 10 != 2).select(path, F.md5(F.when(other, F.concat(html, F.lit("old"))).otherwise(html)).alias("document_hash"), (F.octet_length(html) + F.when(k % 10 == 1, 3).otherwise(0)).cast("long").alias("length"), time(F.when((k % 10).isin(3, 5), 1).otherwise(0)))
    listed = pages.where(k % 10 != 4).select(path, F.octet_length(html).cast("long").alias("length"), time(F.lit(0)))
    suspects = changes.file_changes(known, listed).where("change = 'suspect'").select("path")
    hashes = pages.select(path, F.md5(html).alias("document_hash")).join(suspects, "path")
    return changes.file_changes(known, listed, hashes)


@query
def last_document_of_a_bid(spark, sf_dir):
    """AG-13 / FX-12: every third bid has a second file, with a later path and another first term; its clauses are those of that file alone."""
    docs = fixtures.bid_documents(spark, sf_dir).select("path", "text", "o_orderkey")
    more = docs.where(F.col("o_orderkey") % 3 == 0).select(F.concat(F.lit("bids/2025"), F.substring("path", 10, 1000)).alias("path"), F.replace("text", F.lit("First term"), F.lit("Other term")).alias("text"), "o_orderkey")
    last = extract.last_documents(extract.metadata(docs.unionByName(more), "", F.lit("2024-01-01")))
    return extract.chunks(last).where("chunk_type = 'atc_clause'").select("chunk_id", "text", F.col("pdf_path").like("bids/2025%").alias("second"))


@query
def legacy_array(spark, sf_dir):
    """SRC-09: all orders as one JSON document with an array, read back by byte ranges of a mebibyte."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    rows = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bid_id"), F.concat(F.lit('{"[\\'), F.col("o_orderpriority")).alias("title"), day)
    path = fixtures.stored(spark, sf_dir, "legacy-array", lambda p: sinks.write_array(rows, p, "bids", "bid_id"))
    return json_array.read_array(spark, path, schema="bid_id long, title string, day string", range_bytes=1 << 20)


@query
def arrivals_by_window(spark, sf_dir):
    """INC-02: arrivals in windows of event time; on a table nothing is late."""
    events = fixtures.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.newness(events, "ts", "1 hour", "10 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")
