"""Queries for retrieval: index, vectors, fusion, filters, hybrid search; documents are the chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeseek import fixtures
from lakeseek.functions.text import query_phrases, query_terms
from lakeseek.operators import dense, fusion, lexical
from lakeseek.operators.lexical import LexicalIndex
from lakeseek.operators.where import where
from lakeseek.plans import hybrid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Frequent words of the generated texts: the fixed query.
QUERY = "thatin thing orantion"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _built(spark, sf_dir) -> LexicalIndex:
    """The index of the chunks, not stored."""
    chunks, cores = fixtures.indexed_texts(spark, sf_dir), spark.sparkContext.defaultParallelism
    # A table of few row groups is dealt out, or few tasks would read all texts; others are read as they lie.
    tasks = fixtures.table(spark, sf_dir, "documents").select(F.spark_partition_id().alias("task")).distinct().count()
    return LexicalIndex.build(chunks.repartition(2 * cores, "chunk_id") if tasks < cores else chunks, "fixture")


def _index(spark, sf_dir) -> tuple[DataFrame, LexicalIndex]:
    """The chunks and their index: built and saved once, then read by term."""
    path = fixtures.stored(spark, sf_dir, "lexical-index", lambda p: _built(spark, sf_dir).save(p))
    return fixtures.chunk_table(spark, sf_dir), LexicalIndex.load(spark, path)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query
def hybrid_search(spark, sf_dir):
    """SC-09, the flagship: text and vector of document 0, best ten."""
    chunks, index = _index(spark, sf_dir)
    vectors = fixtures.vectors(spark, sf_dir)
    found = hybrid.search(chunks, index, QUERY, vectors=vectors, query_embedding=fixtures.query_vector(spark, sf_dir), limit=10)
    return _rounded(found, "score")


@query
def hybrid_search_filtered(spark, sf_dir):
    """SC-09 with a metadata filter and boilerplate kept."""
    chunks, index = _index(spark, sf_dir)
    condition = {"$and": [{"lang": {"$in": ["en", "de"]}}, {"n_chars": {"$gte": 500}}]}
    found = hybrid.search(chunks, index, QUERY, vectors=fixtures.vectors(spark, sf_dir), query_embedding=fixtures.query_vector(spark, sf_dir), condition=condition, exclude_boilerplate=False)
    return _rounded(found, "score")


def _bm25(spark, sf_dir, text: str):
    chunks, index = _index(spark, sf_dir)
    return _rounded(lexical.bm25(index, query_phrases(text)), "score").orderBy("score", "chunk_id").limit(40)


@query
def bm25_topk(spark, sf_dir):
    """SC-02 without the title's weight."""
    chunks, index = _index(spark, sf_dir)
    return _rounded(lexical.bm25(index, query_phrases(QUERY), 1.0, 1.0), "score").orderBy("score", "chunk_id").limit(40)


@query
def bm25_weighted_title_text(spark, sf_dir):
    return _bm25(spark, sf_dir, QUERY)


@query
def bm25_repeated_term(spark, sf_dir):
    return _bm25(spark, sf_dir, "thing thing thatin")


@query
def bm25_phrase(spark, sf_dir):
    """SC-01: a hyphenated word is a phrase."""
    return _bm25(spark, sf_dir, "of-the thing")


@query
def lexical_search(spark, sf_dir):
    """SC-10 / SL-03: filter after the over-fetched best."""
    chunks, index = _index(spark, sf_dir)
    rows = lexical.search(index, chunks, QUERY, 20, where({"lang": "en"}))
    return _rounded(rows.select("chunk_id", "score"), "score")


@query
def overfetch_post_filter(spark, sf_dir):
    chunks, index = _index(spark, sf_dir)
    return lexical.search(index, chunks, QUERY, 10, where({"source": "src3"})).select("chunk_id")


@query
def overfetch_prefilter(spark, sf_dir):
    chunks, index = _index(spark, sf_dir)
    return lexical.search(index, chunks, QUERY, 10, where({"source": "src3"}), mode="pre").select("chunk_id")


@query
def term_document_frequency(spark, sf_dir):
    return _index(spark, sf_dir)[1].document_frequency()


@query
def term_idf(spark, sf_dir):
    chunks, index = _index(spark, sf_dir)
    rows = index.document_frequency().crossJoin(F.broadcast(index.stats))
    return rows.select("term", F.round(lexical.idf(F.col("n"), F.col("df")), 9).alias("idf"))


@query
def corpus_stats(spark, sf_dir):
    return _rounded(_index(spark, sf_dir)[1].stats, "avgdl")


@query
def lexical_match_quality(spark, sf_dir):
    """SC-05 over every chunk."""
    chunks, index = _index(spark, sf_dir)
    rows = lexical.match_quality(chunks, QUERY, lexical.term_weights(index, query_terms(QUERY)))
    return _rounded(rows.select("chunk_id", "quality"), "quality")


@query
def knn_topk(spark, sf_dir):
    rows = dense.knn(fixtures.vectors(spark, sf_dir), fixtures.query_vector(spark, sf_dir), 40)
    return rows.select("chunk_id", F.round("distance", 6).alias("distance"), "dense_rank")


@query
def knn_filtered(spark, sf_dir):
    """SL-01: the filter comes before the ranking."""
    rows = dense.knn(fixtures.vectors(spark, sf_dir), fixtures.query_vector(spark, sf_dir), 20, where({"label": {"$in": [1, 2]}}), "cosine")
    return rows.select("chunk_id", F.round("distance", 6).alias("distance"), "dense_rank")


@query
def knn_batch(spark, sf_dir):
    """Many queries at once: every vector whose id is divisible by 50, against all."""
    vectors = fixtures.vectors(spark, sf_dir)
    queries = vectors.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    return dense.knn_batch(vectors, queries, 5).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "dense_rank")


@query
def dense_confidence_bands(spark, sf_dir):
    rows = fixtures.vectors(spark, sf_dir).withColumn("distance", dense.distance(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, fixtures.query_vector(spark, sf_dir)))))
    return rows.groupBy(dense.confidence(F.col("distance")).alias("confidence")).agg(F.count("*").alias("n"))


def _lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    chunks, index = _index(spark, sf_dir)
    near = dense.knn(fixtures.vectors(spark, sf_dir), fixtures.query_vector(spark, sf_dir), 40)
    hits = lexical.search(index, chunks, QUERY, 40)
    return near, lexical.match_quality(hits, QUERY, lexical.term_weights(index, query_terms(QUERY)))


@query
def rrf_fusion(spark, sf_dir):
    near, hits = _lists(spark, sf_dir)
    rank = F.row_number().over(Window.orderBy("score", "chunk_id")).cast("long")
    return _rounded(fusion.rrf(near, hits.withColumn("lexical_rank", rank)), "score")


@query
def confidence_fusion(spark, sf_dir):
    return _rounded(fusion.confident(*_lists(spark, sf_dir)), "score")


@query
def answerability_gate(spark, sf_dir):
    """FLT-08: no lexical evidence and no near vector, no answer."""
    near, hits = _lists(spark, sf_dir)
    far = near.where(dense.confidence(F.col("distance")) < fusion.GATE)
    return fusion.confident(far, hits.where(F.lit(False))).agg(F.count("*").alias("answers"))


@query
def match_badge(spark, sf_dir):
    from lakeseek.operators.present import match_badge as badge

    fused = fusion.confident(*_lists(spark, sf_dir))
    return fused.select("chunk_id", badge(F.col("dense_rank"), F.col("lexical_rank")).alias("badge"))


@query
def where_and_or(spark, sf_dir):
    """FLT-01: $and hides its sibling."""
    condition = {"lang": "xx", "$and": [{"$or": [{"lang": "de"}, {"source": {"$eq": "src1"}}]}, {"n_chars": {"$lt": 3000}}]}
    return fixtures.chunk_table(spark, sf_dir).where(where(condition)).select("chunk_id")


@query
def where_comparisons(spark, sf_dir):
    condition = {"n_chars": {"$gte": 700, "$lt": 2500}, "lang": {"$nin": ["fr"]}, "source": {"$ne": "src2"}}
    return fixtures.chunk_table(spark, sf_dir).where(where(condition)).select("chunk_id")


@query
def where_nulls(spark, sf_dir):
    """$ne and $nin pass on a missing value; comparisons fail on it."""
    chunks = fixtures.chunk_table(spark, sf_dir)
    tests = {"ne": {"is_boilerplate": {"$ne": True}}, "nin": {"is_boilerplate": {"$nin": [True]}}, "nin_null": {"is_boilerplate": {"$nin": [True, None]}}, "gt": {"is_boilerplate": {"$gte": False}}, "eq_null": {"is_boilerplate": None}}
    return chunks.select("chunk_id", *[where(c).alias(n) for n, c in tests.items()])


@query
def boilerplate_exclusion(spark, sf_dir):
    return fixtures.chunk_table(spark, sf_dir).where(~F.coalesce("is_boilerplate", F.lit(False))).select("chunk_id")
