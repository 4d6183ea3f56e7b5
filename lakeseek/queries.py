"""One query for each operator, on the test tables or on fixtures made from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek import fixtures
from lakeseek.functions import dates, fields, text
from lakeseek.operators import extract

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.bid_documents(spark, sf_dir).withColumn("lines", fields.joined(text.lines(F.col("text"))))


def x() -> Column:
    """The column of lines; a function, as columns can't be made before there is a session."""
    return F.col("lines")


@query
def extract_bid_fields(spark, sf_dir):
    """PRJ-08: the metadata record; fixed run time."""
    meta = extract.metadata(fixtures.bid_documents(spark, sf_dir), "https://portal.example", F.lit("2024-01-01T00:00:00Z"))
    return meta.drop("text", "lines", "document_hash", "emd_amount").withColumn("delivery_period", F.coalesce("delivery_period", F.lit("-")))


@query
def extract_quantity(spark, sf_dir):
    return _bids(spark, sf_dir).select("o_orderkey", fields.quantity(x()).alias("quantity"))


@query
def extract_datetime(spark, sf_dir):
    return _bids(spark, sf_dir).select("o_orderkey", fields.date_time(x(), fields.BID_START).alias("bid_start"), fields.date_time(x(), fields.BID_END).alias("bid_end"))


@query
def extract_turnover(spark, sf_dir):
    both = _bids(spark, sf_dir).select("o_orderkey", fields.turnover(x(), fields.TURNOVER).alias("a"), fields.turnover(x(), fields.OEM_TURNOVER).alias("b"))
    return both.select("o_orderkey", F.col("a.value").alias("turnover"), F.col("a.unit").alias("unit"), F.col("b.value").alias("oem_turnover"), F.col("b.unit").alias("oem_unit"))


@query
def extract_experience(spark, sf_dir):
    return _bids(spark, sf_dir).select("o_orderkey", fields.experience_years(x()).alias("years"), fields.past_performance(x()).alias("past_performance"))


@query
def extract_emd(spark, sf_dir):
    return _bids(spark, sf_dir).select("o_orderkey", fields.emd(x()).alias("e")).select("o_orderkey", F.col("e.amount").alias("emd_amount"), F.col("e.bank").alias("bank"))


@query
def extract_epbg(spark, sf_dir):
    return _bids(spark, sf_dir).select("o_orderkey", fields.epbg(x()).alias("e")).select("o_orderkey", "e.required", "e.percent", "e.months", "e.bank")


@query
def extract_preference(spark, sf_dir):
    return _bids(spark, sf_dir).select(
        "o_orderkey",
        fields.preference(x(), fields.MII).alias("mii"),
        fields.percentage(x(), fields.MII_BAND).alias("mii_band"),
        fields.percentage(x(), fields.MII_SHARE).alias("mii_share"),
        fields.preference(x(), fields.MSE).alias("mse"),
        fields.percentage(x(), fields.MSE_BAND).alias("mse_band"),
        fields.percentage(x(), fields.MSE_SHARE).alias("mse_share"),
    )


@query
def extract_local_content(spark, sf_dir):
    return _bids(spark, sf_dir).select("o_orderkey", fields.local_content(F.col("text")).alias("l")).select("o_orderkey", "l.class1", "l.class2")


@query
def extract_bid_id(spark, sf_dir):
    """FX-15 with its fallbacks: every third text loses its number, every ninth path its digits."""
    k = F.col("o_orderkey")
    docs = fixtures.bid_documents(spark, sf_dir).withColumns({"text": F.when(k % 3 == 0, "no number").otherwise(F.col("text")), "path": F.when(k % 9 == 0, "x/none.pdf").otherwise(F.col("path"))})
    return docs.select("o_orderkey", fields.bid_id(F.col("text"), F.col("path")).alias("bid_id"), fields.link(fields.bid_id(F.col("text"), F.col("path")), F.col("internal_id"), F.col("path"), "https://portal.example").alias("pdf_link"))


@query
def item_category_takewhile(spark, sf_dir):
    return _bids(spark, sf_dir).select("o_orderkey", fields.category(x()).alias("category"))


@query
def parse_date(spark, sf_dir):
    """FX-16 on three spellings."""
    d = F.col("o_orderdate")
    return fixtures.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.parse_date(F.date_format(d, "dd-MM-yyyy")).alias("long_year"),
        dates.parse_date(F.date_format(d, "d-M-yy")).alias("short_year"),
        dates.parse_date(F.date_format(d, "yyyy/MM/dd")).alias("other"),
    )


@query
def atc_clauses(spark, sf_dir):
    return extract.clauses(fixtures.bid_documents(spark, sf_dir), "o_orderkey").drop("pos")


def _meta(spark, sf_dir):
    return extract.metadata(fixtures.bid_documents(spark, sf_dir), "", F.lit("2024-01-01"))


@query
def overview_chunk(spark, sf_dir):
    m = _meta(spark, sf_dir)
    return m.select("bid_id", extract.overview(m).alias("overview"))


@query
def eligibility_chunk(spark, sf_dir):
    return extract.with_conditions(_bids(spark, sf_dir)).select("o_orderkey", extract.eligibility().alias("eligibility"))


@query
def preference_chunk(spark, sf_dir):
    return extract.with_conditions(_bids(spark, sf_dir)).select("o_orderkey", extract.preference_policy().alias("policy"))


@query
def all_chunks(spark, sf_dir):
    """CB-06: how many chunks of each kind, and their ids."""
    return extract.chunks(_meta(spark, sf_dir)).select("chunk_id", "bid_id", "chunk_type", "clause_no")


@query
def query_terms(spark, sf_dir):
    """FLT-13 for a column of queries: the benchmark texts."""
    return fixtures.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.query_terms_column(F.col("text")), " ").alias("terms"))


@query
def index_tokens(spark, sf_dir):
    """SC-01's token side: tokens of each document, folded."""
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.index_tokens(F.col("text")), " ").alias("tokens"))


@query
def normalise_text(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("norm"))


@query
def content_hash(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
