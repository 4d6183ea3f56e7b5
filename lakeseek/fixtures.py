"""Tender documents, listings and chunks derived from the test tables, so that base columns are an oracle for what is extracted."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Labels up to which they are broadcast: some 100 MB.
LABELS = 2_000_000
_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Where a fixture is that write(path) makes: once for each application and set of tables, in the shared folder (a temporary one where driver and executors are one process)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-lakeseek-")
        path = f"{root.rstrip('/')}/lakeseek-fixtures/{name}-{uuid.uuid4().hex}"
        write(path)
        _stored[key] = path
    return _stored[key]


def stored_table(spark: SparkSession, sf_dir: str, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """A made table, written once and read from there: queries measure the operator, not the making of its input."""
    return spark.read.parquet(stored(spark, sf_dir, name, lambda path: made().write.parquet(path)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with customer, nation and region names and the summed quantity (null without line items)."""
    qty = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("long").alias("qty"))
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(qty, "o_orderkey", "left")
    )


def bid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, path, internal_id, text): one synthetic tender document an order, as a stored table."""
    return stored_table(spark, sf_dir, "bid-documents", lambda: _bid_documents(spark, sf_dir))


def _bid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "dd-MM-yyyy")

    def when(condition, *lines):
        return F.when(condition, F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in lines]))

    text = F.concat_ws(
        "\n",
        F.format_string("Bid Number: GEM/%d/B/%d", F.year("o_orderdate"), k),
        F.concat(F.lit("Dated: "), day),
        F.lit("Bid Start Date/Time"),
        F.lit(""),
        F.concat(F.lit("  "), day, F.lit(" 09:00:00 ")),
        F.lit("Bid End Date/Time"),
        F.concat(F.date_format(F.date_add(F.to_date("o_orderdate"), (k % 30).cast("int")), "dd-MM-yyyy"), F.lit(" 21:00:00")),
        F.lit("Ministry/State Name"),
        F.col("r_name"),
        F.lit("Department Name"),
        F.col("n_name"),
        when(k % 4 != 3, "Organisation Name", F.col("c_name")),
        F.lit("Item Category"),
        F.col("o_orderpriority"),
        F.col("c_mktsegment"),
        F.lit("GeMARPTS"),
        when(F.col("qty").isNotNull(), "Total Quantity", F.format_string("%,d", F.col("qty"))),
        when(k % 3 == 0, "Minimum Average Annual Turnover of the bidder (For 3 Years)", F.concat((k % 50).cast("string"), F.lit(" Lakh (s)"))),
        when(k % 3 == 1, "OEM Average Turnover (Last 3 Years)", F.lit("N/A."), F.format_string("Rs %,d crore", k % 7000)),
        when(k % 5 != 0, "Past Experience Required", F.concat((k % 5).cast("string"), F.lit(" Year (s)"))),
        when(k % 2 == 0, "Past Performance", F.concat((k % 100).cast("string"), F.lit(" %"))),
        when(k % 4 < 3, "EMD Detail", "Required", F.when(k % 4 == 1, "No").otherwise("Yes"), "Advisory Bank", "State Bank of India", "EMD Amount", F.format_string("%,d", k * 10)),
        when(k % 6 < 4, "ePBG Detail", "Required", F.when(k % 6 == 2, "No").otherwise("Yes"), "Advisory Bank", "Union Bank", "ePBG Percentage(%)", F.concat((k % 10).cast("string"), F.lit(".50")), "Duration of ePBG required (Months).", (k % 36)),
        when(
            k % 7 == 0,
            "MII Purchase Preference", F.when(k % 14 == 0, "Yes").otherwise("No"),
            "Purchase Preference to MII sellers availabele upto price within L1+X%", (k % 20),
            "Maximum Percentage of Bid quantity for MII purchase preference", (k % 50),
        ),
        when(k % 11 == 0, "MSE Purchase Preference", "Yes", "Purchase Preference to MSE OEMs available upto price within L1+X%", (k % 15), "Percentage of Bid quantity/amount for MSE purchase preference", (k % 25)),
        when(k % 13 == 0, F.concat(F.lit("Minimum "), (k % 60).cast("string"), F.lit("% and "), (k % 30).cast("string"), F.lit("% Local Content"))),
        F.lit("Buyer Added Bid Specific Terms and Conditions"),
        F.lit("stray line"),
        F.lit("1. Generic:"),
        F.concat(F.lit("First term of order "), k.cast("string")),
        F.col("o_orderstatus"),
        F.lit(" 2. Delivery / Training "),
        F.concat(F.lit("Deliver to "), F.col("c_name")),
        F.lit("3. Empty"),
        F.lit("  "),
        F.lit("Disclaimer"),
        F.lit("4. Not a clause"),
        F.lit("tail"),
    )
    # Dealt out before texts are made: they never move.
    wide = orders_wide(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey")
    return wide.select("o_orderkey", F.format_string("bids/2024-01-01/bid_%d_doc.pdf", k).alias("path"), F.when(k % 3 == 0, k).alias("internal_id"), text.alias("text"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as retrieval chunks: (chunk_id, title, text, lang, source, n_chars, is_boilerplate), title being the first line."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("is_boilerplate"))
    # Broadcast, or the texts of all documents would be shuffled to meet them.
    docs = table(spark, sf_dir, "documents").join(F.broadcast(labels) if labels.count() <= LABELS else labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("chunk_id"), _title(), "text", "lang", "source", "n_chars", "is_boilerplate")


def _title() -> Column:
    return F.substring_index("text", "\n", 1).alias("title")


def indexed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, title, text) of chunk_table(). Labels say nothing of texts, so these don't meet them, which would shuffle them, unless a document has several labels and so several chunks."""
    if not table(spark, sf_dir, "labels").groupBy("doc_id").count().where("count > 1").isEmpty():
        return chunk_table(spark, sf_dir).select("chunk_id", "title", "text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), _title(), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One row by its key."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as portal pages of 20, newest first: (page, position, doc struct of one-element arrays). Every 7th entry is a reverse auction of the next order, every 21st of none."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    order = (F.col("o_orderdate").desc(), F.col("o_orderkey").asc())
    # Numbered without one task that sees all: rows are dealt by ranges and sorted inside them, and each knows its part and its place there.
    placed = lambda: orders.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    rows = stored_table(spark, sf_dir, "placed-orders", placed)
    # One row a part, however many orders there are.
    sizes = rows.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("o_orderkey", "o_orderdate", (F.col("before") + F.col("place")).alias("at"))
    k = F.col("o_orderkey")
    ra, orphan = F.col("at") % 7 == 6, F.col("at") % 21 == 20
    number = F.format_string("GEM/%d/%s/%d", F.year("o_orderdate"), F.when(ra, "R").otherwise("B"), k)
    parent = ra & ~orphan
    doc = F.struct(
        F.array(k).alias("b_id"),
        F.array(number).alias("b_bid_number"),
        F.when(parent, F.array(k + 1)).alias("b_id_parent"),
        F.when(parent, F.array(F.format_string("GEM/%d/B/%d", F.year("o_orderdate"), k + 1))).alias("b_bid_number_parent"),
        F.array(F.date_format("o_orderdate", "yyyy-MM-dd'T'21:00:00'Z'")).alias("final_end_date_sort"),
        F.array((k % 2).cast("int")).alias("b_is_inactive"),
    )
    return rows.select(F.floor(F.col("at") / 20).alias("page"), F.col("at").alias("position"), doc.alias("doc"))
