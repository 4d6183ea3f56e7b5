"""Queries for manifests, files, exports, the stored form of collections, and run state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek import fixtures
from lakeseek.functions import dates, text
from lakeseek.operators import changes, extract, lexical, metadata, present
from lakeseek.operators.lexical import LexicalIndex
from lakeseek.plans import hybrid
from lakeseek.queries_search import QUERY, _index, _rounded
from lakeseek.queries_tables import _eav, _expiry, _exported, _live, _snapshots, query
from lakeseek.sources import files, listing, sinks


@query
def bid_records(spark, sf_dir):
    """PRJ-08, every field."""
    meta = extract.metadata(fixtures.bid_documents(spark, sf_dir), "https://portal.example", F.lit("2024-01-01T00:00:00Z"))
    return meta.withColumn("document_hash", F.col("document_hash") == F.md5("text")).drop("lines", "text")


@query
def chunk_texts(spark, sf_dir):
    """CB-01 to CB-06: the text of every chunk."""
    return extract.chunks(extract.metadata(fixtures.bid_documents(spark, sf_dir), "", F.lit("2024-01-01"))).select("chunk_id", "text")


@query
def parent_metadata(spark, sf_dir):
    """JN-17: line items without metadata of their own take that of their order."""
    lines = fixtures.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    own = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag"))
    bids = fixtures.table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("metadata"))
    return changes.with_parent_metadata(lines.withColumn("metadata", own), bids, "l_orderkey")


def _files(spark, sf_dir) -> DataFrame:
    """Files of orders: every fifth is empty, every seventh has no id in its name."""
    k = F.col("o_orderkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("other-"), k.cast("string"), F.lit(".pdf"))).otherwise(F.concat(F.lit("bid_"), k.cast("string"), F.lit("_doc.pdf")))
    return fixtures.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("file:/data/bids/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), name).alias("path"), F.when(k % 5 == 0, 0).otherwise(k).cast("long").alias("length"))


def _records(spark, sf_dir) -> DataFrame:
    """Manifest records: every third order."""
    k = F.col("o_orderkey")
    return fixtures.table(spark, sf_dir, "orders").where(k % 3 == 0).select(k.alias("bid_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("download_date"), F.col("o_orderpriority").alias("downloaded_at"))


@query
def file_ids(spark, sf_dir):
    """SRC-07b."""
    return files.downloaded_ids(_files(spark, sf_dir))


@query
def relative_paths(spark, sf_dir):
    """MS-08, with either slash."""
    path = F.when(F.col("o_orderkey") % 2 == 0, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path"))
    return _files(spark, sf_dir).select("o_orderkey", files.relative(path, "/data/bids").alias("relative"))


@query
def known_bid_ids(spark, sf_dir):
    """SO-02, INC-02: ids of the manifest and on disk."""
    return files.known_ids(_records(spark, sf_dir), _files(spark, sf_dir))


@query
def manifest_join(spark, sf_dir):
    """JN-08."""
    return files.with_manifest(_files(spark, sf_dir), _records(spark, sf_dir)).select("o_orderkey", "internal_id", "download_date", "downloaded_at")


@query
def manifest_round_trip(spark, sf_dir):
    """SNK-02, SL-09: the manifest of all records as JSON with sorted ids, written in parts and read back."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("download_date")
    records = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bid_id"), day, F.col("o_orderpriority").alias("downloaded_at"))
    path = fixtures.stored(spark, sf_dir, "manifest", lambda p: sinks.write_manifest(records, p, "2024-01-01T00:00:00Z"))
    return sinks.read_manifest(spark, path).select("bid_id", "download_date", "downloaded_at")


@query
def sorted_ids(spark, sf_dir):
    """SL-09: ids of upserts, in order, for each source."""
    delta = changes.sync_delta(*_snapshots(spark, sf_dir), "doc_id", "hash").where("op = 'upsert'")
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", "source")
    return delta.join(docs, "doc_id").groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_set("doc_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query
def download_cap(spark, sf_dir):
    """SL-07, JN-12: the first 25 new candidates in listing order."""
    found = listing.candidates(fixtures.listing(spark, sf_dir).select("page", "position", *listing.first_of()))
    return listing.to_download(found, _records(spark, sf_dir), 25).select("bid_id", "bid_number")


@query
def download_counters(spark, sf_dir):
    """AG-19 on results of which every sixth failed."""
    k = F.col("o_orderkey")
    rows = fixtures.table(spark, sf_dir, "orders").select(k.alias("bid_id"), F.when(k % 6 == 0, 0).otherwise(k % 100).alias("n_bytes"), F.when(k % 6 == 0, "empty").alias("error"))
    return files.download_counts(rows)


@query
def delta_counters(spark, sf_dir):
    """AG-12, AG-14: what a run upserts, deletes, leaves and couldn't read."""
    return changes.classify(*_snapshots(spark, sf_dir), "doc_id", "hash").groupBy("change").agg(F.count("*").alias("n"))


@query
def expired_ids(spark, sf_dir):
    """AG-11, SNK-19: the expired bids with their chunks."""
    return _expiry(spark, sf_dir).where("expired").select("o_orderkey", "chunks")


@query
def result_fields(spark, sf_dir):
    """PRJ-02 for the flagship search."""
    chunks, index = _index(spark, sf_dir)
    found = hybrid.search(chunks, index, QUERY, vectors=fixtures.vectors(spark, sf_dir), query_embedding=fixtures.query_vector(spark, sf_dir), limit=10)
    return present.result_format(found.join(chunks.select("chunk_id", F.col("title").alias("bid_title"), "text"), "chunk_id"))


@query
def status_augmented_export(spark, sf_dir):
    """PRJ-04, JN-15: the export with live status by bid."""
    exported = _exported(spark, sf_dir)
    live = _live(spark, sf_dir).withColumn("bid_number", F.concat(F.lit("GEM/B/"), "bid_number"))
    return present.status_export(exported.drop("position"), live).select(F.col("Bid ID").alias("bid_id"), F.col("Live End Date (GeM)").alias("live_end"), F.col("Extended?").alias("extended"), F.col("Live Status").alias("status"))


@query
def display_dates(spark, sf_dir):
    """PRJ-10."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = fixtures.table(spark, sf_dir, "orders").select(k, F.when(k % 2 == 0, day).when(k % 4 == 1, "").alias("published_date"), F.when(k % 3 == 0, "start").alias("bid_start_date"), F.when(k % 5 == 0, day).alias("end_date_to_submit_bid"))
    return present.display_dates(rows).select("o_orderkey", "start_label", "end_label")


@query
def bid_files(spark, sf_dir):
    """PRJ-09, JN-19: files of bids, by path, or by the digits of the bid id."""
    k = F.col("o_orderkey")
    orders = fixtures.table(spark, sf_dir, "orders")
    bids = orders.select(F.concat(F.lit("GEM/2024/B/"), (k + 100000).cast("string")).alias("bid_id"), F.when(k % 4 == 0, F.concat(F.lit("named/"), k.cast("string"), F.lit(".pdf"))).otherwise("").alias("pdf_path"), F.lit("nowhere.pdf").alias("pdf_link"))
    there = orders.where(k % 8 == 0).select(F.concat(F.lit("named/"), k.cast("string"), F.lit(".pdf")).alias("path"))
    digits = orders.where(k % 3 == 0).select(F.concat(F.lit("x/bid_"), (k + 100000).cast("string"), F.lit("_doc.PDF")).alias("path"))
    return present.find_files(bids, there.unionByName(digits)).withColumn("bid_id", F.substring_index("bid_id", "/", -1).cast("long") - 100000).withColumnRenamed("bid_id", "o_orderkey")


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions as collections, nations as segments (every fourth of another scope), orders as rows in the segment of their key."""
    collections = fixtures.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    n = F.col("n_nationkey")
    segments = fixtures.table(spark, sf_dir, "nation").select(n.cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("collection"), F.when(n % 4 == 3, "VECTOR").otherwise("METADATA").alias("scope"))
    k = F.col("o_orderkey")
    rows = fixtures.table(spark, sf_dir, "orders").select(k.alias("id"), (k % 25).alias("segment_id"), F.concat(F.lit("e"), k.cast("string")).alias("embedding_id"))
    return rows, segments, collections


@query
def collection_scan(spark, sf_dir):
    """JN-04, SRC-14: four tables, pivoted."""
    found = metadata.scan(*_stored(spark, sf_dir), _eav(spark, sf_dir), "ASIA")
    return found.select("embedding_id", F.try_element_at("metadata", F.lit("status")).alias("status"), F.try_element_at("metadata", F.lit("customer")).alias("customer"), F.size("metadata").cast("long").alias("entries"))


@query
def collection_members(spark, sf_dir):
    """JN-05's joins: rows of the metadata segments of a collection."""
    return metadata.members(*_stored(spark, sf_dir), "EUROPE")


def _collection_of_documents(spark, sf_dir):
    """documents as rows; their metadata in long form, with a bid id for each."""
    chunks, index = _index(spark, sf_dir)
    rows = chunks.select(F.col("chunk_id").alias("id"), (F.col("chunk_id") % 25).alias("segment_id"), F.concat(F.lit("e"), F.col("chunk_id").cast("string")).alias("embedding_id"))
    none = lambda t: F.lit(None).cast(t)
    pairs = F.array(F.struct(F.lit("bid_id").alias("key"), F.concat(F.lit("GEM/2024/B/"), F.col("chunk_id").cast("string")).alias("s")), F.struct(F.lit("lang").alias("key"), F.col("lang").alias("s")))
    long = chunks.select(F.col("chunk_id").alias("id"), F.explode(pairs).alias("p")).select("id", "p.key", F.col("p.s").alias("string_value"), none("long").alias("int_value"), none("double").alias("float_value"), none("int").alias("bool_value"))
    return index, rows, *_stored(spark, sf_dir)[1:], long


@query
def collection_search(spark, sf_dir):
    """SC-11: full-text search inside a collection, filtered by metadata."""
    index, rows, segments, collections, long = _collection_of_documents(spark, sf_dir)
    found = metadata.search(index, rows, segments, collections, long, "AMERICA", QUERY, 15, F.try_element_at("metadata", F.lit("lang")) == "en")
    return _rounded(found.select("embedding_id", "score"), "score")


@query
def collection_search_by_id(spark, sf_dir):
    """SC-11, SO-01: a query that is a bid id puts its row first."""
    index, rows, segments, collections, long = _collection_of_documents(spark, sf_dir)
    return metadata.search(index, rows, segments, collections, long, "ASIA", "gem/2024/b/27", 1).select("embedding_id", "score", F.try_element_at("metadata", F.lit("bid_id")).alias("bid_id"))


@query
def metadata_json(spark, sf_dir):
    """MS-11: metadata to JSON and back."""
    maps = present.eav_maps(_eav(spark, sf_dir)).select("id", metadata.encode(F.col("metadata")).alias("json"))
    return maps.select("id", F.try_element_at(metadata.decode(F.col("json")), F.lit("status")).alias("status"), F.try_element_at(metadata.decode(F.col("json")), F.lit("half")).alias("half"))


@query
def vector_metadata_entries(spark, sf_dir):
    """PRJ-01: which entries a chunk's metadata keeps, and what they are."""
    chunks = fixtures.chunk_table(spark, sf_dir)
    made = chunks.select("chunk_id", changes.vector_metadata(chunks, ["lang", "source", "n_chars"]).alias("m"))
    return made.select("chunk_id", F.explode("m").alias("key", "value"))


@query
def run_dates(spark, sf_dir):
    """MS-10: the date in India of midnight and of 20:00 UTC."""
    at = F.col("o_orderdate").cast("timestamp")
    day = lambda t: F.date_format(dates.india_date(t), "yyyy-MM-dd")
    return fixtures.table(spark, sf_dir, "orders").select("o_orderkey", day(at).alias("at_midnight"), day(at + F.expr("interval 20 hours")).alias("at_eight"))


@query
def exact_id_first(spark, sf_dir):
    """SO-01, FLT-06: the exact id's rows, then full-text hits."""
    chunks, index = _index(spark, sf_dir)
    named = chunks.withColumn("bid_id", F.concat(F.lit("GEM/2024/B/"), (F.col("chunk_id") % 100).cast("string")))
    assert text.is_bid_id("gem/2024/b/7")
    return lexical.search(index, named, "gem/2024/b/7", None, id_column="bid_id").where(F.col("score") == lexical.EXACT_SCORE).select("chunk_id", "bid_id")


@query
def index_after_update(spark, sf_dir):
    """SNK-08: document frequencies after even documents came into an index of the others, and every fourth went."""
    chunks = fixtures.chunk_table(spark, sf_dir)
    odd = LexicalIndex.build(chunks.where("chunk_id % 2 = 1"))
    index = odd.add(chunks.where("chunk_id % 2 = 0")).remove(chunks.where("chunk_id % 4 = 0").select("chunk_id"))
    return index.document_frequency()


@query
def search_between_dates(spark, sf_dir):
    """SL-05: four times the limit, then by date."""
    chunks, index = _index(spark, sf_dir)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("chunk_id") % 60).cast("int")), "yyyy-MM-dd")
    found = hybrid.search_between(chunks, index, QUERY, day, day, F.lit("2024-01-15").cast("date"), None, 10, vectors=fixtures.vectors(spark, sf_dir), query_embedding=fixtures.query_vector(spark, sf_dir))
    return _rounded(found, "score").select("chunk_id", "score")
