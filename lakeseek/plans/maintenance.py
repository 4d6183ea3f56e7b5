"""Daily maintenance: find changed files, extract them, embed, index, expire; under a lock, publishing versions.

A store holds, beside its states, the tables

* ``files`` (pdf_path, document_hash, length, modified, bid_id): what was read, so that a file is opened
  only if its length or time differ, and parsed only if its bytes do;
* ``file_chunks``: the chunks of every file; ``chunks``: those of the last file, by path, of each bid;
* ``sync_delta`` (chunk_id, op, at) of the last run; ``vectors`` (chunk_id, embedding, hash): what they lack is
  found by comparing with chunks, so nothing is lost if a run doesn't embed;
* ``expired_bids``, the last expiry report.

The stream (streaming.ingest) merges arrivals into the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.operators import changes, extract
from lakeseek.operators.lexical import SegmentedIndex
from lakeseek.sources import files
from lakeseek.sources.store import Store

EXPIRY_DAYS = 7
FILES = "pdf_path string, document_hash string, length long, modified timestamp, bid_id string"
CHUNKS = "chunk_id string, bid_id string, chunk_type string, title string, text string, clause_no long, pdf_path string, hash string"
Embed = Callable[[DataFrame], DataFrame]


def expiry_due(last: str | None, now: datetime, days: int = EXPIRY_DAYS) -> bool:
    """Whether the last check is days old, missing or unreadable."""
    try:
        return now - datetime.fromisoformat(last or "") >= timedelta(days=days)
    except (ValueError, TypeError):
        return True


def _table(store: Store, name: str, schema: str) -> DataFrame:
    found = store.read(name)
    return store.spark.createDataFrame([], schema) if found is None else found


def index(store: Store) -> SegmentedIndex:
    return SegmentedIndex(store)


def refresh_index(store: Store) -> bool:
    """Bring the index to the current chunks, counts alone proving nothing: a segment for what it lacks, marks for what is gone. Says whether it changed."""
    version = store.version("chunks")
    if version is None or store.state("index").get("version") == version:
        return False
    index(store).synchronise(store.read("chunks"))
    store.set_state("index", version=version)
    return True


def apply_vectors(store: Store, embed: Embed | None = None, limit: int | None = None) -> dict:
    """Bring the vectors to the chunks: those of other chunks or texts go, lacking ones are made by embed, which turns chunks into (chunk_id, embedding); at most ``limit`` of them, by chunk_id.

    Says how many were added and deleted. Without deletes rows are only appended.
    """
    chunks = store.read("chunks")
    if chunks is None:
        raise ValueError("there are no chunks to embed")
    had = _table(store, "vectors", "chunk_id string, embedding array<double>, hash string")
    key = ["chunk_id", "hash"]
    stale = had.join(chunks.select(*key), key, "left_anti").count()
    if stale:
        store.publish("vectors", had.join(chunks.select(*key), key, "left_semi"))
        had = store.read("vectors")
    if embed is None:
        return {"upsert": 0, "delete": stale}
    lacking = chunks.join(had.select(*key), key, "left_anti")
    lacking = lacking.orderBy("chunk_id").limit(limit) if limit is not None else lacking
    n = lacking.count()
    if n:
        new = embed(lacking).select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
        store.append("vectors", new.join(lacking.select(*key), "chunk_id").select("chunk_id", "embedding", "hash"))
    return {"upsert": n, "delete": stale}


def merge_documents(store: Store, docs: DataFrame, now: datetime, listed: DataFrame | None = None) -> dict:
    """Merge changed documents, file by file; counts of what happened.

    docs(path, text, document_hash, ...): new or changed ones, each path once; of those with a null text, which couldn't be read, what is there stays.
    listed(path, length, modified): every file that is there; others are forgotten. Without it nothing is.
    ``files`` is published last, so that a run that fails is done again by the next.
    """
    key, columns = "pdf_path", [c.split()[0] for c in CHUNKS.split(", ")]
    meta = extract.metadata(docs, now=F.lit(now.isoformat()))
    made = extract.chunk_arrays(meta)
    store.publish("staging", made.select(key, "document_hash", "bid_id", F.coalesce("bid_title", F.lit("")).alias("title"), F.col("text").isNotNull().alias("readable"), "_chunks"))
    staged = store.read("staging").where("readable")
    known, stored = _table(store, "files", FILES), _table(store, "file_chunks", CHUNKS)
    gone = known.select(key).limit(0) if listed is None else known.join(listed.select(F.col("path").alias(key)), key, "left_anti").select(key)
    touched = staged.select(key).unionByName(gone).distinct()
    bids = known.join(touched, key, "left_semi").select("bid_id").unionByName(staged.select("bid_id")).distinct()
    kept = known.join(touched, key, "left_anti")
    new = staged.select(key, "document_hash", F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"), "bid_id")
    current = kept.select(*new.columns).unionByName(new)
    if listed is not None:
        seen = listed.select(F.col("path").alias(key), F.col("length").alias("_length"), F.col("modified").alias("_modified"))
        current = current.join(seen, key, "left").select(key, "document_hash", F.coalesce("_length", "length").alias("length"), F.coalesce("_modified", "modified").alias("modified"), "bid_id")
    store.publish("next_files", current)
    current = store.read("next_files")
    counts = {"parsed": staged.count(), "unreadable": store.read("staging").where("not readable").count(), "removed_files": gone.count(), "upserts": 0, "deletes": 0}
    if counts["parsed"] or counts["removed_files"]:
        rows = staged.select(key, "bid_id", "title", F.inline("_chunks")).withColumn("hash", F.md5(F.concat_ws("\n", "title", "text"))).select(*columns)
        store.publish("file_chunks", stored.join(touched, key, "left_anti").select(*columns).unionByName(rows))
        last = extract.last_documents(current.join(bids, "bid_id", "left_semi")).select(key)
        old = _table(store, "chunks", CHUNKS)
        rebuilt = store.read("file_chunks").join(last, key, "left_semi").select(*columns)
        delta = changes.sync_delta(old.join(bids, "bid_id", "left_semi"), rebuilt, "chunk_id", "hash")
        store.publish("sync_delta", delta.withColumn("at", F.lit(now.isoformat())))
        ops = {r["op"]: r["count"] for r in store.read("sync_delta").groupBy("op").count().collect()}
        counts |= {"upserts": ops.get("upsert", 0), "deletes": ops.get("delete", 0)}
        if ops:
            store.publish("chunks", old.join(bids, "bid_id", "left_anti").select(*columns).unionByName(rebuilt))
    else:
        store.publish("sync_delta", store.spark.createDataFrame([], "chunk_id string, op string, at string"))
    store.publish("files", current)
    return counts


def expire(store: Store, active: DataFrame, apply: bool = False, force: bool = False, archive: tuple[str, str, int] | None = None) -> dict:
    """Compare the stored chunks with active(bid_id), publish the report's table ``expired_bids`` (bid_id, chunks), sorted, and return its counts.

    Nothing is removed unless apply is set; then chunks, vectors and files of expired bids go, and with archive (folder, archive folder,
    stamp for names that are taken) the files themselves are moved. An empty listing expires nothing unless forced.
    """
    chunks = store.read("chunks")
    if chunks is None:
        return {"active_bids": 0, "expired_bids": 0, "expired_chunks": 0, "applied": False}
    bids = chunks.groupBy("bid_id").agg(F.count("*").alias("chunks"))
    split = changes.expiry_split(bids, active, "bid_id", force)
    store.publish("expired_bids", split.where("expired").select("bid_id", "chunks").orderBy("bid_id"))
    expired = store.read("expired_bids")
    n, rows = expired.agg(F.count("*"), F.coalesce(F.sum("chunks"), F.lit(0))).first()
    report = {"active_bids": bids.count() - n, "expired_bids": n, "expired_chunks": rows, "applied": bool(apply and n)}
    if report["applied"]:
        known = _table(store, "files", FILES)
        if archive:
            folder, place, stamp = archive
            names = [r.pdf_path for r in known.join(expired, "bid_id", "left_semi").select("pdf_path").toLocalIterator()]
            report["archived"] = len(files.archive_files(store.spark, folder, place, names, stamp))
        store.publish("chunks", chunks.join(expired, "bid_id", "left_anti"))
        store.publish("file_chunks", _table(store, "file_chunks", CHUNKS).join(expired, "bid_id", "left_anti"))
        store.publish("files", known.join(expired, "bid_id", "left_anti"))
        apply_vectors(store)
    return report


def _finish(store: Store, counts: dict, now: datetime, embed: Embed | None, active: DataFrame | None, force_expiry: bool, skip_expiry: bool, archive: tuple[str, str, int] | None = None) -> dict:
    """What follows the merge: expiry if it is due, vectors, index, state."""
    report = {"last_daily_run_at": now.isoformat()} | counts
    last = store.state().get("last_expiry_check_at")
    if active is not None and not skip_expiry and (force_expiry or expiry_due(last, now)):
        report |= {"last_expiry_check_at": now.isoformat(), "expired_chunks": expire(store, active, True, False, archive)["expired_chunks"]}
    chunks = store.read("chunks")
    report["chunks"] = 0 if chunks is None else chunks.count()
    if chunks is not None:
        report["vectors"] = apply_vectors(store, embed)
    report["index_rebuilt"] = refresh_index(store)
    store.set_state(**report)
    return report


def run(
    store: Store,
    docs: DataFrame,
    now: datetime,
    *,
    embed: Embed | None = None,
    active: DataFrame | None = None,
    force_expiry: bool = False,
    skip_expiry: bool = False,
) -> dict:
    """One run over all documents docs(path, text, ...), read already; those whose path and hash (document_hash, else that of the text) are known aren't extracted again.

    Documents whose text is null couldn't be read: what an earlier run took from their path stays. The report is returned and saved as state.
    """
    with store.lock():
        hashed = docs.withColumn("document_hash", F.coalesce("document_hash", F.md5("text")) if "document_hash" in docs.columns else F.md5("text"))
        # Of rows with one path the last by text; unreadable ones only if there is no other.
        once = changes.last_by(hashed, "path", F.col("text"))
        known = _table(store, "files", FILES).select(F.col("pdf_path").alias("path"), "document_hash")
        listed = docs.select("path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified")).distinct()
        counts = merge_documents(store, once.join(known, ["path", "document_hash"], "left_anti"), now, listed)
        return _finish(store, counts | {"documents": docs.count()}, now, embed, active, force_expiry, skip_expiry)


def scan(store: Store, folder: str, *, rehash: bool = False) -> tuple[DataFrame, DataFrame]:
    """(listed, changed): listed(path, length, modified, file) of a folder, and path, change and file of those that are new or whose bytes changed; path is relative to the folder.

    Names, lengths and times come first; only files that differ in them (with rehash all known ones) are opened, and hashed in the JVM.
    """
    spark, base = store.spark, folder.rstrip("/")
    found = files.documents(spark, folder, contents=False)
    store.publish("listed", found.select(files.relative(F.col("path"), base.split("://")[-1]).alias("path"), "length", F.col("modificationTime").alias("modified"), F.col("path").alias("file")))
    listed = store.read("listed")
    known = _table(store, "files", FILES).select(F.col("pdf_path").alias("path"), "document_hash", "length", "modified")
    first = changes.file_changes(known, listed)
    suspects = first.where(F.col("change").isin("suspect", "unchanged") if rehash else F.col("change") == "suspect").join(listed, "path")
    hashes = spark.createDataFrame([], "file string, document_hash string")
    store.publish("hashes", hashes)
    for block in files.contents(spark, suspects.select(F.col("file").alias("path"))):
        store.append("hashes", block.select(F.col("path").alias("file"), F.md5("content").alias("document_hash")))
    hashes = store.read("hashes").join(listed.select("path", "file"), "file").select("path", "document_hash")
    return listed, changes.file_changes(known, listed, hashes).join(listed.select("path", "file"), "path").where(F.col("change").isin("new", "changed"))


def run_files(
    store: Store,
    folder: str,
    parse: Callable[[bytes], str],
    now: datetime,
    *,
    manifest: DataFrame | None = None,
    rehash: bool = False,
    embed: Embed | None = None,
    active: DataFrame | None = None,
    force_expiry: bool = False,
    skip_expiry: bool = False,
    archive: str | None = None,
) -> dict:
    """One run over the PDF files of a folder: unchanged ones are neither opened (but with rehash) nor parsed. manifest(bid_id, download_date, downloaded_at): what is known about downloads; archive: where files of expired bids go."""
    with store.lock():
        listed, changed = scan(store, folder, rehash=rehash)
        store.publish("parsed", store.spark.createDataFrame([], "file string, document_hash string, text string"))
        for block in files.contents(store.spark, changed.select(F.col("file").alias("path"))):
            store.append("parsed", files.to_text(block, parse).withColumnRenamed("path", "file"))
        texts = store.read("parsed").join(listed.select("path", "file"), "file").drop("file")
        texts = texts if manifest is None else files.with_manifest(texts, manifest)
        counts = merge_documents(store, texts, now, listed) | {"documents": listed.count()}
        moved = None if archive is None else (folder, archive, int(now.timestamp()))
        return _finish(store, counts, now, embed, active, force_expiry, skip_expiry, moved)
