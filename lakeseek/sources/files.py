"""Files: the document walk, the pluggable text extraction, manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "updated_at string, downloaded_bid_ids array<long>, bid_records map<string, struct<bid_id:long, bid_number:string, pdf_path:string, download_date:string, downloaded_at:string>>"


def documents(spark: SparkSession, folder: str, contents: bool = True) -> DataFrame:
    """(path, modificationTime, length[, content]) of every PDF under a folder; without contents none is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files if contents else files.drop("content")


#: Characters that a path pattern gives a meaning to: fixed values.
_PATTERN = r"([\[\]{}?*,\\])"
PATHS = 10_000
#: Bytes of downloaded contents that a task holds before it passes them on.
HELD_BYTES = 16 << 20


def contents(spark: SparkSession, paths: DataFrame, block: int = PATHS) -> Iterator[DataFrame]:
    """(path, modificationTime, length, content) of the files named in paths(path), a DataFrame for each ``block`` of them.

    Only these files are opened. Their names pass through the driver in blocks, as those of every file of a scan do.
    """
    held: list[str] = []
    for row in paths.select(F.regexp_replace("path", _PATTERN, r"\\$1").alias("path")).toLocalIterator():
        held.append(row.path)
        if len(held) == block:
            yield spark.read.format("binaryFile").load(held)
            held = []
    if held:
        yield spark.read.format("binaryFile").load(held)


def relative(path: Column, base: str) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^.*?" + base.strip("/").replace(".", r"\.") + "/", "")


def downloaded_ids(files: DataFrame) -> DataFrame:
    """Distinct portal ids of files that aren't empty, from names like bid_<id>_..."""
    name = F.element_at(F.split("path", "/"), -1)
    found = F.regexp_extract(name, r"^bid_(\d+)(?:_.*|\..*)$", 1).try_cast("long")
    return files.where("length > 0").select(found.alias("bid_id")).where("bid_id is not null").distinct()


def to_text(files: DataFrame, parse: Callable[[bytes], str]) -> DataFrame:
    """(path, document_hash, text): parse, a function of a file's bytes, runs in Arrow batches; a file that it fails on has a null text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(content: bytes) -> str | None:
            try:
                return parse(bytes(content))
            except Exception:
                return None

        for batch in batches:
            yield batch.map(one)

    return files.select("path", F.md5("content").alias("document_hash"), F.pandas_udf(run, "string")("content").alias("text"))


def manifest(raw: DataFrame) -> DataFrame:
    """(bid_id, bid_number, pdf_path, download_date, downloaded_at) of manifests read as JSON text (value); the key stands in for a missing bid_id, unreadable text gives none. Also takes the older flat map."""
    new = F.from_json("value", MANIFEST)["bid_records"]
    old = F.from_json("value", "map<string, struct<bid_id:long, bid_number:string, pdf_path:string, download_date:string, downloaded_at:string>>")
    rows = raw.select(F.explode(F.coalesce(new, F.map_filter(old, lambda k, v: v.isNotNull() & ~k.isin("updated_at", "downloaded_bid_ids")))).alias("k", "r"))
    return rows.select(F.coalesce("r.bid_id", F.col("k").try_cast("long")).alias("bid_id"), "r.bid_number", "r.pdf_path", "r.download_date", "r.downloaded_at")


#: Below: header and file-name patterns, suffixes and the characters that file systems refuse are fixed values.
def file_name(disposition: Column, content_type: Column) -> Column:
    """A download's file name: filename*, then filename, then one by content type; characters that file systems refuse become _."""
    star = F.url_decode(F.nullif(F.regexp_extract(disposition, r"(?i)filename\*=(?:UTF-8'')(\S+)", 1), F.lit("")))
    plain = F.nullif(F.trim(F.regexp_extract(disposition, r"""filename=(["']?)(.+?)\1(?:;|$)""", 2)), F.lit(""))
    kind = F.coalesce(content_type, F.lit(""))
    suffix = F.when(F.contains(kind, F.lit("pdf")), ".pdf").when(F.contains(kind, F.lit("zip")), ".zip").when(F.contains(kind, F.lit("html")), ".html").otherwise(".bin")
    return F.regexp_replace(F.coalesce(star, plain, F.concat(F.lit("document"), suffix)), r'[\\/*?:"<>|]', "_")


def known_ids(manifest_rows: DataFrame, files: DataFrame) -> DataFrame:
    """(bid_id): ids of a manifest and of files on disk, each once. The manifest remembers what a later clean-up has deleted."""
    return manifest_rows.select("bid_id").where("bid_id is not null").unionByName(downloaded_ids(files)).distinct()


def manifest_value(records: DataFrame, updated_at: str) -> DataFrame:
    """One row (value): the manifest of records(bid_id, ...) as JSON text, ids sorted. For manifests of the older kind; the ids also live as a table."""
    fields = ["bid_id", *[c for c in ("bid_number", "pdf_path", "download_date", "downloaded_at") if c in records.columns]]
    rows = F.collect_list(F.struct(F.col("bid_id").cast("string").alias("key"), F.struct(*fields).alias("value")))
    whole = records.agg(F.sort_array(F.collect_set("bid_id")).alias("downloaded_bid_ids"), F.map_from_entries(F.array_sort(rows)).alias("bid_records"))
    return whole.select(F.to_json(F.struct(F.lit(updated_at).alias("updated_at"), "downloaded_bid_ids", "bid_records")).alias("value"))


def with_manifest(files: DataFrame, records: DataFrame) -> DataFrame:
    """files(path, ...) with internal_id, download_date and downloaded_at of their manifest record, by the id in the file name; files without one have nulls."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("internal_id", F.regexp_extract(name, r"^bid_(\d+)(?:_.*|\..*)$", 1).try_cast("long"))
    return rows.join(records.select(F.col("bid_id").alias("internal_id"), "download_date", "downloaded_at").dropDuplicates(["internal_id"]), "internal_id", "left")


def legacy_bids(spark: SparkSession, path: str) -> DataFrame:
    """The objects of the array ``bids`` in old whole-file JSON documents; a document without the array, or with elements that aren't objects, is an error."""
    raw = spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path)
    kind = dict(raw.dtypes).get("bids", "missing")
    if not kind.startswith("array<struct"):
        raise ValueError(f"no array of objects named bids: {kind}")
    return raw.select(F.explode("bids").alias("bid")).select("bid.*")


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def download(bids: DataFrame, fetch: Callable[[int], tuple[str | None, str | None, bytes]], folder: str, date: str, tasks: int = 5) -> DataFrame:
    """(bid_id, pdf_path, download_date, n_bytes, error) of bids(bid_id): fetch gives disposition, content type and content; files go to folder/date as bid_<id>_<name>.

    At most ``tasks`` requests run at once; a task holds about HELD_BYTES of contents. Empty contents and failures leave no file and say why. Store the result before it is used twice: each evaluation downloads.
    """

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["bid_id", "head", "kind", "content", "error"]
        rows, held = [], 0
        for batch in batches:
            for bid in batch["bid_id"]:
                try:
                    head, kind, content = fetch(int(bid))
                    rows.append((bid, head, kind, bytes(content), None if content else "empty"))
                    held += len(content)
                except Exception as problem:
                    rows.append((bid, None, None, b"", f"{type(problem).__name__}: {problem}"))
                if held > HELD_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, root = _place(f"{folder}/{date}")
        place.create_dir(root, recursive=True)
        for batch in batches:
            for name, content, error in zip(batch["name"], batch["content"], batch["error"], strict=True):
                if error is None:
                    with place.open_output_stream(f"{root}/{name}") as out:
                        out.write(content)
            batch["n_bytes"] = batch["content"].map(len)
            batch["pdf_path"] = (f"{date}/" + batch["name"]).where(batch["error"].isna(), None)
            batch["download_date"] = date
            yield batch[["bid_id", "pdf_path", "download_date", "n_bytes", "error"]]

    got = bids.select(F.col("bid_id").cast("long").alias("bid_id")).distinct().repartition(tasks).mapInPandas(get, "bid_id long, head string, kind string, content binary, error string")
    named = got.withColumn("name", F.concat(F.lit("bid_"), F.col("bid_id").cast("string"), F.lit("_"), file_name(F.col("head"), F.col("kind"))))
    return named.mapInPandas(put, "bid_id long, pdf_path string, download_date string, n_bytes long, error string")


def download_counts(results: DataFrame) -> DataFrame:
    """One row (attempted, downloaded, failed, n_bytes) of results(bid_id, n_bytes, error)."""
    good = F.col("error").isNull()
    return results.agg(F.count("*").alias("attempted"), F.count_if(good).alias("downloaded"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col("n_bytes"))), F.lit(0)).alias("n_bytes"))


def remove_empty(spark: SparkSession, folder: str) -> list[str]:
    """Delete empty files directly in a folder, not below it; their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(path) if s.isFile() and s.getLen() == 0]
    for file in gone:
        fs.delete(file, False)
    return sorted(file.getName() for file in gone)


def archive_files(spark: SparkSession, folder: str, archive: str, names: list[str], stamp: int) -> list[str]:
    """Move files, named relative to folder, into archive; names outside it and files that aren't there are skipped, a name that is taken gets _<stamp>. Where they went."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    moved = []
    for name in dict.fromkeys(names):
        parts = name.replace("\\", "/").split("/")
        source = path(f"{folder}/{name}")
        if ".." in parts or name.startswith("/") or not name or not fs.isFile(source):
            continue
        target, stem = path(f"{archive}/{name}"), name.rsplit(".", 1)
        if fs.exists(target):
            target = path(f"{archive}/{stem[0]}_{stamp}" + (f".{stem[1]}" if len(stem) == 2 else ""))
        fs.mkdirs(target.getParent())
        if fs.rename(source, target):
            moved.append(target.toString())
    return moved


def missing_paths(spark: SparkSession, *paths: str) -> list[str]:
    """Those of the paths that aren't there: what has to be present before a run."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if not path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))]
