"""Files written through a commit protocol, and the manifest in sorted parts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ATTEMPTS, MOVES = "_attempts", 16
FIELDS = "bid_id long, bid_number string, pdf_path string, download_date string, downloaded_at string"


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    """Each task attempt writes into a folder of its own; the commit moves the files of the attempts that count, and what is left goes. Names are relative; a name that is there already is replaced."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        place, root = _place(self.path)
        folder, names = f"{root}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}", []
        for name, content in iterator:
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a name inside the folder: {name}")
            place.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
            with place.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(content or b""))
            names.append(name)
        return _Written(folder, names)

    def _clean(self) -> None:
        from pyarrow import fs

        place, root = _place(self.path)
        if place.get_file_info(f"{root}/{ATTEMPTS}/{self.job}").type != fs.FileType.NotFound:
            place.delete_dir(f"{root}/{ATTEMPTS}/{self.job}")
        if place.get_file_info(f"{root}/{ATTEMPTS}").type != fs.FileType.NotFound and not place.get_file_info(fs.FileSelector(f"{root}/{ATTEMPTS}")):
            place.delete_dir(f"{root}/{ATTEMPTS}")

    def commit(self, messages: list[_Written | None]) -> None:
        place, root = _place(self.path)
        moves = [(f"{m.folder}/{name}", f"{root}/{name}") for m in messages if m is not None for name in m.names]
        for folder in {target.rsplit("/", 1)[0] for _, target in moves}:
            place.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda move: place.move(*move), moves))
        self._clean()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean()


class FileSink(DataSource):
    """``rows(name, content).write.format("files").mode("append").save(folder)`` after ``spark.dataSource.register(FileSink)``: a file for each row."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("rows must be (name, content)")
        return FileWriter(self.options["path"])


def _joined(spark: SparkSession, target: str, pieces: list[str]) -> None:
    """Files one after the other as a new one, which takes the target's name when it is complete. Bytes pass through in small buffers."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    part = path(f"{target}.{uuid.uuid4().hex}")
    fs = part.getFileSystem(conf)
    out = fs.create(part, True)
    for piece in pieces:
        source = fs.open(path(piece))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
        source.close()
    out.close()
    fs.delete(path(target), False)
    if not fs.rename(part, path(target)):
        raise OSError(f"{target} can't be replaced")


def write_array(rows: DataFrame, path: str, name: str, key: str) -> None:
    """One JSON document {name: [...]} with the rows as objects, a line each, in the order of key, which each row has once. Lines are made and sorted by many tasks."""
    import json

    spark = rows.sparkSession
    work = f"{path}.parts-{uuid.uuid4().hex}"
    last = rows.agg(F.max(key)).first()[0]
    comma = F.when(F.col(key) == F.lit(last), "").otherwise(",")
    rows.repartitionByRange(key).sortWithinPartitions(key).select(F.concat(F.to_json(F.struct(*rows.columns)), comma).alias("value")).write.text(f"{work}/rows")
    folder = spark._jvm.org.apache.hadoop.fs.Path(work)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    ends = []
    for piece, text in (("head", "{" + json.dumps(name) + ": [\n"), ("tail", "]}\n")):
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{work}/{piece}"), True)
        out.write(bytearray(text.encode()))
        out.close()
        ends.append(f"{work}/{piece}")
    parts = sorted(s.getPath().toString() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{work}/rows")) if s.getPath().getName().startswith("part-"))
    _joined(spark, path, [ends[0], *parts, ends[1]])
    fs.delete(folder, True)


def write_manifest(records: DataFrame, path: str, updated_at: str) -> None:
    """The manifest of records(bid_id, ...) as one JSON document with a line for each id and record, ids in order.

    Lines are made and sorted by many tasks, in parts whose order is that of the ids; only the finished parts are put one after the other.
    A record without an id is left out, of several with one id one stays.
    """
    import json

    spark = records.sparkSession
    names = [c.split()[0] for c in FIELDS.split(", ")]
    rows = records.where("bid_id is not null").select(*[F.col(n) if n in records.columns else F.lit(None).cast("string").alias(n) for n in names]).dropDuplicates(["bid_id"])
    work = f"{path}.parts-{uuid.uuid4().hex}"
    rows.repartitionByRange("bid_id").sortWithinPartitions("bid_id").write.parquet(f"{work}/rows")
    folder = spark._jvm.org.apache.hadoop.fs.Path(work)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # Whole ranges again, sorted: what was written may be read in other pieces.
    sorted_rows = spark.read.schema(FIELDS).parquet(f"{work}/rows").repartitionByRange("bid_id").sortWithinPartitions("bid_id")
    last = spark.read.schema(FIELDS).parquet(f"{work}/rows").agg(F.max("bid_id")).first()[0]
    comma = F.when(F.col("bid_id") == F.lit(last), "").otherwise(",")
    kinds = {"ids": F.col("bid_id").cast("string"), "records": F.concat(F.lit('"'), F.col("bid_id").cast("string"), F.lit('": '), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))}
    for kind, line in kinds.items():
        sorted_rows.select(F.concat(line, comma).alias("value")).write.text(f"{work}/{kind}")

    def text(name: str, value: str) -> str:
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{work}/{name}"), True)
        out.write(bytearray(value.encode()))
        out.close()
        return f"{work}/{name}"

    def parts(kind: str) -> list[str]:
        return sorted(s.getPath().toString() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{work}/{kind}")) if s.getPath().getName().startswith("part-"))

    head = text("head", '{"updated_at": ' + json.dumps(updated_at) + ',\n"downloaded_bid_ids": [\n')
    _joined(spark, path, [head, *parts("ids"), text("middle", '],\n"bid_records": {\n'), *parts("records"), text("tail", "}}\n")])
    fs.delete(folder, True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(bid_id, bid_number, pdf_path, download_date, downloaded_at) of a manifest that write_manifest() wrote: a line a record, so many tasks read it."""
    line = r'^"\d+": (\{.*\}),?$'
    found = spark.read.text(path).select(F.regexp_extract("value", line, 1).alias("value")).where("value <> ''")
    return found.select(F.from_json("value", FIELDS, {"mode": "FAILFAST"}).alias("r")).select("r.*")
