"""Command lines: search, extract, embed, maintain and expire a store. ``python -m lakeseek <command> --help``.

Parsers and embedders are named ``module:function``: a parser turns a file's bytes into text, an embedder a list of texts into a list of vectors.
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.functions.dates import india_date
from lakeseek.operators import lexical, present
from lakeseek.operators.where import where
from lakeseek.plans import hybrid, maintenance
from lakeseek.session import session
from lakeseek.sources.store import Store

COMMANDS = {
    "search": "results as JSON lines: full text, or hybrid with an embedder",
    "extract": "extract new and changed PDF files of a folder",
    "embed": "embed the chunks that have no vector of their text yet",
    "maintain": "extract documents, publish chunks, delta, vectors, index",
    "expire": "report expired bids; removes them only with --apply",
}


def _arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lakeseek")
    commands = out.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        c = commands.add_parser(name, help=text)
        c.add_argument("--store", required=True, help="base folder of the store")
        c.add_argument("--master", default=None)
        if name in ("search", "embed", "maintain"):
            c.add_argument("--embedder", default=None, required=name == "embed", help="module:function of texts to vectors")
        if name in ("extract", "maintain"):
            c.add_argument("--folder", default=None, required=name == "extract", help="folder of PDF files")
            c.add_argument("--parser", default=None, required=name == "extract", help="module:function of bytes to text")
            c.add_argument("--rehash", action="store_true", help="compare the bytes of all known files")
        if name == "search":
            c.add_argument("query")
            c.add_argument("--limit", type=int, default=10)
            c.add_argument("--where", default=None, help="metadata filter as JSON")
            c.add_argument("--include-boilerplate", action="store_true")
        elif name == "embed":
            c.add_argument("--limit", type=int, default=None, help="chunks to embed at most")
        elif name == "maintain":
            c.add_argument("--documents", default=None, help="Parquet or JSON lines of (path, text, ...)")
            c.add_argument("--format", default="parquet", choices=("parquet", "json"))
        elif name == "expire":
            c.add_argument("--active", required=True, help="Parquet of (bid_id): the live listing")
            c.add_argument("--apply", action="store_true")
            c.add_argument("--force", action="store_true", help="also expire if the listing is empty")
            c.add_argument("--folder", default=None, help="folder of the PDF files")
            c.add_argument("--archive", default=None, help="where files of expired bids are moved")
    return out


def _named(name: str) -> Callable[..., Any]:
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def _embed(name: str) -> Callable[[DataFrame], DataFrame]:
    """The embedder as a function of chunks; it is imported in the tasks, so that a model is loaded once a process."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = _named(name)
        for batch in batches:
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "embedding": [[float(x) for x in v] for v in made(batch["text"].tolist())]})

    return lambda rows: rows.select("chunk_id", "text").mapInPandas(run, "chunk_id string, embedding array<double>")


def _search(store: Store, a: argparse.Namespace) -> list[str]:
    if not maintenance.index(store).state()["segments"]:
        raise SystemExit("the store has no index; run maintain first")
    chunks, index = store.read("chunks"), maintenance.index(store).load()
    condition = json.loads(a.where) if a.where else None
    vectors = store.read("vectors")
    if a.embedder and vectors is not None:
        found = hybrid.search(chunks, index, a.query, vectors=vectors, embedder=_named(a.embedder), limit=a.limit, condition=condition, exclude_boilerplate=not a.include_boilerplate, id_column="bid_id")
        rows = chunks.join(F.broadcast(found), "chunk_id").orderBy(F.col("score").desc(), "chunk_id")
    else:
        test = where(condition)
        if "is_boilerplate" in chunks.columns and not a.include_boilerplate:
            test = test & ~F.coalesce(F.col("is_boilerplate"), F.lit(False))
        rows = lexical.search(index, chunks, a.query, a.limit, test, id_column="bid_id").withColumn("score", -F.col("score"))
    return [r[0] for r in present.result_format(rows).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def main(words: list[str] | None = None) -> list[str]:
    """Run a command; the lines it prints."""
    a = _arguments().parse_args(words)
    spark = session(a.master)
    store, now = Store(spark, a.store), datetime.now(UTC).replace(tzinfo=None)
    if a.command == "search":
        lines = _search(store, a)
    elif a.command == "embed":
        with store.lock():
            lines = [json.dumps(maintenance.apply_vectors(store, _embed(a.embedder), a.limit), sort_keys=True)]
    elif a.command == "extract" or (a.command == "maintain" and a.folder):
        embed = _embed(a.embedder) if a.command == "maintain" and a.embedder else None
        lines = [json.dumps(maintenance.run_files(store, a.folder, _named(a.parser), now, rehash=a.rehash, embed=embed, skip_expiry=True), sort_keys=True)]
    elif a.command == "maintain":
        if not a.documents:
            raise SystemExit("maintain needs --documents or --folder with --parser")
        docs = spark.read.format(a.format).load(a.documents)
        if "download_date" not in docs.columns:
            docs = docs.withColumn("download_date", india_date(F.lit(now)).cast("string"))
        lines = [json.dumps(maintenance.run(store, docs, now, embed=_embed(a.embedder) if a.embedder else None), sort_keys=True)]
    else:
        archive = (a.folder, a.archive, int(now.timestamp())) if a.archive and a.folder else None
        with store.lock():
            lines = [json.dumps(maintenance.expire(store, spark.read.parquet(a.active), a.apply, a.force, archive), sort_keys=True)]
    for line in lines:
        print(line)
    return lines


if __name__ == "__main__":
    main()
