"""Substring de-duplication by a Relative Lempel-Ziv parse against indexed reference blocks.

The corpus is its own reference.  A *block* is the run of words that belongs to
one content-defined anchor (the smallest 16-word hash of a 50-word window): it
spans every window that has the anchor, so equal passages are cut into equal
blocks wherever they stand.  The index maps the hash of a block to the first
place that holds it, and every document is parsed against the whole index:

1. each block of a document that an earlier document also holds is copied whole;
2. where a factor ends, the block shares its anchor with other blocks but not
   all its words.  There, and only there, every window is looked up by itself,
   so no window that straddles a boundary is missed;
3. consecutive copies from consecutive places of one source join into a factor.

Hot passages are safe: both look-ups are pre-aggregated minima by hash, never
lists, so a passage that a third of all documents hold costs one row per place.
Block and window hashes have 128 bits.

Defined results: null or blank texts have no words; texts of fewer words than a
window lose nothing; rows that share a doc_id don't copy from each other, and
each is parsed by itself; rows without a doc_id keep all words and are no
source. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import discard, ship, stash
from lakeseek.llm.kernels import U64, Words, span_hashes, sliding_argmin, text_slices

WINDOW, ANCHOR = 50, 16
_BLOCKS = "doc_id long, text_key long, anchor long, h1 long, h2 long, start int, windows int"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _hashes(words: Words) -> list[np.ndarray]:
    return [words.hashes(False, seed) for seed in (0, 1)]


def _blocks(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in text_slices(batch, "text"):
                values = _hashes(words)
                n = len(words.starts)
                if n < window:
                    continue
                grams = span_hashes(values[0], np.arange(n - anchor + 1), np.arange(anchor, n + 1))
                owner = np.repeat(np.arange(len(part)), np.diff(words.docs))
                place = sliding_argmin(grams, window - anchor + 1)
                starts = np.arange(n - window + 1)
                inside = np.flatnonzero(starts + window <= words.docs[1:][owner[: n - window + 1]])
                if not len(inside):
                    continue
                place, doc = place[inside], owner[inside]
                cut = np.ones(len(inside), bool)
                cut[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(cut)
                count = np.diff(np.append(first, len(inside)))
                begin = inside[first]
                end = begin + count - 1 + window
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(pa.array(doc[first])),
                        part.column("text_key").take(pa.array(doc[first])),
                        _signed(grams[place[first]]),
                        _signed(span_hashes(values[0], begin, end, 0)),
                        _signed(span_hashes(values[1], begin, end, 1)),
                        pa.array((begin - words.docs[doc[first]]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                    ],
                    ["doc_id", "text_key", "anchor", "h1", "h2", "start", "windows"],
                )

    return run


def _windows(window: int):
    """The hash of every window that starts in the listed runs of starts of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in text_slices(batch, "text"):
                values = _hashes(words)
                runs = part.column("runs")
                flat = runs.flatten()
                owner = np.repeat(np.arange(len(part)), runs.value_lengths().to_numpy(zero_copy_only=False))
                start, count = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                owner = np.repeat(owner, count)
                start = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                begin = words.docs[owner] + start
                keep = begin + window <= words.docs[owner + 1]
                begin, owner, start = begin[keep], owner[keep], start[keep]
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(pa.array(owner)),
                        part.column("text_key").take(pa.array(owner)),
                        _signed(span_hashes(values[0], begin, begin + window, 0)),
                        _signed(span_hashes(values[1], begin, begin + window, 1)),
                        pa.array(start.astype(np.int32)),
                    ],
                    ["doc_id", "text_key", "h1", "h2", "start"],
                )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """text_key tells rows of one doc_id with different texts apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _joined(runs: DataFrame) -> DataFrame:
    """Runs of one text that touch or overlap at one distance from one source, as single factors."""
    end = F.col("start") + F.col("windows")
    source = ["doc_id", "text_key", "ref_doc", "shift"]
    line = Window.partitionBy(*source).orderBy("start", "windows")
    # Dealt by text, as the spans of a text meet next.
    marked = runs.withColumn("shift", F.col("ref_start") - F.col("start")).repartition("doc_id", "text_key")
    marked = marked.withColumn("reach", F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("factor", F.count_if(F.col("reach").isNull() | (F.col("start") > F.col("reach"))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*source, "factor").agg(F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("windows"))
    return out.select("doc_id", "text_key", "start", "windows", "ref_doc", (F.col("start") + F.col("shift")).alias("ref_start"))


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_key, start, windows, ref_doc, ref_start): runs of window starts that copy from the smallest doc_id that holds them, joined as far as they go on in one source; ref_doc < doc_id."""
    ship(docs.sparkSession)
    texts = _texts(docs)
    key = ["doc_id", "text_key"]
    blocks = stash(texts.where("text is not null and doc_id is not null").mapInArrow(_blocks(window, anchor), _BLOCKS), "blocks")
    index = stash(
        blocks.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("ref"), F.min("anchor").alias("anchor"), F.max("doc_id").alias("last_doc")),
        "index",
    )
    # Boundaries: anchors that stand in more than one kind of block.
    split = index.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("split"))
    useful = (
        index.join(split, "anchor", "left")
        .where("last_doc > ref.doc_id or split")
        .select("h1", "h2", F.col("ref.doc_id").alias("ref_doc"), F.col("ref.start").alias("ref_start"), F.coalesce("split", F.lit(False)).alias("split"))
    )
    parsed = stash(
        blocks.join(useful, ["h1", "h2"]).where("doc_id > ref_doc or split").select(*key, "start", "windows", "ref_doc", "ref_start"),
        "parsed",
    )
    discard(blocks, index)
    whole = parsed.where("doc_id > ref_doc")
    runs = parsed.where("doc_id = ref_doc").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "windows"))).alias("runs"))
    places = stash(texts.join(runs, key).mapInArrow(_windows(window), "doc_id long, text_key long, h1 long, h2 long, start int"), "windows")
    homes = (
        places.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "start")).alias("ref"), F.max("doc_id").alias("last_doc"))
        .where("last_doc > ref.doc_id")
        .select("h1", "h2", F.col("ref.doc_id").alias("ref_doc"), F.col("ref.start").alias("ref_start"))
    )
    single = places.join(homes, ["h1", "h2"]).where("doc_id > ref_doc").select(*key, "start", F.lit(1).alias("windows"), "ref_doc", "ref_start")
    return _joined(whole.unionByName(single))


def _digest(window: int, texts_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("runs").to_pylist()
            rows, words_n, removed_n, digests, kept_texts = batch.column("doc_id"), [], [], [], []
            for text, found in zip(batch.column("text"), spans, strict=True):
                words = (text.as_py() or "").encode().split()
                kept = words
                if found:
                    drop = np.zeros(len(words) + 1, np.int32)
                    for run_ in found:
                        drop[run_["start"]] += 1
                        drop[min(run_["start"] + run_["windows"] - 1 + window, len(words))] -= 1
                    gone = np.cumsum(drop[:-1]) > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(kept)
                words_n.append(len(words))
                removed_n.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined.decode() if texts_out else None)
            yield pa.record_batch(
                [rows, pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts_out: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) per row of docs(doc_id, text): words outside every copied window, joined by one space."""
    found = factors(docs, window, anchor)
    runs = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    return _texts(docs).join(runs, ["doc_id", "text_key"], "left").mapInArrow(
        _digest(window, texts_out), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
