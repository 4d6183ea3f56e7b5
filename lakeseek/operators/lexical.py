"""Inverted index and BM25.

Postings hold one row for each (term, chunk) with the term's places in title and
text and the chunk's length, so a search reads only the rows of its terms and
joins nothing.  They are made inside the row of a chunk: tokens come from the JVM and are
sorted by term in Arrow batches.  Each task sorts what it made and writes it, so nothing
is shuffled or written twice, every file holds the terms of its own chunks in order, and
the statistics of its pages prune it.

SegmentedIndex keeps an index current by immutable segments and deletion marks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.functions.text import index_tokens, is_bid_id, normalise, normalise_query, query_phrases, query_terms

K1, B, TITLE_WEIGHT, TEXT_WEIGHT, LEAST_IDF = 1.2, 0.75, 3.0, 1.0, 1e-6
#: Score of rows found by their exact id, before every other.
EXACT_SCORE = -1e12
#: Stands for a term where a chunk has its length; no token is empty.
NO_TERM = ""
STRONG, TITLE_FLOOR, TEXT_SHARE = 0.20, 0.85, 0.7
#: Tokens that a task numbers and sorts at once: some 30 MB.
PIECE = 1 << 18


def _tokens(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", index_tokens(F.col("title")).alias("a"), index_tokens(F.col("text")).alias("b"))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about PIECE tokens; a longer row is a piece of its own."""
    tokens = sum(np.diff(batch.column(c).offsets.to_numpy()).astype(np.int64) for c in ("a", "b"))
    before = np.cumsum(tokens) - tokens
    cuts = np.r_[0, 1 + np.flatnonzero(np.diff(before // PIECE)), batch.num_rows]
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield batch.slice(start, end - start)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk_id, a, b) of tokens as postings: the tokens of a piece are numbered and sorted by chunk, term, part and place. A batch has as many rows however long they are, so memory is bounded by pieces."""
    for batch in batches:
        for piece in _pieces(batch) if batch.num_rows else ():
            yield from _posted(piece)


def _posted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    parts = [batch.column(c) for c in ("a", "b")]
    sizes = [np.diff(c.offsets.to_numpy()) for c in parts]
    owner = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in sizes])
    place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
    part = np.repeat([0, 1], [n.sum() for n in sizes])
    words = pa.concat_arrays([c.flatten() for c in parts]).dictionary_encode()
    code = words.indices.to_numpy()
    order = np.lexsort((place, part, code, owner))
    owner, code, part, place = owner[order], code[order], part[order], place[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])]) if len(order) else np.zeros(0, int)

    def lists(which: int, part: np.ndarray = part, place: np.ndarray = place, first: np.ndarray = first) -> pa.Array:
        mine = part == which
        ends = np.r_[0, np.cumsum(mine)]
        return pa.ListArray.from_arrays(pa.array(np.r_[ends[first], ends[-1]].astype(np.int32)), pa.array(place[mine].astype(np.int32)))

    length = (sizes[0] + sizes[1])[owner[first]].astype(np.int32)
    columns = [words.dictionary.take(pa.array(code[first])), batch.column("chunk_id").take(pa.array(owner[first])), lists(0), lists(1), pa.array(length)]
    names = ["term", "chunk_id", "title_at", "text_at", "length"]
    yield pa.record_batch(columns, names)
    nothing = pa.array([None] * batch.num_rows, pa.list_(pa.int32()))
    yield pa.record_batch([pa.array([NO_TERM] * batch.num_rows), batch.column("chunk_id"), nothing, nothing, pa.array((sizes[0] + sizes[1]).astype(np.int32))], names)


def _made(chunks: DataFrame) -> DataFrame:
    """Postings of chunks(chunk_id, title, text), each chunk once, and a row of NO_TERM with each chunk's length."""
    key = chunks.schema["chunk_id"].dataType.simpleString()
    return _tokens(chunks).mapInArrow(_post, f"term string, chunk_id {key}, title_at array<int>, text_at array<int>, length int")


def _terms(made: DataFrame) -> DataFrame:
    return made.where(F.col("term") != NO_TERM)


def _lengths(made: DataFrame) -> DataFrame:
    return made.where(F.col("term") == NO_TERM).select("chunk_id", "length")


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, title_at, text_at, length) of chunks(chunk_id, title, text), each chunk once."""
    return _terms(_made(chunks))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """(chunk_id, length) of every chunk, also of those without a token."""
    return _tokens(chunks).select("chunk_id", (F.size("a") + F.size("b")).alias("length"))


def _stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row (n, avgdl): chunks, and their mean length in tokens."""
    return _stats(chunk_lengths(chunks))


@dataclass(frozen=True)
class LexicalIndex:
    """Handle on the index tables; version: of the chunks they were made from; lengths(chunk_id, length) has every chunk."""

    postings: DataFrame
    stats: DataFrame
    version: str = ""
    lengths: DataFrame | None = None
    made: DataFrame | None = None

    @classmethod
    def build(cls, chunks: DataFrame, version: str = "") -> LexicalIndex:
        return cls.of(_made(chunks), version)

    @classmethod
    def of(cls, made: DataFrame, version: str = "") -> LexicalIndex:
        """From postings with the rows of NO_TERM among them."""
        lengths = _lengths(made)
        return cls(_terms(made), _stats(lengths), version, lengths, made)

    @classmethod
    def load(cls, spark, path: str) -> LexicalIndex:
        state = spark.read.json(f"{path}/state").first()
        return cls(_terms(spark.read.parquet(f"{path}/postings")), spark.read.parquet(f"{path}/stats"), state["version"], spark.read.parquet(f"{path}/lengths"))

    def save(self, path: str) -> None:
        """Files in term order, state last: a reader that finds a state finds the tables. Postings are made once; lengths and statistics come from what is written then."""
        spark = self.postings.sparkSession
        none = F.lit(None).cast("array<int>")
        lengths = self.lengths.select(F.lit(NO_TERM).alias("term"), "chunk_id", none.alias("title_at"), none.alias("text_at"), "length")
        _save(self.postings.unionByName(lengths) if self.made is None else self.made, path)
        _stats(spark.read.parquet(f"{path}/lengths")).write.mode("overwrite").parquet(f"{path}/stats")
        spark.createDataFrame([(self.version,)], "version string").write.mode("overwrite").json(f"{path}/state")

    def add(self, chunks: DataFrame, version: str = "", replace: bool = True) -> LexicalIndex:
        """The index with chunks(chunk_id, title, text) added: only their postings are made; with replace, those that their ids had go first."""
        base = self.remove(chunks.select("chunk_id")) if replace else self
        lengths = base.lengths.unionByName(chunk_lengths(chunks))
        return LexicalIndex(base.postings.unionByName(postings(chunks)), _stats(lengths), version, lengths)

    def remove(self, ids: DataFrame, version: str = "") -> LexicalIndex:
        """The index without the chunks in ids(chunk_id)."""
        gone = ids.select("chunk_id").distinct()
        lengths = self.lengths.join(gone, "chunk_id", "left_anti")
        return LexicalIndex(self.postings.join(gone, "chunk_id", "left_anti").select(*self.postings.columns), _stats(lengths), version, lengths)

    def current(self, version: str) -> bool:
        return self.version == version

    def document_frequency(self) -> DataFrame:
        """(term, df): chunks with the term in title or text."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))


def _save(made: DataFrame, path: str, hashes: DataFrame | None = None) -> None:
    """Tables of postings, each file sorted by term and with the rows of NO_TERM first, and of lengths, with hashes(chunk_id, hash) if given. Ranges of term over all files would take the postings through a shuffle, several times what they take here."""
    made.sortWithinPartitions("term", "chunk_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    lengths = _lengths(made.sparkSession.read.schema(made.schema).parquet(f"{path}/postings"))
    lengths = lengths if hashes is None else lengths.join(hashes, "chunk_id")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


if TYPE_CHECKING:
    from lakeseek.sources.store import Store

#: Segments of one size class (powers of TIER in chunks) that are merged into one, and the share of deleted chunks at which all are.
TIER, MERGE, DEAD = 4, 4, 0.5


class SegmentedIndex:
    """An index in a store that follows its chunks without being rebuilt.

    A segment has the postings and the lengths of the chunks that were new when it was made, and is never changed. Chunks that go
    are marked in a table of (segment, chunk_id). Segments of one size class are merged once there are MERGE of them, so each posting is
    written about once a size class; merging drops what is marked. One state names segments, marks and statistics, so
    readers see all of an update or nothing; number of chunks and tokens are sums over what was added and marked, and exact.
    """

    def __init__(self, store: Store, name: str = "index-segments") -> None:
        self.store, self.name, self.spark = store, name, store.spark

    def state(self) -> dict[str, Any]:
        return {"segments": [], "deleted": [], "n": 0, "total": 0, "earlier": []} | self.store.state(self.name)

    def _path(self, part: str, kind: str = "") -> str:
        return f"{self.store.base}/index/{part}" + (f"/{kind}" if kind else "")

    def _rows(self, state: dict[str, Any], kind: str, ids: list[str] | None = None) -> DataFrame | None:
        """What is alive of the segments' postings or lengths, with the segment."""
        ids = [s["id"] for s in state["segments"]] if ids is None else ids
        if not ids:
            return None
        # A column of its own for each folder: a segment's rows don't say where they are.
        parts = [self.spark.read.parquet(self._path(i, kind)).withColumn("segment", F.lit(i)) for i in ids]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = _terms(rows) if kind == "postings" else rows
        if not state["deleted"]:
            return rows
        dead = self.spark.read.parquet(*[self._path(d) for d in state["deleted"]])
        return rows.join(dead, ["segment", "chunk_id"], "left_anti")

    def load(self) -> LexicalIndex:
        """The index as it is now."""
        state = self.state()
        rows, lengths = (self._rows(state, kind) for kind in ("postings", "lengths"))
        if rows is None:
            raise ValueError("the index has no segments")
        n, total = state["n"], state["total"]
        stats = self.spark.createDataFrame([(n, total / n if n else None)], "n long, avgdl double")
        return LexicalIndex(rows.select("term", "chunk_id", "title_at", "text_at", "length"), stats, "", lengths.select("chunk_id", "length"))

    def _write(self, made: DataFrame, hashes: DataFrame) -> dict[str, Any]:
        segment = uuid.uuid4().hex
        _save(made, self._path(segment), hashes)
        n, total = self.spark.read.parquet(self._path(segment, "lengths")).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return {"id": segment, "n": n, "total": total}

    def _commit(self, state: dict[str, Any]) -> None:
        old = self.state()
        used = [*[s["id"] for s in state["segments"]], *state["deleted"]]
        before = [*[s["id"] for s in old["segments"]], *old["deleted"]]
        self.store.set_state(self.name, **(state | {"earlier": before}))
        for part in set(old["earlier"]) - set(used) - set(before):
            self.store.remove(f"index/{part}")

    def synchronise(self, chunks: DataFrame) -> dict[str, int]:
        """Follow chunks(chunk_id, title, text[, hash]), each once: a segment for those that are new or have another hash, marks for those that are gone; says how many."""
        key = ["chunk_id", "hash"]
        chunks = chunks.select("chunk_id", "title", "text", "hash" if "hash" in chunks.columns else F.md5(F.concat_ws("\n", "title", "text")).alias("hash"))
        state = self.state()
        alive = self._rows(state, "lengths")
        lost, new = {"k": 0, "total": 0}, chunks
        if alive is not None:
            new = chunks.join(alive.select(*key), key, "left_anti")
            marks = alive.join(chunks.select(*key), key, "left_anti").select("segment", "chunk_id", "length")
            folder = f"deleted-{uuid.uuid4().hex}"
            marks.write.parquet(self._path(folder))
            lost = self.spark.read.parquet(self._path(folder)).agg(F.count("*").alias("k"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first().asDict()
            if lost["k"]:
                state["deleted"] = [*state["deleted"], folder]
            else:
                self.store.remove(f"index/{folder}")
        made = self._write(_made(new), new.select(*key))
        if made["n"]:
            state["segments"] = [*state["segments"], made]
        else:
            self.store.remove(f"index/{made['id']}")
        state |= {"n": state["n"] + made["n"] - lost["k"], "total": state["total"] + made["total"] - lost["total"]}
        self._commit(self._merged(state))
        return {"added": made["n"], "deleted": lost["k"]}

    def _merged(self, state: dict[str, Any]) -> dict[str, Any]:
        """The state after what merging is due."""
        while True:
            whole = sum(s["n"] for s in state["segments"])
            tiers: dict[int, list[str]] = {}
            for s in state["segments"]:
                tiers.setdefault(int(np.log(max(s["n"], 1)) / np.log(TIER)), []).append(s["id"])
            due = next((ids for _, ids in sorted(tiers.items()) if len(ids) >= MERGE), None)
            everything = whole and 1 - state["n"] / whole > DEAD
            if due is None and not everything:
                return self._marks_joined(state)
            ids = [s["id"] for s in state["segments"]] if everything else due
            lengths, none = self._rows(state, "lengths", ids), F.lit(None).cast("array<int>")
            rows = self._rows(state, "postings", ids).drop("segment")
            rows = rows.unionByName(lengths.select(F.lit(NO_TERM).alias("term"), "chunk_id", none.alias("title_at"), none.alias("text_at"), "length"))
            one = self._write(rows, lengths.select("chunk_id", "hash"))
            rest = [s for s in state["segments"] if s["id"] not in ids]
            state = state | {"segments": [*rest, *([one] if one["n"] else [])]}
            if not rest:
                state["deleted"] = []


    def _marks_joined(self, state: dict[str, Any]) -> dict[str, Any]:
        """Few folders of marks: MERGE of them become one, without marks in segments that are no more."""
        if len(state["deleted"]) < MERGE:
            return state
        live = F.col("segment").isin([s["id"] for s in state["segments"]])
        folder = f"deleted-{uuid.uuid4().hex}"
        self.spark.read.parquet(*[self._path(d) for d in state["deleted"]]).where(live).write.parquet(self._path(folder))
        return state | {"deleted": [folder]}


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda i: i - by)


def _phrase_count(phrase: list[str], part: str) -> Column:
    """How often a phrase's tokens stand next to each other, from the map m of a chunk's postings."""
    place = lambda t: F.coalesce(F.try_element_at("m", F.lit(t))[part], F.array().cast("array<int>"))
    if len(phrase) == 1:
        return F.size(place(phrase[0]))
    hits = place(phrase[0])
    for d, token in enumerate(phrase[1:], 1):
        hits = F.array_intersect(hits, _shifted(place(token), d))
    return F.size(hits)


def bm25(index: LexicalIndex, phrases: list[list[str]], title_weight: float = TITLE_WEIGHT, text_weight: float = TEXT_WEIGHT) -> DataFrame:
    """(chunk_id, score) of every chunk with a phrase; the smaller (more negative) the better. Repeated phrases count again."""
    terms = sorted({t for p in phrases for t in p})
    kinds = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    rows = index.postings.where(F.col("term").isin(*terms) if terms else F.lit(False))
    found = rows.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("title_at", "text_at")))).alias("m"), F.first("length").alias("length"))
    counts = [F.struct(_phrase_count(p, "title_at").alias("a"), _phrase_count(p, "text_at").alias("b")) for p in kinds]
    counted = found.select("chunk_id", "length", *[c.alias(f"p{i}") for i, c in enumerate(counts)])
    any_hit = F.lit(False)
    for i in range(len(kinds)):
        any_hit = any_hit | (F.col(f"p{i}.a") + F.col(f"p{i}.b") > 0)
    counted = counted.where(any_hit)
    df = counted.agg(*[F.count_if(F.col(f"p{i}.a") + F.col(f"p{i}.b") > 0).alias(f"n{i}") for i in range(len(kinds))] or [F.count("*").alias("none")])
    # Two one-row aggregates.
    rows = counted.crossJoin(F.broadcast(df)).crossJoin(F.broadcast(index.stats))
    score = F.lit(0.0)
    for phrase in phrases:
        i = kinds.index(list(phrase))
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        f = title_weight * F.col(f"p{i}.a") + text_weight * F.col(f"p{i}.b")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    return rows.select("chunk_id", (-score).alias("score"))


def search(index: LexicalIndex, chunks: DataFrame, query: str, limit: int | None, condition: Column | None = None, id_column: str | None = None, mode: str = "post") -> DataFrame:
    """chunks columns with score and lexical_rank: the best of query. mode "post" filters the best 25 x limit, "pre" filters first. A query that is an exact id adds the rows with it, before all others. Without a limit every hit is returned, in no order."""
    best = bm25(index, query_phrases(query))
    if mode == "pre" and condition is not None:
        best = best.join(chunks.where(condition).select("chunk_id"), "chunk_id", "left_semi")
    if limit is not None:
        best = best.orderBy("score", "chunk_id").limit(max(25 * limit, 250))
    if id_column and is_bid_id(query):
        exact = chunks.where(F.lower(F.col(id_column)) == query.strip().lower()).select("chunk_id", F.lit(EXACT_SCORE).alias("score"))
        best = best.unionByName(exact).groupBy("chunk_id").agg(F.min("score").alias("score"))
    rows = chunks.join(best, "chunk_id")
    if condition is not None:
        rows = rows.where(condition)
    return rows if limit is None else rows.orderBy("score", "chunk_id").limit(limit)


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def term_weights(index: LexicalIndex, terms: list[str]) -> DataFrame:
    """One row with an array w: the idf of each distinct term, in order; df counts title and text."""
    distinct = list(dict.fromkeys(terms))
    rows = index.postings.where(F.col("term").isin(*distinct) if distinct else F.lit(False))
    df = rows.agg(F.array(*[F.count_if(F.col("term") == t) for t in distinct] or [F.lit(0).cast("long")]).alias("df"))
    return df.crossJoin(F.broadcast(index.stats)).select(F.transform("df", lambda x: idf(F.col("n"), x)).alias("w"))


def match_quality(hits: DataFrame, query: str, weights: DataFrame, id_column: str | None = None) -> DataFrame:
    """hits(title, text, ...) with quality from 0 to 1: how much of the query's weight a hit's title and text cover."""
    if is_bid_id(query):
        same = F.lower(F.col(id_column)) == query.strip().lower() if id_column else F.lit(False)
        return hits.withColumn("quality", F.when(same, 1.0).otherwise(0.0))
    terms = query_terms(query)
    if not terms:
        return hits.withColumn("quality", F.lit(0.0))
    distinct = list(dict.fromkeys(terms))
    rows = hits.crossJoin(F.broadcast(weights)).withColumns({"_text": normalise(F.col("text")), "_title": normalise(F.col("title"))})
    rows = rows.withColumns({"_in_text": F.split("_text", " "), "_in_title": F.split("_title", " ")})
    w = [F.get("w", F.lit(i)) for i in range(len(distinct))]
    total = sum(w[1:], w[0])
    covered = lambda c: sum((F.when(F.array_contains(c, t), w[i]).otherwise(0.0) for i, t in enumerate(distinct)), F.lit(0.0))
    rows = rows.withColumns({"_total": total, "_text_w": covered("_in_text"), "_title_w": covered("_in_title")})
    top = F.lit(False)
    for i, t in enumerate(distinct):
        first_best = F.lit(True)
        for j in range(len(distinct)):
            first_best = first_best & (w[i] > w[j] if j < i else w[i] >= w[j])
        top = top | (first_best & F.array_contains("_in_title", t))
    title, text_ = F.col("_title_w") / F.col("_total"), F.col("_text_w") / F.col("_total")
    quality = F.when(F.contains("_text", F.lit(normalise_query(query))), 1.0)
    if len(terms) >= 3:
        quality = quality.when((F.col("_text_w") < 0.5 * F.col("_total")) & (F.col("_title_w") == 0), 0.0)
    quality = quality.when((title >= 0.5) & top, F.greatest(F.lit(TITLE_FLOOR), title)).when(title >= 0.5, title).otherwise(F.greatest(title, TEXT_SHARE * text_))
    return rows.withColumn("quality", quality).drop("w", "_text", "_title", "_in_text", "_in_title", "_total", "_text_w", "_title_w")
