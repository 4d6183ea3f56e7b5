"""Full-text search for a table of queries: parsing, BM25, top-k and match quality as joins.

Queries are parsed by expressions. A phrase that many queries have is matched once: distinct phrases meet the
postings by term, and their document frequency follows from the matches. These are dealt out by
chunk, as numbers, and only there meet the queries that have the phrase, so that a chunk's
scores are added up where they are made and a common word of many queries moves once.
For the best k of each query a task reads its matches chunk by chunk and keeps k a query, so what
moves then doesn't grow with the chunks a task has. Larger tables of queries, and all scores, are joined and
grouped, in tasks of bounded chunks times queries.
Scores are compared by nine digits, so that the order in which they were added up doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions.text import BID_ID, fold, let, normalise, query_terms_column
from lakeseek.operators.lexical import B, EXACT_SCORE, K1, LEAST_IDF, TEXT_SHARE, TEXT_WEIGHT, TITLE_FLOOR, TITLE_WEIGHT, LexicalIndex, idf

DIGITS = 9
#: Rows of the table of queries' phrases up to which it is broadcast: some 20 MB.
PHRASES = 300_000
#: Rows (query, chunk) that a task scores at most, if every chunk is a hit of every query: some 150 MB.
SCORED = 1 << 19
#: Chunks of a task that keeps the best of each query: the more, the fewer tasks hand on k a query.
CHUNKS = 1 << 14
#: Rows (query, chunk) that a task keeps at most where it reads matches chunk by chunk, twice that while it compares: some 200 MB.
KEPT = 1 << 21
#: Parts of scores (a match, a query that has its phrase) that are added up at once: some 30 MB.
PARTS = 1 << 19
#: Hits up to which they are broadcast to where their texts are: some 10 MB.
HITS = 300_000


def phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, times) of queries(query_id, query): each run of word characters, dots and hyphens longer than one, as index tokens joined by a blank; times it occurs."""
    words = F.filter(F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(r"(?U)[\w.-]+"), F.lit(0)), lambda w: F.char_length(w) > 1)
    made = F.transform(words, lambda w: F.array_join(F.regexp_extract_all(fold(w), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "))
    return queries.select("query_id", F.explode(made).alias("phrase")).where("phrase <> ''").groupBy("query_id", "phrase").agg(F.count("*").alias("times"))


def matches(index: LexicalIndex, kinds: DataFrame, few: bool = False) -> DataFrame:
    """(phrase, chunk_id, length, a, b): how often chunks have each of kinds(phrase), each once, in title and text; chunks without it are left out. few: kinds can be broadcast, so that postings stay where they lie."""
    near = F.broadcast if few else lambda rows: rows
    tokens = kinds.select("phrase", F.split("phrase", " ").alias("tokens"))
    one = tokens.where(F.size("tokens") == 1).select("phrase", F.col("phrase").alias("term"))
    counts = lambda c: F.size(c).cast("long")
    single = index.postings.join(near(one), "term").select("phrase", "chunk_id", "length", counts("title_at").alias("a"), counts("text_at").alias("b"))
    each = tokens.where(F.size("tokens") > 1).select("phrase", F.size("tokens").alias("m"), F.posexplode("tokens").alias("d", "term"))
    met = index.postings.join(near(each), "term").groupBy("phrase", "chunk_id").agg(
        F.max("m").alias("m"), F.max("length").alias("length"), F.collect_list(F.struct("d", "title_at", "text_at")).alias("x")
    )

    def together(part: str) -> Column:
        """Places where all tokens stand next to each other: each token's places, moved back by its own, have to meet."""
        moved = F.transform("x", lambda t: F.transform(t[part], lambda i: i - t["d"]))
        return F.size(F.aggregate(F.slice(moved, 2, F.size(moved)), F.get(moved, F.lit(0)), lambda s, t: F.array_intersect(s, t))).cast("long")

    several = met.where(F.size("x") == F.col("m")).select("phrase", "chunk_id", "length", together("title_at").alias("a"), together("text_at").alias("b"))
    return single.unionByName(several.where("a + b > 0"))


def _weighed(index: LexicalIndex, kinds: DataFrame, few: bool, title_weight: float, text_weight: float) -> DataFrame:
    """(phrase, chunk_id, impact) of each match of kinds(phrase): what one occurrence in a query adds to the chunk's score."""
    found = matches(index, kinds, few)
    df = found.groupBy("phrase").agg(F.count("*").alias("df"))
    f = title_weight * F.col("a") + text_weight * F.col("b")
    rare = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = F.when(rare <= 0, LEAST_IDF).otherwise(rare) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    return found.join(F.broadcast(df) if few else df, "phrase").crossJoin(F.broadcast(index.stats)).select("phrase", "chunk_id", impact.alias("impact"))  # one row


def bm25(index: LexicalIndex, queries: DataFrame, title_weight: float = TITLE_WEIGHT, text_weight: float = TEXT_WEIGHT) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk with a phrase of a query; the smaller the better."""
    asked = phrases(queries)
    n_phrases, n_queries = asked.agg(F.count("*"), F.count_distinct("query_id")).first()
    weighed = _weighed(index, asked.select("phrase").distinct(), n_phrases <= PHRASES, title_weight, text_weight)
    if n_phrases <= PHRASES:
        # As many tasks as what the queries make of the matches needs: by the matches' own bytes few would get all.
        context = index.postings.sparkSession.sparkContext
        parts = max(context.defaultParallelism, -(-(index.stats.first()["n"] or 0) * n_queries // SCORED))
        weighed, asked = weighed.repartition(parts, "chunk_id"), F.broadcast(asked)
    return weighed.join(asked, "phrase").groupBy("query_id", "chunk_id").agg(F.round(-F.sum(F.col("impact") * F.col("times")), DIGITS).alias("score"))


def top(index: LexicalIndex, queries: DataFrame, k: int, title_weight: float = TITLE_WEIGHT, text_weight: float = TEXT_WEIGHT) -> DataFrame:
    """best() of bm25(): (query_id, chunk_id, score). Of queries whose phrases can be broadcast, these pass through the driver as a broadcast does; without a phrase among them there is no answer."""
    asked = phrases(queries)
    table = asked.limit(PHRASES + 1).toArrow()
    names = table.column("query_id").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    if table.num_rows > PHRASES or len(names.dictionary) * k > KEPT:
        return best(bm25(index, queries, title_weight, text_weight), k)
    words = table.column("phrase").combine_chunks().dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    spark, kind = index.postings.sparkSession, index.postings.schema["chunk_id"].dataType.simpleString()
    numbers = spark.createDataFrame(pa.table({"phrase": words.dictionary, "p": pa.array(range(len(words.dictionary)), pa.int32())}), "phrase string, p int")
    order = np.argsort(words.indices.to_numpy(), kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)))]
    added = _added(names.dictionary, ends, names.indices.to_numpy()[order], table.column("times").to_numpy()[order], k)
    weighed = _weighed(index, numbers.select("phrase"), True, title_weight, text_weight).join(F.broadcast(numbers), "phrase").select("chunk_id", "p", "impact")
    parts = max(spark.sparkContext.defaultParallelism, -(-(index.stats.first()["n"] or 0) // CHUNKS))
    found = weighed.repartition(parts, "chunk_id").sortWithinPartitions("chunk_id").mapInArrow(added, f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {kind}, score double")
    return best(found, k)


def _added(names: pa.Array, ends: np.ndarray, owners: np.ndarray, times: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of matches (chunk_id, p, impact) in the order of chunk_id the k best chunks of each query, smaller ids first among equals; phrase p occurs times[j] times in query owners[j], for j from ends[p] to ends[p + 1]."""
    n_queries, each = len(names), np.diff(ends)

    def scored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(query, chunk, score, ids): the rows of whole chunks, added up."""
        p = batch.column("p").to_numpy()
        starts = _starts(batch.column("chunk_id"))
        chunk = np.cumsum(np.bincount(starts, minlength=len(p))[: len(p)]) - 1
        n = each[p]
        at = np.repeat(ends[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(chunk, n) * n_queries + owners[at]
        part = np.repeat(batch.column("impact").to_numpy(), n) * times[at]
        cells = len(starts) * n_queries
        if cells <= 16 * len(cell):
            sums = np.bincount(cell, part, minlength=cells)
            used = np.flatnonzero(np.bincount(cell, minlength=cells))
            sums = sums[used]
        else:
            used, place = np.unique(cell, return_inverse=True)
            sums = np.bincount(place, part, minlength=len(used))
        score = -np.floor(sums * 10.0**DIGITS + 0.5) / 10.0**DIGITS
        return used % n_queries, used // n_queries, score, batch.column("chunk_id").take(pa.array(starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, score, place, ids, worst = np.zeros(0, int), np.zeros(0), np.zeros(0, int), None, np.full(n_queries, np.inf)
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

        def settle() -> None:
            """What waits is compared with what was kept; ids of what is left stay, in their order."""
            nonlocal query, score, place, ids
            if not waiting:
                return
            before = 0 if ids is None else len(ids)
            starts = np.cumsum([before, *[len(w[3]) for w in waiting]])
            query = np.concatenate([query, *[w[0] for w in waiting]])
            score = np.concatenate([score, *[w[2] for w in waiting]])
            place = np.concatenate([place, *[w[1] + s for w, s in zip(waiting, starts)]])
            ids = pa.concat_arrays([*([] if ids is None else [ids]), *[w[3] for w in waiting]])
            waiting.clear()
            order = np.lexsort((place, score, query))
            first = np.searchsorted(query[order], np.arange(n_queries))
            order = order[np.arange(len(order)) - first[query[order]] < k]
            query, score, place = query[order], score[order], place[order]
            full = np.bincount(query, minlength=n_queries) >= k
            last = np.searchsorted(query, np.arange(n_queries), "right") - 1
            worst[full] = score[last[full]]
            left, place = np.unique(place, return_inverse=True)
            ids = ids.take(pa.array(left))

        count = 0
        for batch in _whole_chunks(batches, each):
            q, c, x, own = scored(batch)
            # An equal score later has a larger id.
            some = x < worst[q]
            left, c = np.unique(c[some], return_inverse=True)
            waiting.append((q[some], c, x[some], own.take(pa.array(left))))
            count += int(some.sum())
            if count > max(PARTS, n_queries * k):
                settle()
                count = 0
        settle()
        if ids is not None:
            yield pa.record_batch([names.take(pa.array(query)), ids.take(pa.array(place)), pa.array(score)], ["query_id", "chunk_id", "score"])

    return run


def _starts(ids: pa.Array) -> np.ndarray:
    """Where another id begins, in an array with equal ids next to each other."""
    codes = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)


def _whole_chunks(batches: Iterator[pa.RecordBatch], each: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows in batches of whole chunks and about PARTS parts of scores; the parts of one chunk are at most the queries' phrases."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not rows.num_rows:
            continue
        starts = _starts(rows.column("chunk_id"))
        parts = np.cumsum(each[rows.column("p").to_numpy()])
        before = np.r_[0, parts][starts]
        cuts = starts[np.flatnonzero(np.diff(before // PARTS)) + 1].tolist()
        for a, b in zip([0, *cuts], [*cuts, int(starts[-1])]):
            if b > a:
                yield rows.slice(a, b - a)
        held = rows.slice(int(starts[-1]))
    if held is not None:
        yield held


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; a task keeps no more than these."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "chunk_id"))
    return scored.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def search(index: LexicalIndex, chunks: DataFrame, queries: DataFrame, limit: int, condition: Column | None = None, id_column: str | None = None) -> DataFrame:
    """(query_id, chunks columns, score): for each query the best ``limit`` that meet the condition, of its best 25 x limit; a query that is an exact id has the rows with it before all others."""
    found = top(index, queries, max(25 * limit, 250))
    if id_column:
        asked = queries.where(F.trim("query").rlike(f"(?i)^{BID_ID}$")).select("query_id", F.lower(F.trim("query")).alias("_id"))
        exact = chunks.join(asked, F.lower(F.col(id_column)) == F.col("_id")).select("query_id", "chunk_id", F.lit(EXACT_SCORE).alias("score"))
        found = found.unionByName(exact).groupBy("query_id", "chunk_id").agg(F.min("score").alias("score"))
    # Ranks first: texts are fetched for what is left.
    kept = found if condition is None else found.join(chunks.where(condition).select("chunk_id"), "chunk_id", "left_semi")
    return with_texts(best(kept, limit), chunks, queries, limit)


def with_texts(hits: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """hits(query_id, chunk_id, ...), at most limit for each of queries, with the columns of their chunks. Few are found at once and broadcast: chunks stay where they lie, and those that aren't hit meet nothing else."""
    if queries.count() * limit > HITS:
        return chunks.join(hits, "chunk_id")
    hits = hits.sparkSession.createDataFrame(hits.toArrow(), hits.schema)
    return chunks.join(F.broadcast(hits.select("chunk_id")), "chunk_id", "left_semi").join(F.broadcast(hits), "chunk_id")


def term_weights(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """(query_id, terms, n_terms, top, total): each distinct telling word of a query with its idf, in order; n_terms counts repeats; top is the first of the heaviest."""
    words = queries.select("query_id", query_terms_column(F.coalesce("query", F.lit(""))).alias("w"))
    each = words.select("query_id", F.size("w").alias("n_terms"), F.posexplode(F.array_distinct("w")).alias("at", "term"))
    terms = each.select("term").distinct()
    # Few are broadcast, so that postings stay where they lie.
    df = index.postings.join(F.broadcast(terms) if terms.count() <= PHRASES else terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighed = each.join(df, "term", "left").crossJoin(F.broadcast(index.stats)).select("query_id", "n_terms", "at", "term", idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("w"))
    # A query's own words only.
    listed = weighed.groupBy("query_id").agg(F.max("n_terms").alias("n_terms"), F.sort_array(F.collect_list(F.struct("at", "term", "w"))).alias("terms"), F.max_by("term", F.struct("w", -F.col("at"))).alias("top"))
    return listed.withColumn("total", F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["w"]))


def match_quality(hits: DataFrame, queries: DataFrame, weights: DataFrame, id_column: str | None = None) -> DataFrame:
    """hits(query_id, title, text, ...) with quality from 0 to 1, as lexical.match_quality has it for one query."""
    asked = queries.select("query_id", F.trim("query").alias("_query"), normalise(F.col("query")).alias("_norm"))
    rows = hits.join(asked, "query_id").join(weights, "query_id", "left")
    rows = rows.withColumns({"_text": normalise(F.col("text")), "_title": normalise(F.col("title"))})
    # The words are bound once: the optimiser would put their making into the inner function, and do it for each term.
    covered = lambda c: let(F.split(c, " "), lambda words: F.aggregate("terms", F.lit(0.0), lambda s, t: s + F.when(F.array_contains(words, t["term"]), t["w"]).otherwise(0.0)))
    rows = rows.withColumns({"_text_w": covered("_text"), "_title_w": covered("_title"), "_has_top": F.array_contains(F.split("_title", " "), F.col("top"))})
    title, share = F.col("_title_w") / F.col("total"), F.col("_text_w") / F.col("total")
    same = F.lower(F.col(id_column)) == F.lower("_query") if id_column else F.lit(False)
    quality = (
        F.when(F.col("_query").rlike(f"(?i)^{BID_ID}$"), F.when(same, 1.0).otherwise(0.0))
        .when(F.col("terms").isNull(), 0.0)
        .when(F.contains("_text", "_norm"), 1.0)
        .when((F.col("n_terms") >= 3) & (F.col("_text_w") < 0.5 * F.col("total")) & (F.col("_title_w") == 0), 0.0)
        .when((title >= 0.5) & F.col("_has_top"), F.greatest(F.lit(TITLE_FLOOR), title))
        .when(title >= 0.5, title)
        .otherwise(F.greatest(title, TEXT_SHARE * share))
    )
    return rows.withColumn("quality", quality).select(*hits.columns, "quality")
