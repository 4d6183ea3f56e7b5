"""How far the sources of a language are apart in their use of words.

A term is a run of letters and non-ASCII characters, A-Z lower-cased; a language keeps
the terms that at least MIN_DOCS of its documents hold. Every group (language, source)
and every language as a whole gives each kept term a smoothed share p in parts of SCALE,
and two shares lie (p - q)^2 / (p + q) apart, rounded down. For two sources these
distances are summed over all kept terms, by inclusion and exclusion over the
terms that each of them uses:

1. What a source's terms cost against a source without them depends on their counts
   only: a histogram of counts for each group prices them, whatever the vocabulary.
2. Terms that both use were priced twice as one-sided; a join of the postings (the terms
   that a group uses) by language and term puts the true distance in their place.
3. All other terms are zero on both sides and cost the same constant each.

So work grows with the postings and with the pairs of sources that a term has, not with
groups times vocabulary.

Terms are counted inside tasks (a task holds at most HELD terms or HELD_BYTES of text and
the text at hand), so a frequent term or a source with a third of all rows gives one row a task and
group. Only these counts are shuffled, once, by language and term.

Defined results: null text, lang and source mean ''. Rows that share a doc_id are one
document of a language, rows without one are documents of their own; occurrences count by row.
Groups without kept terms have shares too; without any kept term in the language, distances
are 0. Extra columns are ignored. An empty table gives no rows. Counts beyond 64 bits aren't provided for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import BROADCAST_ROWS, UPPER, ascii_lower, scratch, small, spread_join, stash

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
HELD, HELD_BYTES, ROWS = 300_000, 64 << 20, 50_000
#: Bytes of group names up to which the table of groups is broadcast.
GROUP_BYTES = 8 << 20
#: For UTF-8 bytes: letters lower-cased, bytes of other characters as they are, everything else a space.
_LETTERS = bytes(c + 32 if chr(c) in UPPER else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term and documents that hold it, by language and source."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    terms = size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            names = list(n)
            for s in range(0, len(names), ROWS):
                part = names[s : s + ROWS]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string())]
                yield pa.record_batch([*columns, *(pa.array([c[t] for t in part], pa.int64()) for c in (n, docs))], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        columns = [batch.column(c) for c in ("lang", "source", "alone")]
        for lang, source, alone, text in zip(*(c.to_pylist() for c in columns), batch.column("text").cast(pa.binary()), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            whole, before = text.as_py(), len(n)
            words = whole.translate(_LETTERS).split()
            n.update(words)
            if alone:
                docs.update(set(words))
            terms, size = terms + len(n) - before, size + len(whole)
            if terms > HELD or size > HELD_BYTES:
                yield from rows()
                held.clear()
                terms = size = 0
    yield from rows()


def _documents(docs: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), name("lang"), name("source"), name("text"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): parts of the counts, as tasks made them; to be summed."""
    rows = _documents(docs)
    repeated = stash(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several")), "repeated-ids")
    many = repeated.count()
    if not many:
        marked = rows.withColumn("alone", F.lit(True))
        return marked.select("lang", "source", "text", "alone").mapInArrow(_count, _COUNTS)
    joined = rows.join(small(repeated, many), "doc_id", "left") if many <= BROADCAST_ROWS else spread_join(rows, repeated, "doc_id", "left")
    counts = joined.select("lang", "source", "text", F.col("several").isNull().alias("alone")).mapInArrow(_count, _COUNTS)
    # Terms of rows that share a doc_id are made distinct over these rows; which source they stand for doesn't matter.
    held = joined.where("several").select("lang", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))).alias("term"))
    more = held.distinct().groupBy("lang", "term").agg(F.count("*").alias("docs"))
    return counts.unionByName(more.select("lang", F.lit(None).cast("string").alias("source"), "term", F.lit(0).cast("long").alias("n"), "docs"))


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total, head): the kept terms that each group uses, their count there and in the language; head marks one row a term."""
    term = Window.partitionBy("lang", "term")
    spread = term_counts(docs).repartition("lang", "term")
    # A term has at most one row for each source of its language from here on.
    summed = spread.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    known = summed.withColumn("total", F.sum("n").over(term)).withColumn("df", F.sum("docs").over(term)).withColumn("at", F.row_number().over(term.orderBy(F.col("source").asc_nulls_last())))
    return known.where((F.col("df") >= min_docs) & F.col("source").isNotNull()).select("lang", "source", "term", "n", "total", (F.col("at") == 1).alias("head"))


def _share(count: Column, words: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (words + 2 * terms)), exactly; null without terms."""
    whole = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(terms > 0, F.call_function("div", whole, (words + 2 * terms).cast("decimal(20,0)")) + 1)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _fitting(groups: DataFrame) -> DataFrame:
    rows, size = groups.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source")), F.lit(0))).first()
    return F.broadcast(groups) if rows <= BROADCAST_ROWS and size <= GROUP_BYTES else groups


def group_shares(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, words, used, terms, all_words, zero) for each group: its kept words and terms, its language's terms and words, its share of a term it doesn't use."""
    groups = _documents(docs).select("lang", "source").distinct()
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("*").alias("used"))
    # A term's head carries its language's counts: one row of it, whatever the number of sources.
    langs = found.where("head").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all_words"))
    nothing = F.lit(0).cast("long")
    out = groups.join(own, ["lang", "source"], "left").join(F.broadcast(langs) if langs.count() <= BROADCAST_ROWS else langs, "lang", "left")
    out = out.select("lang", "source", *[F.coalesce(c, nothing).alias(c) for c in ("words", "used", "terms", "all_words")])
    return out.withColumn("zero", _share(nothing, F.col("words"), F.col("terms")))


def _pairs(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): each two sources of a language, both ways."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), F.col("used").alias("other_used"))
    key = ["lang", F.least("source", "other").alias("low"), F.greatest("source", "other").alias("high")]
    value = lambda v: F.coalesce(v, F.lit(0)).cast("long").alias("value")
    # All terms as if neither used them, less those that either uses; terms of both are given back below.
    neither = F.col("terms") - F.col("used") - F.col("other_used")
    constants = groups.join(other, "lang").where("source < other").select(*key, value(neither * _apart(F.col("zero"), F.col("other_zero"))))
    histogram = found.groupBy("lang", "source", "n").agg(F.count("*").alias("same"))
    priced = histogram.join(groups, ["lang", "source"]).select("lang", "source", "same", _share(F.col("n"), F.col("words"), F.col("terms")).alias("p"))
    one_sided = priced.join(other, "lang").where("source <> other").select(*key, value(F.col("same") * _apart(F.col("p"), F.col("other_zero"))))
    left = found.select("lang", "term", "source", "p", "zero")
    right = left.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("zero").alias("other_zero"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "zero", "other_zero"))
    both = left.join(right, ["lang", "term"]).where("source < other").select(*key, value(_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)))
    summed = constants.unionByName(one_sided).unionByName(both).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item"))))
    return summed.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = rows.withColumn("rank", rank)
    # A limit on the rank is applied inside each task before rows of a group meet.
    out = out.where(F.col("rank") <= most) if most else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(doc_id, text, lang, source).

    part ``pair``: how far each other source of the language is, all of them; part ``term``: the ``top`` kept terms that
    the group uses more than its language does, by distance.
    """
    from lakeseek.llm.common import ship

    ship(docs.sparkSession)
    with scratch() as keep:
        raw = stash(postings(docs, min_docs), "postings")
        groups = _fitting(stash(group_shares(docs, raw), "groups"))
        every = raw.join(groups, ["lang", "source"])
        priced = every.select("lang", "source", "term", "n", _share(F.col("n"), F.col("words"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("all_words"), F.col("terms")).alias("q"), "zero")
        found = stash(priced, "shares")
        terms = found.where("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
        return keep(_ranked(_pairs(found, groups), "pair").unionByName(_ranked(terms, "term", top)), "divergence")
