"""Line de-duplication with native functions only.

Lines are exploded as hashes of their normalised form, distinct documents are
counted per hash, and lines whose hash reaches the threshold are dropped from
every document; what stays is put together again by position.  The text itself
is normalised once and shuffled at most once: the table of line hashes, written
to the shared folder, serves both the count and the look-up.  A row's hashes are
made distinct in place, and those of rows that share a doc_id are made distinct
together, so each document enters a count once; the sum is
pre-aggregated on the map side whatever the line's frequency, and the few hashes that
very many lines have are looked up without moving those lines.

Defined results: a null or empty text is one empty line; rows that share a doc_id are
one document, each row without a doc_id is one of its own; every row comes back once.
Extra columns are kept by ``drop_lines``, whatever their names. An empty table gives no rows.
Hashes have 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import BROADCAST_ROWS, ascii_lower, discard, small, spread_join, stash, strip_spaces

MIN_DOCS, MIN_CHARS = 10, 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key_hash(line: Column, min_chars: int) -> Column:
    """Hash of a line's key; null for keys of fewer code points than min_chars."""
    key = ascii_lower(strip_spaces(line))
    return F.when(F.char_length(key) >= min_chars, F.xxhash64(key))


def dropped_positions(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, drop): places of the lines to drop, for each row that has some."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = stash(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(text).alias("text_key"),
            F.transform(_lines(text), lambda line: _key_hash(line, min_chars)).alias("keys"),
        ),
        "line-hashes",
    )
    # Only rows that share their doc_id with others need a comparison across rows.
    ids = hashes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = stash(ids, "repeated-ids")
    n_repeated = repeated.count()
    lines = lambda rows: rows.select("doc_id", F.explode_outer(F.array_distinct("keys")).alias("key")).where("key is not null")
    if n_repeated:
        several = lines(hashes.join(small(repeated, n_repeated), "doc_id", "left_semi")).distinct()
        found = lines(hashes.join(small(repeated, n_repeated), "doc_id", "left_anti")).unionByName(several)
    else:
        found = lines(hashes)
    counts = found.groupBy("key").agg(F.count("*").alias("docs"))
    hot = stash(counts.where(F.col("docs") >= min_docs).select("key", F.lit(True).alias("hot")), "hot-lines")
    n_hot = hot.count()
    placed = hashes.select("doc_id", "text_key", F.posexplode("keys").alias("place", "key"))
    places = placed.join(F.broadcast(hot), "key") if n_hot <= BROADCAST_ROWS else spread_join(placed, hot, "key")
    # Equal rows give equal places: a set, not a list.
    dropped = stash(places.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("drop")), "dropped-lines")
    discard(hashes, hot, repeated)
    return dropped


def _apply(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(row, text, kept, n_dropped) of docs: the whole row, its text without nulls, and what is left of it."""
    right = found.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "text_key", "drop")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # The rows travel as one struct, so that no column of theirs can clash.
    left = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        text.alias("text"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("id"),
        docs["doc_id"].cast("long").isNull().alias("none"),
        F.xxhash64(text).alias("text_key"),
    )
    # One shuffle of the texts at every size; hashing the few places spares sorting the texts.
    joined = left.join(right.hint("shuffle_hash"), ["id", "none", "text_key"], "left")
    # A map finds a place at once, however many lines go.
    gone = F.map_from_arrays("drop", "drop")
    kept = F.array_join(F.filter(_lines(F.col("text")), lambda _, i: F.try_element_at(F.col("gone"), i).isNull()), "\n")
    return joined.withColumn("gone", gone).select(
        "row", "text", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("kept"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped")
    )


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs with repeated lines gone from text; other columns stay, null texts stay null."""
    out = _apply(docs, dropped_positions(docs, min_docs, min_chars))
    text = F.when(F.col("row")["text"].isNotNull(), F.col("kept"))
    return out.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _apply(docs, dropped_positions(docs, min_docs, min_chars))
    return out.select(F.col("row")["doc_id"].alias("doc_id"), F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
