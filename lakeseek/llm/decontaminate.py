"""Benchmark decontamination with native functions only.

A document is contaminated by an item if it holds at least 80 % of the item's
distinct five-word shingles (words split at ASCII white space, A-Z lower-cased;
a text of fewer words is one shingle).

Items are partitioned by size into powers of two.  An item's MinHash sketch is
its smallest shingle hashes under one hash order; how many is set by its
partition, at the partition's upper size u: u - ceil(0.8 u) + 1.  An item of q
shingles that a document holds to 80 % misses at most q - ceil(0.8 q) of them,
so at least one sketch entry is in the document, however long that is: the
search loses nothing, and Jaccard's bias against long documents plays no part.
Documents with fewer shingles than 80 % of the partition's lower size are not
probed against it.  Candidates are verified by exact containment of shingle
texts, so hash collisions can't add a link.

Only the sketch table is joined with the shingles of the corpus, in blocks of
PROBE_ROWS that are broadcast one by one, so shingles never move and none is a hot
key: a passage that a third of all documents hold gives one candidate row a
document.  Items are sketched and documents probe with all their shingles, as a
short item's sketch has to be found in a long document.

Defined results: null or blank texts have no shingles, and neither hold nor are
held; repeated rows and items give each pair once; rows without a doc_id are
left alone. Extra columns are ignored. Without benchmark rows nothing is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import ascii_lower, scratch, small, spread_join, stash, strip_spaces

SHINGLE, PERCENT = 5, 80
#: Rows of the sketch table, and bytes of item texts, up to which they are broadcast at once.
PROBE_ROWS, ITEM_BYTES = 200_000, 4 << 20


def _words(text: Column) -> Column:
    clean = strip_spaces(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(F.octet_length(clean) > 0, F.split(ascii_lower(clean), r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _starts(words: str, k: int) -> Column:
    """Where shingles start: one at 0 for fewer than k words."""
    n = F.size(words)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _shingle_texts(words: str, k: int) -> Column:
    """The distinct shingles; never null as far as the optimiser can see, so that it infers no filter that makes them a second time."""
    made = F.array_distinct(F.transform(_starts(words, k), lambda i: F.array_join(F.slice(words, i + 1, k), " ")))
    return F.coalesce(made, F.array().cast("array<string>"))


def _shingle_hashes(word_hashes: str, k: int) -> Column:
    """A hash for each shingle. Places past the last word of a short text are null, which the hash skips."""
    return F.transform(_starts(word_hashes, k), lambda i: F.xxhash64(*[F.get(word_hashes, i + j) for j in range(k)]))


def _hashed(texts: DataFrame, k: int) -> DataFrame:
    """texts(id, text) as (id, hashes). Each step is a column of its own, so that no lambda evaluates the one before again."""
    words = texts.select("id", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    return words.select("id", _shingle_hashes("w", k).alias("hashes"))


def _need(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def sketches(items: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(hash, id, least): the sketch of each item by its size partition; least: shingles that a document needs to be probed."""
    sets = _hashed(items, k).select("id", F.array_distinct("hashes").alias("hashes"))
    size = F.size("hashes")
    lower = F.pow(F.lit(2.0), F.floor(F.log2(size))).cast("int")
    depth = lower * 2 - 1 - _need(lower * 2 - 1, percent) + 1
    return sets.select("id", _need(lower, percent).cast("int").alias("least"), F.explode_outer(F.slice(F.sort_array("hashes"), F.lit(1), F.least(size, depth).cast("int"))).alias("hash")).where("hash is not null")


def contained_items(
    docs: DataFrame, items: DataFrame, k: int = SHINGLE, percent: int = PERCENT, probe_rows: int = PROBE_ROWS, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): items(item_id, text) that docs(doc_id, text) hold to at least percent."""
    item_texts = items.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null and text is not null").distinct()
    doc_texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    probe = stash(sketches(item_texts, k, percent).withColumnRenamed("id", "item_id"), "sketches")
    blocks = max(1, -(-probe.count() // probe_rows))
    hits = []
    for block in range(blocks):
        part = probe if blocks == 1 else probe.where(F.pmod(F.xxhash64("hash", F.lit(8)), F.lit(blocks)) == block)
        # explode_outer, and a size that can't be null: filters inferred from them would make the shingles a second time, below the scan
        rows = _hashed(doc_texts, k).select("id", F.coalesce(F.size("hashes"), F.lit(0)).alias("n"), F.explode_outer("hashes").alias("hash"))
        hits.append(rows.join(F.broadcast(part), "hash").where("n >= least").select(F.col("id").alias("doc_id"), "item_id"))
    pairs = stash(reduce(DataFrame.unionByName, hits).distinct(), "containment-candidates")
    wanted = pairs.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("item_id").alias("items"))
    doc_sets = (
        doc_texts.join(small(wanted, pairs.count()), "id")
        .select("id", "items", _words(F.col("text")).alias("w"))
        .select(F.col("id").alias("doc_id"), F.explode("items").alias("item_id"), _shingle_texts("w", k).alias("held"))
    )
    # One text an item from here on, as its sets: the table has a key once.
    item_sets = item_texts.select("id", _words(F.col("text")).alias("w")).select(F.col("id").alias("item_id"), _shingle_texts("w", k).alias("wanted"))
    item_sets = item_sets.groupBy("item_id").agg(F.collect_list("wanted").alias("sets"))
    size = item_texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    joined = doc_sets.join(F.broadcast(item_sets), "item_id") if size <= item_bytes else spread_join(doc_sets, item_sets, "item_id", counted=pairs)
    joined = joined.withColumn("wanted", F.explode("sets"))
    found = joined.select(
        "doc_id", "item_id", F.size("wanted").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("wanted", "held")).cast("long").alias("n_shared")
    )
    return found.where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * percent).groupBy("doc_id", "item_id").agg(
        F.max("n_item_shingles").alias("n_item_shingles"), F.max("n_shared").alias("n_shared")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that hold no item; all columns stay, whatever their names."""
    with scratch() as keep:
        found = keep(contained_items(docs, items, k, percent).select(F.col("doc_id").alias("found")).distinct(), "contaminated")
    # The rows travel as one struct, so that no column of theirs can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"))
    return rows.join(small(found, found.count()), F.col("id") == F.col("found"), "left_anti").select("row.*")
