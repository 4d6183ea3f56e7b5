"""Mixing sources to target weights with native functions only.

Every source gets a target in words: a weighted share of ``percent`` of all
words, with what exceeds ``max_copies`` times a source's own size shared again by
weight until none is above.  A document of a source with target T and size S is
wanted T / S times: that many whole copies, and a fraction left to chance.

The fractions are settled by pivotal dependent rounding.  Two documents at a
time, mass (fraction x size) moves from one to the other until one fraction is 0
or 1, up or down with the odds that keep both expectations, so the words a
source takes never drift from its target by more than one document.  Pairs are
folded inside groups of about GROUP documents of one source; the one document
each group leaves open goes up to the next level of a reduction tree, until
each source has one open document, which a last draw closes.  Folds go from long
to short documents, so what stays open, and with it the error, is small.  Groups are cut by
hash, so a source that holds a third of all rows is as many small tasks; rows that
are equal are settled among themselves by counting, so they don't meet in one group.  Draws
are hashes of (seed, level, documents): reruns agree.

Defined results: a null text has size 0 and is taken 0 times; rows without a
source form the last source; sources without words have target 0; repeated rows
and doc_ids are settled each for itself. Extra columns are ignored by ``mix``.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import small, stash, word_count

WEIGHTS, PERCENT, MAX_COPIES = (5, 2, 1), 150, 2
GROUP, SEED, RUN = 64, 20_301, 10_000
_OPEN = "struct<doc_id:bigint,size:bigint,p:double,done:array<struct<doc_id:bigint,size:bigint,copies:bigint>>>"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, docs, source_size, target) of docs sized as sizes(source, size). The table has one row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    table = stash(totals.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_copies).cast("double")), "sources")
    # The level w at which sum(min(w * weight, cap)) is the wanted total: sources fill up in the order of cap / weight.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) * percent / 100.0 - filled) / open_weight
    levels = table.select("*", level.alias("level"), F.row_number().over(order).alias("at"))
    wanted = levels.where(F.col("level") <= F.col("cap") / F.col("weight")).agg(F.min(F.struct("at", "level"))["level"].alias("fill"))
    return table.crossJoin(F.broadcast(wanted)).select(
        "source", "docs", "source_size", F.coalesce(F.least("cap", F.col("fill") * F.col("weight")), F.col("cap")).alias("target")
    )


def _draw(level: int, *values: Column) -> Column:
    """A number from 0 to 1, below 1, that only the arguments decide."""
    return F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), *values), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _item(doc: Column, size: Column, p: Column, done: Column) -> Column:
    return F.struct(doc.alias("doc_id"), size.alias("size"), p.alias("p"), done.alias("done")).cast(_OPEN)


def _closed(doc: Column, size: Column, copies: Column) -> Column:
    return F.array(F.struct(doc.alias("doc_id"), size.alias("size"), copies.cast("long").alias("copies")))


def _pair(level: int):
    """Fold step: the open document against the next; what is settled goes to done."""

    def step(have: Column, new: Column) -> Column:
        a, b, p, q = have["size"].cast("double"), new["size"].cast("double"), have["p"], new["p"]
        up, down = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))
        rise = _draw(level, have["doc_id"], new["doc_id"], have["size"], new["size"]) * (up + down) < down
        # (fraction of the open document, of the next) after the move; which one is integral is decided, not computed
        first = F.when(rise, a * (1 - p) <= b * q).otherwise(a * p <= b * (1 - q))
        end = F.when(rise, F.when(first, 1.0).otherwise(0.0)).otherwise(F.when(first, 0.0).otherwise(1.0))
        rest_new = F.when(rise, q - up / b).otherwise(q + down / b)
        rest_have = F.when(rise, p + up / a).otherwise(p - down / a)
        settled = F.when(first, _closed(have["doc_id"], have["size"], end)).otherwise(_closed(new["doc_id"], new["size"], end))
        return F.when(
            have["doc_id"].isNull() & have["size"].isNull(), _item(new["doc_id"], new["size"], new["p"], have["done"])
        ).otherwise(
            _item(
                F.when(first, new["doc_id"]).otherwise(have["doc_id"]),
                F.when(first, new["size"]).otherwise(have["size"]),
                F.when(first, rest_new).otherwise(rest_have),
                F.concat(have["done"], settled),
            )
        )

    return step


def _repeated(rows: DataFrame) -> DataFrame:
    """rows(source, doc_id, size, c) as c.n rows with c.copies each, made in runs of RUN so that no task makes them all."""
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c.n") - 1) / RUN))).alias("run")
    runs = rows.select("source", "doc_id", "size", "c", run).repartition("doc_id", "size", "run")
    each = F.explode(F.array_repeat(F.col("c.copies"), F.least(F.lit(RUN), F.col("c.n") - F.col("run") * RUN).cast("int"))).alias("copies")
    return runs.select("source", "doc_id", "size", each)


def _settle(docs: DataFrame, sources: DataFrame, group: int) -> DataFrame:
    """(source, doc_id, size, copies): 0 or 1 for each of docs(source, doc_id, size, p) with 0 < p < 1 and size > 0."""
    # Equal rows are paired with each other first: what their fractions add up to is so many whole ones, and at most one open row.
    same = stash(docs.groupBy("source", "doc_id", "size", "p").agg(F.count("*").alias("n")), "equal-rows")
    several = same.where("n > 1").select("source", "doc_id", "size", (F.col("n") * F.col("p")).alias("mass"), "n")
    several = several.select("source", "doc_id", "size", "n", F.floor("mass").cast("long").alias("whole"), (F.col("mass") - F.floor("mass")).alias("p"))
    opened = (F.col("p") > 0).cast("long")
    closed = several.select(
        "source", "doc_id", "size", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("copies"), F.col("whole").alias("n")), F.struct(F.lit(0).cast("long").alias("copies"), (F.col("n") - F.col("whole") - opened).alias("n")))).alias("c")
    ).where("c.n > 0")
    singles = same.where("n = 1").select("source", "doc_id", "size", "p").unionByName(several.where("p > 0").select("source", "doc_id", "size", "p"))
    level, settled, width = 0, [_repeated(closed)], group
    most = singles.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    cut = singles.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED)), F.lit(max(1, -(-most // group)))))
    cells = max(1, -(-most // group))
    while True:
        zero = F.lit(None).cast(_OPEN)
        start = _item(zero["doc_id"], zero["size"], zero["p"], F.array().cast("array<struct<doc_id:bigint,size:bigint,copies:bigint>>"))
        folded = stash(
            cut.groupBy("source", "cell")
            .agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "p")), asc=False).alias("members"))
            .select("source", "cell", F.aggregate("members", start, _pair(level)).alias("x")),
            f"mix-level{level}",
        )
        settled.append(folded.select("source", F.explode_outer("x.done").alias("d")).where("d is not null").select("source", "d.doc_id", "d.size", "d.copies"))
        left = folded.select("source", "cell", "x.doc_id", "x.size", "x.p")
        level += 1
        if cells == 1:
            last = (_draw(level, F.col("doc_id"), F.col("size")) < F.col("p")).cast("long")
            settled.append(left.select("source", "doc_id", "size", last.alias("copies")))
            break
        cells = -(-cells // width)
        cut = left.withColumn("cell", F.floor(F.col("cell") / width))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, max_copies: int = MAX_COPIES, group: int = GROUP
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of docs(doc_id, source, text); taken = copies x size."""
    sizes = stash(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")),
        "sizes",
    )
    sources = stash(targets(sizes, weights, percent, max_copies), "targets")
    n = sources.count()
    wanted = sizes.join(small(sources, n), sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    whole = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = wanted.withColumn("base", F.floor(whole).cast("long")).withColumn("p", whole - F.floor(whole))
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    drawn = _settle(wanted.where(open_).select("source", "doc_id", "size", "p"), sources, group)
    drawn = drawn.join(small(sources, n), drawn["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    settled = drawn.withColumn("copies", F.col("copies") + F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long"))
    fixed = wanted.where(~open_).select(*[c for c in settled.columns if c != "copies"], F.when(F.col("size") > 0, F.col("base")).otherwise(0).cast("long").alias("copies"))
    columns = ["doc_id", "source", "size", "source_size", "target", "copies"]
    return settled.select(*columns).unionByName(fixed.select(*columns)).withColumn("taken", F.col("copies") * F.col("size"))
