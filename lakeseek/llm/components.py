"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import BROADCAST_ROWS, discard, spread_join, stash


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every node that has a link in ``links(a, b)``; component is the smallest id reachable.

    Each round every node takes its smallest neighbour, pointers are followed
    four deep, and the links between what remains are kept, so the links left
    shrink by a factor a round and a path of n nodes takes about log4(n) rounds.
    Only aggregates and equi-joins: minima are pre-aggregated on the map side, and
    the joins on a hub or on the root of a large component broadcast that key's row
    instead of moving all rows that point to it. Self-links and nulls are dropped; no links, no rows.
    """
    edges = stash(
        links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    labels = None
    while n := edges.count():
        # Few nodes are broadcast whole; of many only those that very many rows point to.
        few = 2 * n <= BROADCAST_ROWS
        meet = _broadcast_join if few else spread_join
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x")).select("x.*")
        hop = ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up"))
        for _ in range(2):
            hop = hop if few else stash(hop, "pointers")
            hop = meet(hop, hop.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "inner").select("node", F.col("top").alias("up"))
        hop = stash(hop, "pointers")
        if labels is None:
            labels = hop.select(F.col("node").alias("id"), F.col("up").alias("component"))
        else:
            moved = meet(labels, hop.select(F.col("node").alias("component"), "up"), "component", "left")
            labels = stash(moved.select("id", F.coalesce("up", "component").alias("component")), "labels")
        left = meet(edges, hop.select(F.col("node").alias("a"), F.col("up").alias("up_a")), "a", "inner")
        if not few:
            left = stash(left, "links")
        left = meet(left, hop.select(F.col("node").alias("b"), F.col("up").alias("up_b")), "b", "inner")
        rest = stash(
            left.where("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(),
            "links",
        )
        discard(edges)
        edges = rest
    discard(edges)
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    return labels


def _broadcast_join(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    return left.join(F.broadcast(right), on, how)
