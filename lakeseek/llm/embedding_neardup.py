"""Near-duplicate embeddings by NN-descent.

1. Equal vectors of a label become one node, with a number of its own: vec_ids may repeat. A label's nodes are put
   in random orders (signs of hash planes, then a projection), more planes and more orders the larger the label: a pair
   at the threshold shares its signs in at least one of them but for a chance of MISS. Nodes within WINDOW places are
   compared in small matrix products; the best of each make the first neighbour lists.
2. Each round joins neighbours of neighbours: every node's list and the nodes that
   list it meet in one place, are compared with each other in a small matrix
   product, and whatever improves a list is kept.  A list that is full of links is
   saturated: it is enlarged to twice its size, up to MOST. Rounds end when few entries of the lists are new.
3. No compared pair at or above the threshold is lost, whether or not it stays in a list: each place that compares
   nodes gives a forest of the links it saw, and components follow from all forests.
4. Audit: of each label AUDIT nodes with links and AUDIT without are compared with their whole label. A node counts
   as found if all its links lie inside its component; the share of found nodes, weighted by the sizes of the two
   samples' populations, is the label's recall. Links that the audit sees join their components. A label under
   RECALL is searched again with twice as many new orders, TRIES times in all, and is then compared as a whole.
5. The nodes of a component are compared with each other in pairs of blocks, which counts every vector's links.
   Nothing else is compared in full: a label without groups costs its orders and lists, which grow a little faster
   than its size, and a group of near copies costs matrix products over its own vectors.

So n_links is exact inside each component, and what can be missed is a link between two components that no order, list
or audit met. ``exact=True`` compares whole labels instead of steps 4 and 5, at a cost that grows with their squares.

Cosines are taken in double precision.  Tasks hold at most two blocks or one
node's lists (of bounded length), never a label.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label or vec_id, link with nothing; vectors of different
lengths don't link; repeated rows, and rows that share a vec_id, are vectors of their own, each with
the links and the component of its own vector. Vectors are scaled by a power of two before their
lengths are taken, so very large and very small ones count too. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import discard, ship, spread_join, stash
from lakeseek.llm.components import connected_components

THRESHOLD, LIST, MOST, ROUNDS, DONE, TILE = 0.93, 8, 32, 4, 0.01, 512
#: Orders: a pair's chance to share no order, places compared with each other, most planes, entries a side for lists and orders that give some.
MISS, WINDOW, PLANES, BEST, NAVIGATE = 1e-4, 128, 30, 2, 6
#: Audit: nodes of each kind a label, recall wanted, searches of a label, nodes of a label a task compares with them.
AUDIT, RECALL, TRIES, CHUNK = 256, 0.99, 3, 16384
#: Blocks of the completion: at most SIDE tiles and BYTES of vectors each; SPREAD of them before they grow beyond one tile.
SIDE, SPREAD, BYTES = 8, 16, 1 << 24


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, as rows scaled to length 1 in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row, with its group and its packed vector; nulls where the vector can't link."""
    for batch in batches:
        packed: list[bytes | None] = []
        group: list[str | None] = []
        for vector, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), strict=True):
            x = np.array(vector, np.float64) if vector and label is not None and None not in vector else np.zeros(0)
            top = np.abs(x).max(initial=0.0)
            good = np.isfinite(top) and top > 0
            packed.append((np.ldexp(x, -int(np.frexp(top)[1])) + 0.0).tobytes() if good else None)
            group.append(f"{label}/{len(x)}" if good else None)
        yield pa.record_batch([batch.column("vec_id"), pa.array(group, pa.string()), pa.array(packed, pa.binary())], ["vec_id", "grp", "vec"])


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    length = pc.binary_length(batch.column("vec"))
    for n in pc.unique(length).to_pylist():
        yield batch.filter(pc.equal(length, n))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each order of its label, where each vector stands: signs at hash planes, then a projection."""
    for whole in batches:
        for batch in _by_length(whole):
            x, planes, first, last = _matrix(batch.column("vec")), *(batch.column(c).to_numpy() for c in ("planes", "first", "last"))
            for t in range(int(first.min()), int(last.max())):
                at = np.flatnonzero((first <= t) & (t < last))
                if not len(at):
                    continue
                p = x[at] @ np.random.default_rng([t, x.shape[1]]).standard_normal((x.shape[1], PLANES + 1))
                code = (((p[:, :PLANES] > 0).astype(np.int64) << np.arange(PLANES)).sum(1)) & ((1 << planes[at]) - 1)
                fine = np.clip((p[:, -1] * (1 << 24)).astype(np.int64), -(1 << 30), 1 << 30) + (1 << 30)
                rows = batch.take(pa.array(at))
                yield pa.record_batch(
                    [rows.column("grp"), pa.array(np.full(len(at), t)), pa.array((code << 32) + fine), rows.column("id"), pa.array(t - first[at] < NAVIGATE), rows.column("vec")],
                    ["grp", "t", "place", "id", "lists", "vec"],
                )


_EDGE = "u long, v long, sim double, way boolean"


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """Pairs for the lists."""
    return pa.record_batch([pa.array(u), pa.array(v), pa.array(sim), pa.array(np.zeros(len(u), bool))], ["u", "v", "sim", "way"])


def _ways(ids: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    """Pairs known to be of one component."""
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]]), pa.nulls(len(at), pa.float64()), pa.array(np.ones(len(at), bool))], ["u", "v", "sim", "way"])


def _forest(link: np.ndarray, rows: np.ndarray, columns: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs that join what the links join; root holds each item's component, and is brought up to date."""
    for k in np.flatnonzero((link & (root[rows][:, None] != root[columns][None, :])).any(1)).tolist():
        own = root[rows[k]]
        others = np.unique(root[columns[link[k]]])
        others = others[others != own]
        for other in others.tolist():
            yield int(own), other
        if len(others):
            root[np.isin(root, others)] = own


def _seed(threshold: float):
    """Rows in order: each vector against the next WINDOW of its label and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for whole in batches:
            if not whole.num_rows:
                continue
            new = pa.Table.from_batches([whole])
            joined = new if tail is None else pa.concat_tables([tail, new]).combine_chunks()
            old = joined.num_rows - whole.num_rows
            tail = joined.slice(max(0, joined.num_rows - WINDOW))
            ids, listed, vectors = joined.column("id").to_numpy(), joined.column("lists").to_numpy(), joined.column("vec").combine_chunks()
            for a, b in _starts(joined, ["grp", "t"]):
                if b - a < 2 or b <= old:
                    continue
                x, root, ways = _matrix(vectors.slice(a, b - a)), np.arange(b - a), []
                for s in range(max(0, old - a - WINDOW), b - a, WINDOW):
                    i, j = np.arange(s, min(s + WINDOW, b - a)), np.arange(s, min(s + 2 * WINDOW, b - a))
                    sim, gap = x[i] @ x[j].T, j[None, :] - i[:, None]
                    sim[(gap <= 0) | (gap > WINDOW) | (j[None, :] < old - a)] = -2.0
                    ways += _forest(sim >= threshold, i, j, root)
                    if listed[a]:
                        best = np.zeros(sim.shape, bool)
                        np.put_along_axis(best, np.argsort(-sim, axis=1, kind="stable")[:, :BEST], True, 1)
                        np.put_along_axis(best, np.argsort(-sim, axis=0, kind="stable")[:BEST], True, 0)
                        r, c = np.nonzero(best & (sim > -2.0))
                        yield _edges(ids[a + i[r]], ids[a + j[c]], sim[r, c])
                yield _ways(ids[a:b], ways)

    return run


def _group_rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Complete groups of rows sorted by the keys, several small ones or one large one at a time."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        other = np.zeros(held.num_rows, bool)
        for k in keys:
            c = held.column(k).to_numpy()
            other |= c != c[-1]
        last = np.flatnonzero(other)
        if len(last):
            yield held.slice(0, int(last[-1]) + 1).combine_chunks()
            held = held.slice(int(last[-1]) + 1)
    if held is not None:
        yield held.combine_chunks()


def _starts(t: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    cut = np.zeros(t.num_rows, bool)
    cut[0] = True
    for k in keys:
        c = t.column(k).to_numpy()
        cut[1:] |= c[1:] != c[:-1]
    s = np.flatnonzero(cut)
    return list(zip(s.tolist(), np.append(s[1:], t.num_rows).tolist(), strict=True))


def _local_join(threshold: float):
    """At each node, its neighbours are compared with each other: pairs that improve either list, and a forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _group_rows(batches, ["hub"]):
            ids, least = t.column("id").to_numpy(), t.column("least").to_numpy()
            vectors = t.column("vec").combine_chunks()
            out, ways = [], []
            for a, b in _starts(t, ["hub"]):
                if b - a > 1:
                    x, all_ = _matrix(vectors.slice(a, b - a)), np.arange(b - a)
                    sim = x @ x.T
                    low = np.minimum(least[a:b][:, None], least[a:b][None, :])
                    i, j = np.nonzero(np.triu(sim > low, 1))
                    out.append((ids[a:b][i], ids[a:b][j], sim[i, j]))
                    ways += [(a + p, a + q) for p, q in _forest(sim >= threshold, all_, all_, np.arange(b - a))]
            if out:
                yield _edges(*map(np.concatenate, zip(*out, strict=True)))
            yield _ways(ids, ways)

    return run


def _top(edges: DataFrame, limits: DataFrame | None) -> DataFrame:
    """Lists (u, v, sim, old, rank, k): the best k of each node, both ends of an edge(u, v, sim, old) list each other; k from limits, LIST without."""
    both = edges.select(F.explode(F.array(F.struct("u", "v", "sim", "old"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "old"))).alias("e")).select("e.*").where("u <> v")
    once = both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    ranked = once.withColumn("rank", rank).where(F.col("rank") <= MOST)
    if limits is None:
        return ranked.where(F.col("rank") <= LIST).withColumn("k", F.lit(LIST))
    return ranked.join(limits, "u", "left").withColumn("k", F.coalesce("k", F.lit(LIST))).where(F.col("rank") <= F.col("k"))


def _round(lists: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One NN-descent round over lists(u, v, sim, old, rank, k): the lists after it, and pairs known to be of one component."""
    full = F.max("rank") >= F.max("k")
    state = lists.groupBy("u").agg(F.when(full, F.min("sim")).otherwise(-1.0).alias("least"), F.max("k").alias("k"))
    # A saturated list, full and all links, is enlarged.
    state = state.withColumn("k", F.when(F.col("least") >= threshold, F.least(F.col("k") * 2, F.lit(MOST))).otherwise(F.col("k")).cast("int"))
    state = stash(state.withColumn("least", F.when(F.col("least") >= threshold, F.when(F.col("k") >= MOST, F.col("least")).otherwise(-1.0)).otherwise(F.col("least"))), "list-state")
    # Who lists a node: the nearest of them, as many as a list may have.
    back = lists.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy(F.col("sim").desc(), "u"))).where(F.col("at") <= MOST)
    meets = lists.select(F.col("u").alias("hub"), F.col("v").alias("id")).unionByName(back.select(F.col("v").alias("hub"), F.col("u").alias("id"))).distinct()
    sent = meets.join(nodes.select("id", "vec").join(state.select(F.col("u").alias("id"), "least"), "id", "left"), "id").select("hub", "id", F.coalesce("least", F.lit(-1.0)).alias("least"), "vec")
    met = stash(sent.repartition("hub").sortWithinPartitions("hub").mapInArrow(_local_join(threshold), _EDGE), "met")
    kept = lists.select("u", "v", "sim", F.lit(True).alias("old"))
    new = stash(_top(kept.unionByName(met.where("not way").select("u", "v", "sim", F.lit(False).alias("old"))), state.select("u", "k")), "lists")
    return new, met.where("way").select(F.col("u").alias("a"), F.col("v").alias("b"))


def _orders(sizes: DataFrame, threshold: float, attempt: int) -> DataFrame:
    """(grp, planes, first, last): how many planes a label's orders have, and which orders an attempt draws, twice as many as the one before."""
    planes = F.when(F.col("n") <= WINDOW, 0).otherwise(F.least(F.lit(PLANES), F.ceil(F.log2(2 * F.col("n") / WINDOW)))).cast("int")
    share = F.pow(F.lit(1 - math.acos(threshold) / math.pi), F.col("planes"))
    tables = F.when(F.col("planes") == 0, 1).otherwise(F.ceil(math.log(MISS) / F.log(1 - share))).cast("long")
    planned = sizes.withColumn("planes", planes).withColumn("tables", tables)
    return planned.select("grp", "planes", (F.col("tables") * (2**attempt - 1)).alias("first"), (F.col("tables") * (2 ** (attempt + 1) - 1)).alias("last"))


def _search(nodes: DataFrame, sizes: DataFrame, threshold: float, rounds: int, attempt: int) -> list[DataFrame]:
    """Tables (a, b) of pairs known to be of one component."""
    planned = spread_join(nodes.select("grp", "id", "vec"), _orders(sizes, threshold, attempt), "grp")
    placed = planned.mapInArrow(_places, "grp string, t long, place long, id long, lists boolean, vec binary")
    order = ["grp", "t", "place", "id"]
    seeds = stash(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_seed(threshold), _EDGE), "seeds")
    found = [seeds.where("way").select(F.col("u").alias("a"), F.col("v").alias("b"))]
    lists = stash(_top(seeds.where("not way").select("u", "v", "sim", F.lit(False).alias("old")), None), "lists")
    for _ in range(rounds):
        new, ways = _round(lists, nodes, threshold)
        discard(lists)
        lists = new
        found.append(ways)
        entries, fresh = lists.agg(F.count("*"), F.count_if(~F.col("old"))).first()
        if fresh <= DONE * entries:
            break
    found.append(lists.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b")))
    return found


def _asked(threshold: float):
    """In each part of a label, the sampled nodes against the part's: links within their component, links beyond it, and what those join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["grp", "chunk"]
        for t in _group_rows(batches, keys):
            ids, component, asks = (t.column(c).to_numpy() for c in ("id", "component", "asks"))
            vectors = t.column("vec").combine_chunks()
            for a, b in _starts(t, keys):
                ask, part = (np.flatnonzero(asks[a:b] == k) for k in (True, False))
                if not len(ask) or not len(part):
                    continue
                x = _matrix(vectors.slice(a, b - a))
                names, code = np.unique(component[a:b], return_inverse=True)
                root = np.arange(len(names))
                for s in range(0, len(ask), TILE):
                    i = ask[s : s + TILE]
                    link = (x[i] @ x[part].T >= threshold) & (ids[a:b][i][:, None] != ids[a:b][part][None, :])
                    inside = code[i][:, None] == code[part][None, :]
                    none = pa.nulls(len(i), pa.int64())
                    found, missed = (link & inside).sum(1), (link & ~inside).sum(1)
                    yield pa.record_batch([pa.array(ids[a:b][i]), none, none, pa.array(found), pa.array(missed)], ["id", "a", "b", "found", "missed"])
                    at = np.array(list(_forest(link, code[i], code[part], root)), np.int64).reshape(-1, 2)
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.record_batch([none, pa.array(names[at[:, 0]]), pa.array(names[at[:, 1]]), none, none], ["id", "a", "b", "found", "missed"])

    return run


def audit(nodes: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(grp, recall) for every label of nodes(grp, id, vec), given labels(id, component) of all nodes with links; and (a, b), components that links seen join."""
    known = nodes.select("grp", "id", "vec").join(labels, "id", "left")
    member = known.select("grp", "id", F.col("component").isNull().alias("lone"), F.coalesce("component", "id").alias("component"), "vec")
    populations = member.groupBy("grp", "lone").agg(F.count("*").alias("n"), F.sum(F.length("vec")).alias("bytes"))
    chunks = populations.groupBy("grp").agg(F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.sum("bytes") / BYTES)).cast("long").alias("chunks"))
    at = F.row_number().over(Window.partitionBy("grp", "lone").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    sample = stash(member.withColumn("at", at).where(F.col("at") <= AUDIT).drop("at"), "audited")
    asking = sample.join(chunks, "grp").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "id", "component", F.lit(True).alias("asks"), "vec")
    parts = spread_join(member, chunks, "grp").select("grp", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), "id", "component", F.lit(False).alias("asks"), "vec")
    rows = parts.unionByName(asking).repartition("grp", "chunk").sortWithinPartitions("grp", "chunk")
    seen = stash(rows.mapInArrow(_asked(threshold), "id long, a long, b long, found long, missed long"), "seen")
    each = seen.where("id is not null").groupBy("id").agg(F.sum("found").alias("found"), F.sum("missed").alias("missed")).join(sample.select("grp", "lone", "id"), "id")
    strata = each.groupBy("grp", "lone").agg(F.count("*").alias("asked"), F.count_if((F.col("found") > 0) & (F.col("missed") == 0)).alias("good"), F.count_if(F.col("missed") > 0).alias("bad"))
    weight = F.col("n") / F.col("asked")
    weighted = strata.join(populations.select("grp", "lone", "n"), ["grp", "lone"]).groupBy("grp").agg(F.sum(weight * F.col("good")).alias("good"), F.sum(weight * F.col("bad")).alias("bad"))
    recall = F.when(F.col("good") + F.col("bad") > 0, F.col("good") / (F.col("good") + F.col("bad"))).otherwise(1.0)
    return stash(weighted.select("grp", recall.alias("recall")), "recall"), seen.where("id is null").select("a", "b")


def _components(found: list[DataFrame]) -> DataFrame:
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return stash(connected_components(pairs), "components")


def _audited(nodes: DataFrame, threshold: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(id, component) of the nodes with links, and the labels (grp) whose recall stayed under RECALL."""
    sizes = stash(nodes.groupBy("grp").agg(F.count("*").alias("n")), "label-sizes")
    found, open_ = [], sizes
    for attempt in range(TRIES):
        here = spread_join(nodes, open_.select("grp"), "grp", "left_semi") if attempt else nodes
        found += _search(here, open_, threshold, rounds, attempt)
        labels = _components(found)
        recall, bridges = audit(here, labels, threshold, attempt)
        open_ = stash(sizes.join(recall.where(F.col("recall") < RECALL), "grp", "left_semi"), "open-labels")
        found = [labels.select(F.col("id").alias("a"), F.col("component").alias("b")), bridges]
        if open_.isEmpty():
            break
    return (labels if bridges.isEmpty() else _components(found)), open_.select("grp")


def _sweep(threshold: float, tile: int):
    """In each pair of blocks: every vector's links, and a forest of the links between different components."""

    def joined(x: np.ndarray, y: np.ndarray, home: np.ndarray, away: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, weight: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int]]:
        for s in range(0, len(x), tile):
            link = x[s : s + tile] @ y.T >= threshold
            if x is y:
                k = np.arange(len(link))
                link[k, s + k] = False
            left[s : s + tile] += link @ weight[1]
            if x is not y:
                right += weight[0][s : s + tile] @ link
            yield from _forest(link, home[s : s + tile], away, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["grp", "i", "j"]
        for t in _group_rows(batches, keys):
            ids, block, copies, component = (t.column(c).to_numpy() for c in ("id", "block", "copies", "component"))
            i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
            vectors = t.column("vec").combine_chunks()
            for a, b in _starts(t, keys):
                x, n = _matrix(vectors.slice(a, b - a)), np.zeros(b - a, np.int64)
                names, code = np.unique(component[a:b], return_inverse=True)
                at, to = np.flatnonzero(block[a:b] == i[a]), np.flatnonzero(block[a:b] == j[a])
                left, right = np.zeros(len(at), np.int64), np.zeros(len(to), np.int64)
                y = x[at]
                z = y if i[a] == j[a] else x[to]
                bridges = np.array(list(joined(y, z, code[at], code[to], np.arange(len(names)), left, right, (copies[a:b][at], copies[a:b][to]))), np.int64).reshape(-1, 2)
                n[at] += left
                n[to] += right
                nothing = pa.nulls(len(ids[a:b]), pa.int64())
                yield pa.record_batch([pa.array(ids[a:b]), nothing, pa.array(n)], ["a", "b", "links"])
                yield pa.record_batch([pa.array(names[bridges[:, 0]]), pa.array(names[bridges[:, 1]]), pa.nulls(len(bridges), pa.int64())], ["a", "b", "links"])

    return run


def _complete(nodes: DataFrame, labels: DataFrame, whole: DataFrame | None, threshold: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of each component, and of each label in whole(grp), against each other: (id, links), how many vectors outside its own node each links to; and (id, component) with every link counted."""
    rows = nodes.join(labels, "id", "left")
    if whole is not None:
        rows = rows.join(whole.withColumn("sweep", F.lit(True)), "grp", "left")
    else:
        rows = rows.withColumn("sweep", F.lit(True))
    rows = rows.where("sweep or component is not null").withColumn("grp", F.when(F.col("sweep"), F.concat(F.lit("label "), "grp")).otherwise(F.concat(F.lit("component "), F.col("component").cast("string"))))
    rows = stash(rows.withColumn("component", F.coalesce("component", "id")).drop("sweep"), "compared")
    labels = rows.select("id", "component")
    # Blocks of a tile's side in small groups; larger groups have larger blocks, for each vector is sent once a block.
    n = F.count("*")
    blocks = rows.groupBy("grp").agg(F.greatest(F.ceil(n / (tile * SIDE)), F.least(F.ceil(n / tile), F.lit(SPREAD)), F.ceil(F.sum(F.length("vec")) / BYTES)).cast("long").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = spread_join(rows, blocks, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", other)
    rows = rows.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block", "component", "copies", "vec")
    tiles = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    swept = stash(tiles.mapInArrow(_sweep(threshold, tile), "a long, b long, links long"), "swept")
    counts = swept.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    merged = connected_components(swept.where("b is not null").select("a", "b"))
    joined = labels.join(merged.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
    return counts, joined.select("id", F.coalesce("top", "component").alias("component"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS, tile: int = TILE, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors(vec_id, embedding, label); exact compares whole labels after the search."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    print_ = F.md5(F.concat(F.col("grp").cast("binary"), F.lit("|").cast("binary"), F.col("vec")))
    clean = stash(rows.mapInArrow(_clean, "vec_id long, grp string, vec binary").withColumn("print", F.when(F.col("vec_id").isNotNull(), print_)), "vectors")
    merged = clean.where("print is not null").groupBy("grp", "vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    # Numbers are drawn once, by the write.
    nodes = stash(merged.withColumn("print", print_).withColumn("id", F.monotonically_increasing_id()), "nodes")
    if exact:
        labels, whole = _components(_search(nodes, nodes.groupBy("grp").agg(F.count("*").alias("n")), threshold, rounds, 0)), None
    else:
        labels, whole = _audited(nodes, threshold, rounds)
    counts, labels = _complete(nodes, labels, whole, threshold, tile)
    known = nodes.select("id", "print", "least_id", "copies").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # The components' smallest vec_ids are merged inside tasks first; a large one is looked up without moving its nodes.
    smallest = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = spread_join(known.drop("least_id"), smallest, "component").join(counts, "id", "left")
    known = known.select("print", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = spread_join(clean.select("vec_id", "print"), known, "print", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
