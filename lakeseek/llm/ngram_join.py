"""Exact Jaccard join of documents on five-word shingles, in metric space.

Jaccard distance is a metric, and documents link at distance 0.2 or less.

*Pivots and regions.*  Each shingle s is a pivot {s}: a document of n shingles is
at distance 1 - 1/n from the pivots it holds and at 1 from all others.  Equal
distances are told apart by one global order of the pivots, so a document's
Voronoi cell is that of its first shingle.  By the triangle inequality a partner
within 0.2 misses at most n - ceil(0.8 n) of the n shingles, so its cell is met
among the first n - ceil(0.8 n) + 1: that is the window of regions to which a
document is replicated.  Two linked documents meet in at least one region.

*Order.*  Any order is exact.  Shingles that are frequent in a sample of
documents come last, the rest by hash: common passages then make no regions, and
only the cost depends on the sample.

*Recursion.*  A region of more than REGION documents gets pivots of its own, documents
drawn from it by hash.  First every document proposes a link to its nearest pivot, so a
large group of near copies becomes one component with one pair a document.  If documents
of different components are left, the region is cut into the Voronoi cells of its pivots
under the Jaccard distance of bucket counts, which never exceeds that of the sets: a
document goes to its nearest pivot's cell and, by the triangle inequality, to each cell
whose pivot is at most 2 * 0.2 farther than its nearest one.  Cells that are still too large are cut
again with new pivots.  A region that pivots can't part (most documents are within the
windows of all) is cut into pairs of blocks, of which those inside its largest component are left out.
In the end each cell is small and is joined in memory against SKETCH virtual pivots, the
buckets of the shingle hashes: the L1 distance of two documents' bucket counts never
exceeds their symmetric difference, so pairs beyond the limit are left out
without looking at the sets.

*Links.*  Only connectivity is asked for, so a cell proposes a few nearest
partners of each document, or, if it is large, a spanning forest of its possible pairs,
not all of them, the first two times.  Proposals meet FINE virtual pivots, and what is left is
verified on whole shingle sets.  Where one fails, or pairs left out would join what all
proposals together leave apart, the cell is joined again: pairs between
documents that are not connected yet are proposed, ever more of them, until no
possible pair between different components is left.  No link is lost.

Equal shingle sets are one class, which one of its rows stands for.  Rows are told
apart by a number of their own, not by doc_id.  Shingle hashes have 64 bits.

Defined results: words are split at ASCII white space, A-Z lower-cased; texts of
fewer than five words are one shingle; null or blank texts have none and link
with nothing; rows without a doc_id are left out of classes and get a null
component; rows with words that share a doc_id are linked, whatever their texts.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import discard, scratch, ship, small, small_batches, spread_join, stash
from lakeseek.llm.components import connected_components
from lakeseek.llm.kernels import U64, gram_hashes, mix, text_slices

SHINGLE, PERCENT = 5, 80
#: Documents of a cell joined in memory; virtual pivots; one document in SAMPLE is used to order shingles; an order has at most FREQUENT of them in front of its end.
REGION, SKETCH, SAMPLE, FREQUENT, OFTEN = 1024, 256, 64, 200_000, 4
#: Virtual pivots of proposed pairs; pairs up to which they are left out; documents of a cell from which on it proposes a forest; partners that a document proposes first.
FINE, FEW, FOREST, FIRST = 1024, 20_000, 64, 32
#: Pivots drawn from a large region; copies of a region's rows up to which its Voronoi cells are used; the part of its parent up to which a cell counts as smaller; salts of its rows.
PIVOTS, WINDOWS, SMALLER, SALTS = 16, 2.0, 0.7, 16


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batch with the sorted distinct shingle hashes of each text."""
    for part, words in text_slices(batch, "text"):
        grams, places = gram_hashes(words.hashes(True), words.docs, k)
        cuts = np.searchsorted(places, words.docs)
        yield part, [np.unique(grams[cuts[i] : cuts[i + 1]]) for i in range(len(part))]


def _prefix(n: int, percent: int) -> int:
    return n + 1 - -(-n * percent // 100) if n else 0


def _sample(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch, k):
                for s in sets:
                    if len(s):
                        key = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                        yield pa.record_batch([pa.array(s.view(np.int64)), pa.array(np.full(len(s), key))], ["s", "set"])

    return run


def frequent_shingles(texts: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of shingles in at least OFTEN different sets of the sample; the threshold doubles until at most FREQUENT are left. They steer cost only."""
    drawn = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(SAMPLE)) == 0)
    counts = stash(drawn.mapInArrow(_sample(k), "s long, set long").distinct().groupBy("s").count().where(F.col("count") >= OFTEN), "frequent")
    least = OFTEN
    while counts.where(F.col("count") >= least).count() > FREQUENT:
        least *= 2
    found = counts.where(F.col("count") >= least).select("s").toArrow().column("s").to_numpy()
    discard(counts)
    return np.sort(found.view(U64))


def _profiles(k: int, percent: int, frequent):
    """Of each text: size, set fingerprint, the shingles of its window of regions, and its bucket counts, four bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for batch in batches:
            for part, sets in _sets(batch, k):
                sizes = np.array([len(s) for s in sets], np.int64)
                every = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
                owner = np.repeat(np.arange(len(sets)), sizes)
                counts = np.minimum(np.bincount(owner * SKETCH + (every & U64(SKETCH - 1)).astype(np.int64), minlength=len(sets) * SKETCH), 15).astype(np.uint8)
                packed = (counts[0::2] << 4) | counts[1::2]
                at = np.searchsorted(last, every)
                common = (last[np.minimum(at, len(last) - 1)] == every) if len(last) else np.zeros(len(every), bool)
                ends = np.cumsum(sizes)
                prints, windows = [], []
                for s, end, n in zip(sets, ends.tolist(), sizes.tolist(), strict=True):
                    prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                    need, late = _prefix(n, percent), common[end - n : end]
                    if late.any():
                        s = np.concatenate([s[~late], s[late]])
                    windows.append(s[:need])
                starts = np.concatenate([[0], np.cumsum([len(w) for w in windows])]).astype(np.int32)
                flat = np.concatenate(windows).view(np.int64) if len(windows) else np.zeros(0, np.int64)
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array(sizes),
                        pa.array(prints, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(starts), pa.array(flat)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH // 2), len(sets), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary()),
                    ],
                    ["doc_id", "text_key", "size", "print", "window", "sketch"],
                )
        pa.default_memory_pool().release_unused()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows(region, node) sorted by region, those that share it with another; the ends of a partition may share with the next, so they stay."""
    held: pa.RecordBatch | None = None
    first = True

    def shared(batch: pa.RecordBatch, start: bool, stop: bool) -> pa.RecordBatch:
        key = batch.column("region").to_numpy()
        same = key[1:] == key[:-1]
        keep = np.zeros(len(key), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if start:
            keep |= key == key[0]
        if stop:
            keep |= key == key[-1]
        return batch.filter(pa.array(keep))

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column("region").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield shared(batch.slice(0, cut), first, False)
            first = False
        held = batch.slice(cut)
    if held is not None:
        yield shared(held, first, True)


def _coarse(sketch: np.ndarray) -> np.ndarray:
    """Bucket counts, four to one. Their distances bound the finer ones from below and are cheaper."""
    return sketch.reshape(len(sketch), -1, 4).sum(2, dtype=np.int8)


def _near(sketch: np.ndarray, coarse: np.ndarray, size: np.ndarray, u: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance in bucket counts from u to all, and whether a link is possible: J >= p % iff (100 + p) * difference <= (100 - p) * (a + b)."""
    limit = (size + size[u]) * (100 - percent)
    low = np.maximum(np.abs(coarse - coarse[u]).sum(1), np.abs(size - size[u]))
    can = low * (100 + percent) <= limit
    at = np.flatnonzero(can)
    low[at] = np.maximum(low[at], np.abs(sketch[at] - sketch[u]).sum(1))
    can[at] = low[at] * (100 + percent) <= limit[at]
    return low, can


def _joins(comp: np.ndarray, pairs: list[tuple[int, int]], left: list[tuple[np.ndarray, np.ndarray]]) -> bool:
    """Whether a pair left out joins two components that the proposed pairs, if all are good, leave apart."""
    root = np.unique(comp, return_inverse=True)[1]
    for u, v in pairs if left else ():
        if root[u] != root[v]:
            root[root == root[v]] = root[u]
    return any((root[u] != root[v]).any() for u, v in left)


def _propose(doc, size, sketch, comp, failed, percent: int, turn: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs to verify, and whether possible pairs were left out that are needed even if all of these are good."""
    n, out, coarse, left = len(doc), [], _coarse(sketch), []
    if turn == 0 and n > FOREST:  # Prim's forest of possible pairs, nearest first; members of one component cost nothing
        best, via, todo = np.full(n, 1 << 30), np.full(n, -1), np.ones(n, bool)
        u = 0
        while True:
            todo[u] = False
            low, can = _near(sketch, coarse, size, u, percent)
            if len(failed[u]):
                can &= ~np.isin(doc, failed[u])
            same = comp == comp[u]
            low[same], can[same] = -1, True
            better = todo & can & (low < best)
            best[better], via[better] = low[better], u
            if not todo.any():
                return out, False
            u = int(np.argmin(np.where(todo, best, 1 << 31)))
            if via[u] >= 0 and best[u] >= 0:
                out.append((via[u], u))
    most = FIRST * 4**turn
    if n <= FOREST:
        limit = (size[:, None] + size[None, :]) * (100 - percent)
        low = np.maximum(np.abs(coarse[:, None, :] - coarse[None, :, :]).sum(2), np.abs(size[:, None] - size[None, :]))
        can = np.triu(low * (100 + percent) <= limit, 1) & (comp[:, None] != comp[None, :])
        i, j = np.nonzero(can)
        low[i, j] = low[j, i] = np.maximum(low[i, j], np.abs(sketch[i] - sketch[j]).sum(1))
        can[i, j] = low[i, j] * (100 + percent) <= limit[i, j]
        near = can | can.T
        for u in range(n):
            if len(failed[u]):
                lost = np.isin(doc, failed[u])
                near[u, lost] = near[lost, u] = False
        if n - 1 > most and near.sum(1).max() > most:
            order = np.argsort(np.where(near, low, 1 << 30), axis=1, kind="stable")[:, :most]
            keep = np.zeros_like(near)
            np.put_along_axis(keep, order, True, 1)
            keep |= keep.T
            left.append(np.nonzero(near & ~keep))
            near &= keep
        out = list(zip(*(x.tolist() for x in np.nonzero(np.triu(near))), strict=True))
        return out, _joins(comp, out, left)
    for u in range(n):
        low, can = _near(sketch, coarse, size, u, percent)
        can &= comp != comp[u]
        can[u] = False
        if len(failed[u]):
            can &= ~np.isin(doc, failed[u])
        found = np.flatnonzero(can)
        found = found[np.lexsort((doc[found], low[found]))]
        if len(found) > most:
            left.append((np.full(len(found) - most, u), found[most:]))
        out += [(u, int(v)) for v in found[:most]]
    return out, _joins(comp, out, left)


_NOTHING = np.zeros(0, np.int64)


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as views of its numbers; a null is an empty one."""
    out = []
    for chunk in column.chunks:
        offsets, values = chunk.offsets.to_numpy(), chunk.values.to_numpy(zero_copy_only=False)
        given = chunk.is_valid().to_numpy(zero_copy_only=False)
        out += [values[a:b] if g else _NOTHING for a, b, g in zip(offsets[:-1].tolist(), offsets[1:].tolist(), given.tolist(), strict=True)]
    return out


def _join_cells(percent: int, turn: int):
    def pairs(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        region, cell, doc, size, comp = (t.column(c).to_numpy() for c in ("region", "cell", "doc_id", "size", "comp"))
        raw = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH // 2)
        sketch = np.empty((len(doc), SKETCH), np.int8)
        sketch[:, 0::2], sketch[:, 1::2] = raw >> 4, raw & 15
        failed = _views(t.column("failed")) if "failed" in t.column_names else [_NOTHING] * len(doc)
        starts = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (cell[1:] != cell[:-1])]))
        sizes = np.diff(np.append(starts, len(doc)))
        two = starts[sizes == 2] if turn == 0 else starts[:0]
        low = np.maximum(np.abs(sketch[two] - sketch[two + 1]).sum(1), np.abs(size[two] - size[two + 1])) if len(two) else np.zeros(0, np.int64)
        two = two[(low * (100 + percent) <= (size[two] + size[two + 1]) * (100 - percent)) & (comp[two] != comp[two + 1])]
        left, right, cut = [two], [two + 1], []
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            if n > 2 or (n == 2 and turn):
                part = slice(s, s + n)
                found, more = _propose(doc[part], size[part], sketch[part], comp[part], failed[part], percent, turn)
                if more:
                    cut.append(s)
                if found:
                    x = np.array(found)
                    left.append(x[:, 0] + s)
                    right.append(x[:, 1] + s)
        a, b = np.concatenate(left), np.concatenate(right)
        # A region that needs pairs left out here: a row without a pair.
        none = pa.nulls(len(cut), pa.int64())
        columns = [(region[a], pa.array(region[cut])), (np.minimum(doc[a], doc[b]), none), (np.maximum(doc[a], doc[b]), none)]
        return pa.record_batch([pa.concat_arrays([pa.array(x), y]) for x, y in columns], ["region", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            region, cell = held.column("region").to_numpy(), held.column("cell").to_numpy()
            last = np.flatnonzero((region != region[-1]) | (cell != cell[-1]))
            if len(last):
                yield pairs(held.slice(0, int(last[-1]) + 1))
                held = held.slice(int(last[-1]) + 1)
        if held is not None:
            yield pairs(held)
        held = None
        pa.default_memory_pool().release_unused()

    return run


_KEY = ["region", "cell"]
_MEMBER = "region long, cell long, doc_id long, size long, comp long, sketch binary, failed array<long>"
_NAMES = ["region", "cell", "doc_id", "size", "comp", "sketch", "failed"]


def _outlines(rows: pa.RecordBatch) -> np.ndarray:
    """Bucket counts, and in a last column what they leave out of the size: each row sums to the size of its set."""
    raw = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH // 2)
    out = np.empty((len(raw), SKETCH + 1), np.int32)
    out[:, 0:SKETCH:2], out[:, 1:SKETCH:2] = raw >> 4, raw & 15
    out[:, SKETCH] = rows.column("size").to_numpy() - out[:, :SKETCH].sum(1)
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Jaccard distance of the multisets of counts from each row to each pivot, a metric: 1 - sum of minima / sum of maxima."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        apart = np.abs(x - p).sum(1)
        out[:, j] = 2 * apart / (x.sum(1) + p.sum() + apart)
    return out


def _voronoi(percent: int, kind: str):
    """Rows behind the pivots of their group, as _behind_pivots deals them.  star: each row with its nearest pivot, if they can link;
    count: rows and copies of a cut into cells; split: the rows of the cells."""
    near = (100 - percent) / 100 + 1e-9

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        key, pivots, names = None, [], []
        for batch in batches:
            marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "cell", "salt", "pivot")]
            cut = np.flatnonzero(np.concatenate([[True], np.any([m[1:] != m[:-1] for m in marks], axis=0)])) if batch.num_rows else []
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if (new := tuple(int(m[a]) for m in marks[:3])) != key:
                    key, pivots, names = new, [], []
                if marks[3][a]:
                    pivots.append(_outlines(part))
                    names.append(part.column("doc_id").to_numpy())
                    continue
                for s in range(0, part.num_rows, 4096):
                    yield part.slice(s, 4096), np.concatenate(pivots), np.concatenate(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pivots, names in groups(batches):
            away = _distances(_outlines(part), pivots)
            home, doc = away.argmin(1), part.column("doc_id").to_numpy()
            least = away[np.arange(len(away)), home]
            region, cell = part.column("region"), part.column("cell")
            if kind == "star":
                at = np.flatnonzero((least <= near) & (names[home] != doc))
                a, b = doc[at], names[home[at]]
                yield pa.record_batch([region.take(pa.array(at)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["region", "a", "b"])
                continue
            row, to = np.nonzero(away <= least[:, None] + 2 * near)
            if kind == "count":
                yield pa.record_batch([region.slice(0, 1), cell.slice(0, 1), pa.array([len(doc)]), pa.array([len(row)])], ["region", "cell", "rows", "copies"])
                continue
            member = part.select(_NAMES).take(pa.array(row))
            inner = mix(member.column("cell").to_numpy().view(U64) * U64(PIVOTS + 1) + to.astype(U64) + U64(1)).view(np.int64)
            columns = [member.column(0), pa.array(inner), *member.columns[2:], part.column("n").take(pa.array(row)), pa.array(to == home[row])]
            yield pa.record_batch(columns, [*member.schema.names, "parent", "home"])

    return run


def _behind_pivots(rows: DataFrame, groups: DataFrame, limit: int) -> DataFrame:
    """The rows of groups(region, cell, n), dealt by group and salt, sorted behind the group's pivots: of every slot of its rows the one with the least hash."""
    inside = rows.join(small(groups.select(*_KEY, "n"), groups.count()), _KEY)
    slot = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.least(F.lit(PIVOTS), F.ceil(F.col("n") / limit) + 1))
    drawn = inside.groupBy(*_KEY, slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(4)).alias("h"), "doc_id", "size", "sketch")).alias("p"), F.max("n").alias("n"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    pivots = drawn.select(*_KEY, salt.alias("salt"), F.lit(True).alias("pivot"), "p.doc_id", "p.size", "p.sketch", "n")
    own = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SALTS)).cast("int")
    dealt = inside.withColumns({"salt": own, "pivot": F.lit(False)}).unionByName(pivots, allowMissingColumns=True)
    return dealt.repartition(*_KEY, "salt").sortWithinPartitions(*_KEY, "salt", F.col("pivot").desc(), "doc_id")


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Groups that pivots can't part, as pairs of blocks. The largest component's rows meet only those of others."""
    half = max(1, limit // 2)
    most = rows.groupBy(*_KEY, "comp").count().groupBy(*_KEY).agg(F.max(F.struct("count", "comp")).alias("m"), F.sum("count").alias("n"))
    most = stash(most.select(*_KEY, F.col("m.comp").alias("bulk"), F.ceil(F.col("m.count") / half).cast("long").alias("x"), F.ceil((F.col("n") - F.col("m.count")) / half).cast("long").alias("y")), "large-groups")
    marked = rows.join(small(most, most.count()), _KEY)
    own, bulk = F.pmod(F.xxhash64("doc_id"), F.when(F.col("comp") == F.col("bulk"), F.col("x")).otherwise(F.col("y"))), F.col("comp") == F.col("bulk")
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    others = F.transform(each("y"), lambda j: F.xxhash64("cell", F.lit(1), own, j))
    mixed = F.transform(each("x"), lambda i: F.xxhash64("cell", F.lit(1), i, own))
    inner = F.transform(each("y"), lambda j: F.xxhash64("cell", F.lit(2), F.least(own, j), F.greatest(own, j)))
    return marked.withColumn("cell", F.explode(F.when(bulk, others).otherwise(F.concat(mixed, inner)))).drop("bulk", "x", "y")


def _cells(rows: DataFrame, percent: int, limit: int, pivots: bool) -> tuple[DataFrame, bool]:
    """Rows (of _MEMBER) of large regions in cells of at most about ``limit`` rows in which every possible link between different components is met, and whether pivots have parted any.
    Without pivots, where those have parted nothing before, all are cut into blocks."""
    todo = stash(rows.select(*_NAMES, F.lit(None).cast("long").alias("parent"), F.lit(True).alias("home")), "cells")
    out = []
    while True:
        # Where all are of one component, or none is at home, nothing is to be found.
        groups = todo.groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("parent").alias("parent"), F.max("home").alias("home"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        groups = stash(groups.where("home and low < high").select(*_KEY, "n", "parent"), "groups")
        fit = groups.where(F.col("n") <= limit).select(*_KEY)
        out.append(todo.join(small(fit, fit.count()), _KEY, "left_semi").select(*_NAMES))
        large = groups.where(F.col("n") > limit)
        if large.isEmpty():
            break
        if not pivots:
            out.append(_blocks(todo.join(small(large.select(*_KEY), large.count()), _KEY, "left_semi").select(*_NAMES), limit))
            break
        fresh = large.where(F.col("parent").isNull() | (F.col("n") <= F.col("parent") * SMALLER))
        tried = _behind_pivots(todo, fresh, limit).mapInArrow(_voronoi(percent, "count"), "region long, cell long, rows long, copies long")
        tried = tried.groupBy(*_KEY).agg(F.sum("rows").alias("n"), F.sum("copies").alias("copies"))
        good = stash(tried.where(F.col("copies") <= F.col("n") * WINDOWS).select(*_KEY, "n"), "parted")
        rest = large.join(good, _KEY, "left_anti").select(*_KEY)
        out.append(_blocks(todo.join(small(rest, rest.count()), _KEY, "left_semi").select(*_NAMES), limit))
        if good.isEmpty():
            pivots = len(out) > 2
            break
        todo = stash(_behind_pivots(todo, good, limit).mapInArrow(_voronoi(percent, "split"), _MEMBER + ", parent long, home boolean"), "cells")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found, pivots


def _pack_sets(k: int, fine: bool):
    """Whole sets as bytes, or their counts in FINE buckets, four bits each."""

    def packed(s: np.ndarray) -> bytes:
        if not fine:
            return s.tobytes()
        n = np.minimum(np.bincount((s & U64(FINE - 1)).astype(np.int64), minlength=FINE), 15).astype(np.uint8)
        return ((n[0::2] << 4) | n[1::2]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, k):
                yield pa.record_batch([part.column("node"), pa.array([packed(s) for s in sets], pa.binary())], ["id", "s"])

    return run


def _verify(percent: int, fine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            # Buffers of the batch, not copies: whole sets are most of what a task holds.
            rows = zip(batch.column("sa"), batch.column("sb"), batch.column("both").to_pylist(), strict=True)
            for x, y, both_sizes in rows:
                x, y = x.as_buffer(), y.as_buffer()
                if fine:
                    x, y = np.frombuffer(x, np.uint8).astype(np.int16), np.frombuffer(y, np.uint8).astype(np.int16)
                    low = int(np.abs((x >> 4) - (y >> 4)).sum() + np.abs((x & 15) - (y & 15)).sum())
                    good.append(low * (100 + percent) <= both_sizes * (100 - percent))
                else:
                    x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both * 100 >= (len(x) + len(y) - both) * percent)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "good"])

    return run


def _compared(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, k: int, percent: int, fine: bool) -> DataFrame:
    """pairs(a, b) with good: whether the pair can be near by bucket counts (fine), or is near by whole sets. Only documents in pairs are hashed again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stash(nodes.join(wanted, "node").select("node", "doc_id", "text_key"), "wanted")
    made = stash(texts.join(small(wanted, wanted.count()), ["doc_id", "text_key"]).mapInArrow(_pack_sets(k, fine), "id long, s binary"), "sets")
    # Repeated rows make a set more than once.
    sets = made.groupBy("id").agg(F.max("s").alias("s"))
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    out = stash(both.select("a", "b", "sa", "sb", "both").mapInArrow(_verify(percent, fine), "a long, b long, good boolean"), "compared")
    discard(made, wanted)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs(a, b) of nodes(node, doc_id, text_key, size) with good: whether they are near."""
    x, y = (nodes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}")) for end in ("a", "b"))
    sized = stash(pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("size_a") + F.col("size_b")).alias("both")), "sized")
    if sized.count() <= FEW:
        # Whole sets of few documents are as cheap as their bucket counts.
        exact = _compared(sized, texts, nodes, k, percent, False)
        discard(sized)
        return exact
    possible = _compared(sized, texts, nodes, k, percent, True)
    left = stash(sized.join(possible.where("good"), ["a", "b"], "left_semi"), "possible")
    exact = _compared(left, texts, nodes, k, percent, False)
    discard(sized, left)
    return exact.unionByName(possible.where("not good"))


def _shared_ids(members: DataFrame) -> DataFrame:
    """(a, b): nodes with a doc_id in common, of members(doc_id, rep, print)."""
    ids = members.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y"), F.min("rep").alias("a")).where("x <> y").select("doc_id", "a")
    return members.join(ids, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, region: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs(doc_id, text); component_id: smallest doc_id reachable by links."""
    with small_batches(docs.sparkSession), scratch() as keep:
        return keep(_near_duplicates(docs, k, percent, region), "near-duplicates")


def _near_duplicates(docs: DataFrame, k: int, percent: int, region: int) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(texts.where("text is not null"), k))
    made = texts.mapInArrow(_profiles(k, percent, frequent), "doc_id long, text_key long, size long, print binary, window array<long>, sketch binary")
    # The number is written with the row, so later reads all see the same.
    profiles = stash(made.withColumn("node", F.monotonically_increasing_id()), "profiles")
    usable = profiles.where("size > 0 and doc_id is not null")
    classes = stash(usable.groupBy("print").agg(F.min("node").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("copies")), "classes")
    # Only one row of a class goes on; the others, known without moving any window, are left out.
    others = stash(usable.select("node", "print").join(classes.where("copies > 1"), "print").where("node <> rep").select("node"), "copies")
    reps = usable.join(small(others, others.count()), "node", "left_anti")
    replicas = reps.select(F.explode("window").alias("region"), "node")
    met = replicas.repartitionByRange("region", "node").sortWithinPartitions("region", "node").mapInArrow(_met, "region long, node long")
    active = stash(met.distinct(), "regions")
    # Every turn reads these: written once, without the windows.
    outlined = stash(reps.select("node", "doc_id", "text_key", "size", "sketch"), "outlines")
    nodes = outlined.select("node", "doc_id", "text_key", "size")
    outlines = outlined.select("node", "size", "sketch")
    shared = stash(_shared_ids(usable.select("doc_id", "print").join(classes.select("print", "rep"), "print")), "shared-ids")
    comps = None if shared.isEmpty() else connected_components(shared)
    tried, turn, pivots = None, 0, True
    while not active.isEmpty():
        members = active.join(outlines.hint("shuffle_hash"), "node").withColumn("cell", F.lit(0).cast("long"))
        members = members.withColumn("comp", F.col("node")) if comps is None else members.join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("component", "node"))
        if turn:
            members = members.withColumn("failed", F.lit(None).cast("array<long>"))
        if tried is not None:
            lost = tried.where("not good").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"))
            members = members.drop("failed").join(lost.groupBy(F.col("p.x").alias("node")).agg(F.collect_set("p.y").alias("failed")), "node", "left")
        names = _NAMES if turn else _NAMES[:-1]
        members = members.withColumnRenamed("node", "doc_id").select(*names)
        large = stash(active.groupBy("region").count().where(F.col("count") > region).select("region", F.lit(0).cast("long").alias("cell"), F.col("count").alias("n")), "large-regions")
        n_large = large.count()
        inside = members.join(small(large.select("region"), n_large), "region", "left_anti") if n_large else members
        if n_large and turn:
            cells, pivots = _cells(members.join(small(large.select("region"), n_large), "region", "left_semi"), percent, region, pivots)
            inside = inside.unionByName(cells)
        found = inside.repartition(*_KEY).sortWithinPartitions(*_KEY, "doc_id").mapInArrow(_join_cells(percent, max(0, turn - 1)), "region long, a long, b long")
        if n_large and not turn:
            found = found.unionByName(_behind_pivots(members, large, region).mapInArrow(_voronoi(percent, "star"), "region long, a long, b long"))
        proposed = stash(found.where("a <> b or a is null"), "proposed")
        pairs = proposed.where("a is not null").select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stash(pairs, "pairs")
        # Regions that are not through: those with pairs left out, and large ones whose pivots are linked so far.
        again = proposed.where("a is null").select("region")
        if n_large and not turn:
            again = again.unionByName(large.select("region"))
        if not pairs.isEmpty():
            checked = _verified(pairs, texts, nodes, k, percent)
            tried = stash(checked if tried is None else tried.unionByName(checked), "tried")
            comps = connected_components(tried.where("good").select("a", "b").unionByName(shared))
            again = again.unionByName(proposed.join(checked.where("not good"), ["a", "b"], "left_semi").select("region"))
        elif turn:
            break
        rest = active.join(again.distinct(), "region", "left_semi")
        if comps is not None:
            # Regions of one component are through.
            comp = rest.join(comps.withColumnRenamed("id", "node"), "node", "left").select("region", F.coalesce("component", "node").alias("comp"))
            open_ = comp.groupBy("region").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("region")
            rest = rest.join(open_, "region", "left_semi")
        rest = stash(rest, "regions")
        discard(proposed, pairs, large, active)
        active, turn = rest, turn + 1
    if comps is None:
        named = classes.select("print", F.col("low").alias("component_id"))
    else:
        own = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("print", "low", F.coalesce("component", "rep").alias("comp"))
        lows = own.groupBy("comp").agg(F.min("low").alias("component_id"))
        named = spread_join(stash(own, "named"), lows, "comp").select("print", "component_id")
    out = spread_join(profiles.select("doc_id", "size", "print"), named, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def keep_first(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; all columns stay. Texts without words stay, as do rows without a doc_id; of rows that share a doc_id all or none stay."""
    with scratch() as keep:
        later = keep(near_duplicates(docs, k, percent).where("component_id < doc_id").select(F.col("doc_id").alias("later")).distinct(), "later")
    # The rows travel as one struct, so that no column of theirs can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"))
    return rows.join(later.hint("shuffle_hash"), F.col("id") == F.col("later"), "left_anti").select("row.*")
