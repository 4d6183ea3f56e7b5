"""Centroid clustering of integer vectors by partial-distance search.

Components become integers, so distances and means are exact and every run gives the
same rows. In each round a task looks for the nearest centroid of its vectors:
squared differences are first summed over the dimensions of highest variance; the centroid
that is nearest so far is finished and its distance is the best; the others go on
STEP dimensions at a time and are abandoned for a vector once their sum is strictly above its best.
What survives has gone through all dimensions, so ties are seen and go to the smaller number.

Vectors are stored once, packed, in the shared folder; each round is one scan of them with the few centroids
in the task, from which one row a task and cluster comes back (its number of vectors and sums).
Vectors never move, whatever the size of a cluster, and rounds end early once no centroid changes, for
later rounds would change nothing.

Defined results: vectors that are null, have another length, or hold null or non-finite components give
no row. Repeated rows are vectors of their own; rows without a vec_id are clustered, and start
centroids only if there are too few others. With fewer vectors than centroids there are as many centroids
as vectors. A component of MOST or more in size after scaling raises, for its distances would go beyond 64 bits.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import discard, ship, stash

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
FIRST, STEP, MOST = 16, 16, 1 << 27
Batches = Iterator[pa.RecordBatch]


def _pack(dimensions: int, scale: int) -> Callable[[Batches], Batches]:
    """Vectors of that many finite components, as packed 32-bit integers."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            column = batch.column("embedding")
            fit = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False))
            flat = fit.column("embedding").flatten().cast(pa.float64())
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            good = np.isfinite(x).all(1)
            whole = np.floor(x[good] * scale)
            if (np.abs(whole) >= MOST).any():
                raise ValueError(f"a component of {MOST} or more after scaling: squared distances would go beyond 64 bits")
            packed = whole.astype("<i4")
            yield pa.record_batch([fit.column("vec_id").filter(pa.array(good)), pa.array([row.tobytes() for row in packed], pa.binary())], ["vec_id", "x"])

    return run


def _matrix(column: pa.Array, order: np.ndarray) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), len(order))
    return rows[:, order].astype(np.int64)


def _squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    away = x - centre
    return (away * away).sum(1)


def nearest(x: np.ndarray, centres: np.ndarray, first: int = FIRST, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centre of each row; columns of both stand in order of falling variance."""
    part = np.stack([_squares(x[:, :first], c[:first]) for c in centres], 1)
    near = part.argmin(1)
    best = part[np.arange(len(x)), near] + ((x[:, first:] - centres[near, first:]) ** 2).sum(1)
    for k, centre in enumerate(centres):
        live = np.flatnonzero((part[:, k] <= best) & (near != k))
        so_far = part[live, k]
        for a in range(first, x.shape[1], step):
            so_far = so_far + _squares(x[live, a : a + step], centre[a : a + step])
            on = so_far <= best[live]
            live, so_far = live[on], so_far[on]
        won = (so_far < best[live]) | (k < near[live])
        near[live[won]], best[live[won]] = k, so_far[won]
    return near, best


def _moments(dimensions: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        n, s, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            x = _matrix(batch.column("x"), np.arange(dimensions)).astype(np.float64)
            n, s, squares = n + len(x), s + x.sum(0), squares + (x * x).sum(0)
        yield pa.record_batch([pa.array(range(dimensions), pa.int32()), pa.array([n] * dimensions, pa.int64()), pa.array(s), pa.array(squares)], ["d", "n", "s", "squares"])

    return run


def _sums(centres: np.ndarray, order: np.ndarray) -> Callable[[Batches], Batches]:
    """One row for each cluster that a task's vectors fall into."""

    def run(batches: Batches) -> Batches:
        counts, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), order)
                near, _ = nearest(x, centres)
                counts += np.bincount(near, minlength=len(centres))
                for k in np.unique(near).tolist():
                    sums[k] += x[near == k].sum(0)
        met = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(met, pa.int32()), pa.array(counts[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assign(centres: np.ndarray, order: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                near, best = nearest(_matrix(batch.column("x"), order), centres)
                yield pa.record_batch([batch.column("vec_id"), pa.array(near, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])

    return run


def _order(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """The dimensions by falling variance. Only the work depends on it, no result."""
    moments = vectors.select("x").mapInArrow(_moments(dimensions), "d int, n long, s double, squares double").groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "s", "squares")])
    spread = {r.d: r.squares / max(r.n, 1) - (r.s / max(r.n, 1)) ** 2 for r in moments.collect()}
    return np.array(sorted(range(dimensions), key=lambda d: (-spread.get(d, 0.0), d)))


def _means(vectors: DataFrame, centres: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centres moved to the floor of their vectors' mean; those without vectors stay. clusters * dimensions rows come back."""
    parts = vectors.select("x").mapInArrow(_sums(centres, order), "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s"))
    totals = each.groupBy("cluster", "d").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    moved = centres.copy()
    for r in totals.collect():
        moved[r.cluster, r.d] = int(r.s) // int(r.n)
    return moved


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per usable row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    packed = stash(rows.mapInArrow(_pack(dimensions, scale), "vec_id long, x binary"), "packed-vectors")
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = packed.select("x", lot.alias("lot")).orderBy(F.col("lot").asc_nulls_last(), "x").limit(clusters).collect()
    order = _order(packed, dimensions)
    centres = np.array([np.frombuffer(r.x, "<i4")[order] for r in first], np.int64).reshape(-1, dimensions)
    for _ in range(rounds if len(first) else 0):
        moved = _means(packed, centres, order)
        if (moved == centres).all():
            break
        centres = moved
    assigned = stash(packed.mapInArrow(_assign(centres, order), "vec_id long, cluster int, distance long"), "clusters")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    discard(packed)
    natural = np.empty_like(centres)
    natural[:, order] = centres
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in natural.tolist()]
    known = spark.createDataFrame([(k, s, sum(sums.values()), digest[k]) for k, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
