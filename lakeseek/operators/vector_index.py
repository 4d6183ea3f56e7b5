"""A stored vector index: rows in cells around centroids, cells pruned by distance.

Centroids are fitted on a bounded sample; every row is stored, in the folder of its
nearest centroid and in order of its distance from it (``away``).  By the triangle
inequality no row of a cell is nearer to a query than the query's distance from the
centroid less the cell's radius, so exact search reads the nearest cells, takes the n-th
distance found there as its bound, and then reads only the cells, and in them only the rings, that may hold something
nearer.  A metadata filter applies before the nearest are taken.  Approximate search stops after the first cells.

Distances are l2 or l2sq, or cosine, for which rows are compared by direction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeseek.operators import dense

#: Centroids are fitted on at most SAMPLE rows and SAMPLE_NUMBERS numbers; there are at most MOST_CELLS of them.
SAMPLE, SAMPLE_NUMBERS, ROUNDS, MOST_CELLS = 20_000, 4_000_000, 8, 4096
#: Cells whose rings are asked for one by one.
RINGS = 64
#: Numbers of the queries that go to all tasks at once (8 MB), their distances from centroids, and rows that are compared with a tile of them at once.
QUERY_NUMBERS, DISTANCES, ROWS = 1 << 20, 1 << 23, 2048
#: For the rounding of square roots and sums.
SLACK = 1e-9


def _fit(x: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds from rows drawn evenly from the sample."""
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        near = _nearest(x, centres)[0]
        for k in range(cells):
            own = x[near == k]
            if len(own):
                centres[k] = own.mean(0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of each row's nearest centre; the distance is computed from the difference, so that it is accurate."""
    rough = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    near = rough.argmin(1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(1))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assign(centres: np.ndarray, cosine: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column("embedding"))
                near, away = _nearest(_unit(x) if cosine else x, centres)
                yield pa.record_batch([*batch.columns, pa.array(near, pa.int32()), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return run


@dataclass(frozen=True)
class VectorIndex:
    """Handle on a stored index: rows(chunk_id, embedding, ..., cell, away), and its cells, at most MOST_CELLS, on the driver."""

    rows: DataFrame
    metric: str
    cells: np.ndarray
    centres: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def save(cls, vectors: DataFrame, path: str, cells: int | None = None, metric: str = "l2sq", sample: int = SAMPLE) -> None:
        """Index vectors(chunk_id, embedding, ...), all of one length, without nulls; about the root of their number is the number of cells if none is given."""
        if metric not in ("l2", "l2sq", "cosine"):
            raise ValueError(metric)
        spark = vectors.sparkSession
        n = vectors.count()
        size = len(vectors.select("embedding").first()[0]) if n else 1
        cells = min(cells or max(1, int(np.sqrt(n))), MOST_CELLS, max(n, 1))
        # The smallest hashes: a sample that reruns draw again.
        drawn = vectors.select("embedding", F.xxhash64("chunk_id").alias("lot"), "chunk_id").orderBy("lot", "chunk_id").limit(min(sample, max(cells, SAMPLE_NUMBERS // size)))
        x = np.array([r.embedding for r in drawn.collect()], np.float64).reshape(-1, size)
        centres = _fit(_unit(x) if metric == "cosine" else x, min(cells, len(x))) if len(x) else np.zeros((0, size))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", cell int, away double"
        made = vectors.mapInArrow(_assign(centres, metric == "cosine"), schema)
        # A cell with a third of all rows becomes several files.
        made.hint("rebalance", "cell").sortWithinPartitions("cell", "away").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        stored = spark.read.schema(made.schema).parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
        table = [(int(r.cell), [float(v) for v in centres[r.cell]], r.n, r.least, r.most, metric) for r in stored.collect()]
        spark.createDataFrame(table, "cell int, centre array<double>, n long, least double, most double, metric string").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        found = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)
        numbers = (np.array([r[c] for r in found]) for c in ("cell", "centre", "n", "least", "most"))
        return cls(spark.read.parquet(f"{path}/rows"), found[0].metric if found else "l2sq", *numbers)

    def _from(self, query: np.ndarray) -> np.ndarray:
        """The query's distance from each centre."""
        return np.sqrt(((self.centres - (_unit(query[None])[0] if self.metric == "cosine" else query)) ** 2).sum(1))

    def _reach(self, distance: float) -> float:
        """The distance between points, as the triangle inequality needs it, for one of the metric."""
        reach = {"l2": distance, "l2sq": np.sqrt(max(distance, 0)), "cosine": np.sqrt(2 * max(distance, 0))}[self.metric]
        return float(reach) * (1 + SLACK) + SLACK

    def _read(self, cells: np.ndarray) -> DataFrame:
        return self.rows.where(F.col("cell").isin(cells.tolist()))

    def search(self, query: list[float], n: int, condition: Column | None = None, probes: int | None = None) -> DataFrame:
        """rows with distance and dense_rank: the n nearest that meet the condition. With probes only that many cells are read, and rows may be missed; without, the result is exact."""
        d = self._from(np.array(query, np.float64)) if len(self.cells) else np.zeros(0)
        order = np.argsort(d, kind="stable")
        if probes is not None:
            return dense.knn(self._read(self.cells[order[:probes]]), query, n, condition, self.metric)
        read = 0
        bound = np.inf
        while read < len(order) and not np.isfinite(bound):
            # Nearest cells with twice the rows wanted; twice as many cells each time if the filter leaves too few.
            read = max(2 * read, int(np.searchsorted(np.cumsum(self.counts[order]), 2 * n)) + 1)
            found = [r.distance for r in dense.knn(self._read(self.cells[order[:read]]), query, n, condition, self.metric).select("distance").collect()]
            bound = self._reach(max(found)) if len(found) == n else np.inf
        first, rest = order[:read], order[read:]
        near = rest[np.maximum(d[rest] - self.most[rest], self.least[rest] - d[rest]) <= bound]
        parts = [self._read(self.cells[first])]
        if len(near):
            more = self._read(self.cells[near])
            if len(near) <= RINGS:
                more = more.where(reduce(lambda a, b: a | b, [(F.col("cell") == int(self.cells[i])) & F.col("away").between(float(d[i] - bound), float(d[i] + bound)) for i in near]))
            parts.append(more)
        return dense.knn(reduce(DataFrame.unionByName, parts), query, n, condition, self.metric)

    def search_many(self, queries: DataFrame, n: int, condition: Column | None = None, probes: int = 4, exact: bool = True) -> DataFrame:
        """(query_id, chunk_id, distance, dense_rank) for each of queries(query_id, query): the n nearest. Approximate search stops after ``probes`` cells.

        Queries go in blocks of at most QUERY_NUMBERS numbers to all tasks; rows stay where they are, and a task hands on about n rows a query.
        """
        rows = self.rows if condition is None else self.rows.where(condition)
        asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
        kinds = [f.dataType.simpleString() for f in (asked.schema["query_id"], self.rows.schema["chunk_id"])]
        found = [queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, chunk_id {kinds[1]}, distance double")]
        most = max(1, min(QUERY_NUMBERS // max(1, self.centres.shape[-1]), DISTANCES // max(1, len(self.cells))))
        blocks = -(-asked.count() // most) if len(self.cells) else 0
        for b in range(blocks):
            some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            table = some.toArrow().combine_chunks()  # of bounded size, as a broadcast's is
            if table.num_rows:
                x = _rows(table.column("query").chunk(0))
                found.append(self._met(rows, table.column("query_id").chunk(0), kinds[0], x, self._visits(rows, x, n, probes, exact), n))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
        return reduce(DataFrame.unionByName, found[1:] or found).withColumn("dense_rank", rank.cast("long")).where(F.col("dense_rank") <= n)

    def _visits(self, rows: DataFrame, x: np.ndarray, n: int, probes: int, exact: bool) -> np.ndarray:
        """Which cells each of the queries x has to see: the nearest, and for exact search all that the n-th distance found there reaches."""
        d = np.stack([self._from(q) for q in x])
        near = np.zeros(d.shape, bool)
        np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
        if not exact:
            return near
        met = self._met(rows, pa.array(np.arange(len(x))), "long", x, near, n)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance"))
        far = met.withColumn("rank", rank).where(F.col("rank") == n).select("query_id", "distance").toArrow()  # a row a query of the block
        # A query with fewer rows so far sees everything.
        bound = np.full(len(x), np.inf)
        bound[far.column("query_id").to_numpy()] = [self._reach(v) for v in far.column("distance").to_pylist()]
        return near | (np.maximum(d - self.most, self.least - d) <= bound[:, None])

    def _met(self, rows: DataFrame, names: pa.Array, kind: str, x: np.ndarray, visits: np.ndarray, n: int) -> DataFrame:
        """(query_id, chunk_id, distance) of the rows that may be among the n nearest of a query in the cells that it visits."""
        key = rows.schema["chunk_id"].dataType.simpleString()
        seen = visits.any(0)
        some = rows if seen.all() else rows.where(F.col("cell").isin(self.cells[seen].tolist()))
        run = _compare(names, x, np.packbits(visits, axis=0), self.cells, n, self.metric)
        return some.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), "cell").mapInArrow(run, f"query_id {kind}, chunk_id {key}, distance double")


def _compare(names: pa.Array, queries: np.ndarray, visits: np.ndarray, cells: np.ndarray, n: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of cells against the queries that visit the cell (bits of visits[:, cell]): matrix products say which may be among the n nearest that the task has met, and these are measured by their differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(c): k for k, c in enumerate(cells)}
        own = (queries**2).sum(1)
        best, widest = np.full((len(queries), n), np.inf), 0.0  # rough distances of the n nearest so far, and the largest square
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cell = _rows(batch.column("embedding")), batch.column("cell").to_numpy()
            size = (x**2).sum(1)
            widest = max(widest, float(size.max()))
            cuts = np.r_[0, 1 + np.flatnonzero(np.diff(cell)), len(cell)]
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                asking = np.flatnonzero(np.unpackbits(visits[:, place[int(cell[start])]], count=len(queries)))
                for s in range(start, end, ROWS):
                    e = min(s + ROWS, end)
                    for t in range(0, len(asking), dense.TILE):
                        j = asking[t : t + dense.TILE]
                        dot = queries[j] @ x[s:e].T
                        if metric == "cosine":
                            rough, slack = -dot / np.sqrt(own[j, None] * size[None, s:e]), np.full(len(j), SLACK)
                        else:
                            rough, slack = own[j, None] + size[None, s:e] - 2 * dot, SLACK * (widest + own[j])
                        a, b = np.nonzero(rough <= (best[j].max(1) + slack)[:, None])
                        if not len(a):
                            continue
                        changed = np.unique(a)
                        limit = np.full(len(j), -np.inf)
                        best[j[changed]] = np.partition(np.concatenate([best[j[changed]], rough[changed]], axis=1), n - 1, axis=1)[:, :n]
                        limit[changed] = best[j[changed]].max(1)
                        kept = rough[a, b] <= (limit + slack)[a]
                        a, b = j[a[kept]], s + b[kept]
                        u, v = x[b], queries[a]
                        if metric == "cosine":
                            distance = 1 - (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1))
                        else:
                            distance = ((u - v) ** 2).sum(1)
                            distance = np.sqrt(distance) if metric == "l2" else distance
                        yield pa.record_batch([names.take(pa.array(a)), batch.column("chunk_id").take(pa.array(b)), pa.array(distance)], ["query_id", "chunk_id", "distance"])

    return run


def recall(index: VectorIndex, queries: DataFrame, n: int, probes: int) -> float:
    """The share of the n nearest of queries(query_id, query) that approximate search finds, against exact search."""
    exact = index.search_many(queries, n).select("query_id", "chunk_id")
    found = index.search_many(queries, n, probes=probes, exact=False).select("query_id", "chunk_id")
    whole = exact.count()
    return exact.join(found, ["query_id", "chunk_id"], "left_semi").count() / whole if whole else 1.0
