"""Vector search: exact distances, filter before ranking; one query in the JVM, many as matrix products in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper distances of the confidence bands, and what a match in each is worth: fixed values.
BANDS = ((1.45, 1.0), (1.55, 0.85), (1.65, 0.55), (1.75, 0.20))
#: Queries that are broadcast at once; of 768 doubles each that is 6 MB.
QUERY_BLOCK = 1024
#: Queries that a task compares with a batch at once.
TILE = 256


def _sum(a: Column, b: Column, each: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, each), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """l2sq, l2, cosine or ip distance of two double arrays."""
    dot = lambda x, y: _sum(x, y, lambda p, q: p * q)
    if metric in ("l2sq", "l2"):
        square = _sum(a, b, lambda p, q: (p - q) * (p - q))
        return F.sqrt(square) if metric == "l2" else square
    if metric == "ip":
        return 1 - dot(a, b)
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    raise ValueError(metric)


def knn(vectors: DataFrame, query: list[float], n: int, condition: Column | None = None, metric: str = "l2sq") -> DataFrame:
    """vectors columns with distance and dense_rank: the n nearest of those that meet the condition. Each task keeps its n best."""
    rows = vectors if condition is None else vectors.where(condition)
    vector = F.array(*map(F.lit, query))
    near = rows.withColumn("distance", distance(F.col("embedding").cast("array<double>"), vector, metric)).orderBy("distance", "chunk_id").limit(n)
    return near.withColumn("dense_rank", F.row_number().over(Window.orderBy("distance", "chunk_id")).cast("long"))


def _best(names: pa.Array, queries: np.ndarray, n: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch of vectors the n best for each query. A matrix product says which can be among them; only these are measured by their differences, so that equal vectors have equal distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (queries**2).sum(1)
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), queries.shape[1]), False))
            if not batch.num_rows:
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            size = (x**2).sum(1)
            for s in range(0, len(queries), TILE):
                q = queries[s : s + TILE]
                dot = x @ q.T
                if metric in ("l2", "l2sq"):
                    rough, slack = size[:, None] + own[None, s : s + TILE] - 2 * dot, 1e-9 * (size.max() + own[s : s + TILE])
                elif metric == "ip":
                    rough, slack = -dot, 1e-9 * np.sqrt(size.max() * own[s : s + TILE])
                else:
                    rough, slack = -dot / np.sqrt(size[:, None] * own[None, s : s + TILE]), np.full(len(q), 1e-9)
                limit = np.partition(rough, n - 1, axis=0)[n - 1] if len(x) > n else np.full(len(q), np.inf)
                i, j = np.nonzero(rough <= limit + slack)
                u, v = x[i], q[j]
                if metric in ("l2", "l2sq"):
                    exact = ((u - v) ** 2).sum(1)
                    exact = np.sqrt(exact) if metric == "l2" else exact
                else:
                    exact = 1 - (u * v).sum(1) / (1 if metric == "ip" else np.sqrt((u * u).sum(1) * (v * v).sum(1)))
                yield pa.record_batch([names.take(pa.array(j + s)), batch.column("chunk_id").take(pa.array(i)), pa.array(exact)], ["query_id", "chunk_id", "distance"])

    return run


def knn_batch(vectors: DataFrame, queries: DataFrame, n: int, metric: str = "l2sq", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, chunk_id, distance, dense_rank) for each of queries(query_id, query): in blocks of about ``block`` queries, each in every task at once, against all rows; a batch of rows keeps n a query, a task n before the shuffle. Queries and vectors without numbers find and are nothing."""
    if metric not in ("l2", "l2sq", "cosine", "ip"):
        raise ValueError(metric)
    asked = queries.where(F.size("query") > 0).select("query_id", F.col("query").cast("array<double>").alias("query"))
    blocks = max(1, -(-asked.count() // block))
    rows = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = [f.dataType.simpleString() for f in (asked.schema["query_id"], rows.schema["chunk_id"])]
    schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, distance double"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    found = [vectors.sparkSession.createDataFrame([], schema)]
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        table = some.toArrow()  # of bounded size, as a broadcast's is
        # One length at a time: rows of another one aren't comparable.
        lengths = pc.list_value_length(table.column("query"))
        for size in pc.unique(lengths).to_pylist():
            part = table.filter(pc.equal(lengths, size)).combine_chunks()
            matrix = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part.column("query").chunks]).reshape(-1, size)
            names = part.column("query_id").chunk(0) if part.column("query_id").num_chunks == 1 else pa.concat_arrays(part.column("query_id").chunks)
            found.append(rows.mapInArrow(_best(names, matrix, n, metric), schema))
    every = reduce(DataFrame.unionByName, found[1:] or found)
    return every.withColumn("dense_rank", rank.cast("long")).where(F.col("dense_rank") <= n)


def confidence(distance_: Column) -> Column:
    out = None
    for limit, value in BANDS:
        out = F.when(distance_ <= limit, value) if out is None else out.when(distance_ <= limit, value)
    return out.otherwise(0.0)
