"""Nearest neighbours by a full scan, exact.

`exact_knn` answers a stated batch of queries in one pass over the rows for every BLOCK of them, all in one plan: a task
multiplies each Arrow batch with the queries in tiles of bounded size and keeps its k best per query, and k rows per task
and query are shuffled. `pairwise` is the same distance as a plain column expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.config import METRICS
from skein.errors import QueryError
from skein.functions import vectors as V
from skein.operators.topk import DECIMALS, Smallest, check_k, found_schema, id_array, matrix, merged, tiles

#: Queries that are sent to a task at a time; a larger batch takes a pass over the rows for each so many.
BLOCK = 4096


def normalized(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), V.TINY)[:, None]


def distances(metric: str, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distance of each query (row) to each row (column); for cosine both sides have length 1."""
    product = q @ rows.T
    if metric == "cosine":
        out = 1.0 - product
    elif metric == "dot":
        out = -product
    else:
        # The expanded square loses what cancels, so near pairs are summed directly.
        qq, rr = np.einsum("ij,ij->i", q, q)[:, None], np.einsum("ij,ij->i", rows, rows)[None, :]
        out = np.maximum(qq + rr - 2.0 * product, 0.0)
        i, j = np.nonzero(out <= 1e-3 * (qq + rr))
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            out[a, b] = np.square(q[a] - rows[b]).sum(axis=1)
    return np.round(out, DECIMALS)


def query_blocks(queries: DataFrame, qid: str, vector: str, block: int = BLOCK) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and vectors of the queries, a block at a time; a query that isn't a finite vector is an error."""
    ids: list = []
    rows: list = []
    for r in queries.select(F.col(qid), F.col(vector)).toLocalIterator():
        if r[1] is None or any(x is None for x in r[1]) or not np.isfinite(r[1]).all() or (rows and len(r[1]) != len(rows[0])):
            raise QueryError(f"query {r[0]!r} isn't a vector of the right size")
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == block:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def _scan(rows: DataFrame, names: list, kind: T.DataType, q: np.ndarray, k: int, metric: str, block: int) -> DataFrame:
    """Per task, the k nearest rows `(id, vector)` of each query."""
    shape, to_arrow = found_schema(kind, rows.schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Smallest(len(q), k)
        for batch in batches:
            values, at = matrix(batch.column(1), q.shape[1])
            if not len(at):
                continue
            ids = id_array(batch.column(0))[at]
            values = normalized(values) if metric == "cosine" else values
            for some in tiles(len(q), len(at), block):
                kept.add(some, distances(metric, q[some], values), ids)
        yield kept.table(to_arrow, names)

    return rows.mapInArrow(run, shape)


def ranked(scans: list[DataFrame], k: int, metric: str) -> DataFrame:
    """`(qid, id, distance, score, rank)` of what the tasks yield."""
    return merged(scans, k).select("qid", "id", "distance", V.score(metric, F.col("distance")).alias("score"), "rank")


def exact_knn(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", *, id: str = "id", vector: str = "vector", qid: str = "qid", query: str = "vector", block: int = BLOCK) -> DataFrame:
    """The `k` nearest rows of every query: `(qid, id, distance, score, rank)`, ties by id.

    `rows` may be filtered before; only its id and vector are read. Rows whose vector is null, of another size or not
    finite are never found; ids are longs, ints or strings and not null. An empty side gives no rows, k = 0 too. `block`
    bounds the queries of one matrix product.
    """
    if metric not in METRICS:
        raise QueryError(f"metric is one of {METRICS}")
    check_k(k)
    narrow = rows.select(F.col(id).alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    kind = queries.schema[qid].dataType
    scans = [_scan(narrow, ids, kind, normalized(q) if metric == "cosine" else q, k, metric, block) for ids, q in (query_blocks(queries, qid, query) if k else ())]
    return ranked(scans, k, metric) if scans else empty_result(rows, queries, id, qid)


def empty_result(rows: DataFrame, queries: DataFrame, id: str, qid: str) -> DataFrame:
    """A result of no rows: `(qid, id, distance, score, rank)`."""
    kinds = {"qid": queries.schema[qid].dataType, "id": rows.schema[id].dataType, "distance": T.DoubleType(), "score": T.DoubleType(), "rank": T.LongType()}
    return rows.sparkSession.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in kinds.items()]))


def nearest(rows: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", *, id: str = "id", vector: str = "vector") -> DataFrame:
    """The `k` nearest rows of one query in plain expressions, all columns kept: `distance`, `score`, nearest first."""
    q = F.array(*(F.lit(float(x)) for x in query))
    found = rows.where(V.is_valid(F.col(vector), len(query))).withColumn("distance", F.round(V.distance(metric, q, F.col(vector)), DECIMALS))
    return found.orderBy("distance", id).limit(check_k(k)).withColumn("score", V.score(metric, F.col("distance")))


def pairwise(pairs: DataFrame, a: str, b: str, metric: str, out: str = "distance") -> DataFrame:
    """`pairs` with the distance of its two vector columns."""
    return pairs.withColumn(out, V.distance(metric, F.col(a), F.col(b)))
