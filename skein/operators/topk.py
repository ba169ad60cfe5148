"""Best k per query, and batches of queries small enough for a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skein.errors import QueryError

#: Distances tie when they agree to so many decimals: equal vectors then tie in whatever order they were summed.
DECIMALS = 9
#: Elements of one matrix of distances. A batch of rows meets the queries in tiles of so many, which bounds a task's memory.
TILE = 1 << 20


def check_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise QueryError(f"k is a whole number of 0 or more, not {k!r}")
    return k


def best(df: DataFrame, k: int, order: Sequence[Column], by: str = "qid") -> DataFrame:
    """The first `k` rows per `by` in the given order, with their `rank` from 1. Partitions cut their own rows first."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", place).where(F.col("rank") <= check_k(k)).withColumn("rank", F.col("rank").cast("long"))


class Smallest:
    """The k smallest (distance, id) per query over any number of tiles of distances. Memory is k rows a query and a few
    tiles, however many rows there are."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.bounds = np.full(queries, np.inf)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, queries: np.ndarray, distances: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> None:
        """Takes distances (query, row) of the queries at these positions to the rows with these ids; NaN is no pair.
        `more` are other numbers of the same pairs, which are kept with them."""
        near = distances <= self.bounds[queries, None]
        if np.count_nonzero(near) > 4 * self.k * len(queries):
            last = np.partition(distances, self.k - 1, axis=1)[:, self.k - 1]
            near &= distances <= np.where(np.isnan(last), np.inf, last)[:, None]
        at, row = np.nonzero(near)
        if not len(at):
            return
        self.kept.append((queries[at], distances[at, row], ids[row], *(m[at, row] for m in more)))
        self.waiting += len(at)
        if self.waiting > max(2 * self.k * len(self.bounds), TILE >> 4):
            self._merge()

    def _merge(self) -> None:
        q, d, i, *more = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        order = np.lexsort((i, d, q))
        n = np.bincount(q, minlength=len(self.bounds))
        order = order[np.arange(len(q)) - (np.cumsum(n) - n)[q[order]] < self.k]
        q, d, i = q[order], d[order], i[order]
        full = np.flatnonzero(n >= self.k)
        self.bounds[full] = d[np.cumsum(np.minimum(n, self.k))[full] - 1]
        self.kept, self.waiting = [(q, d, i, *(m[order] for m in more))], 0

    def table(self, schema: pa.Schema, names: list) -> pa.RecordBatch:
        """Columns (query position, the query's name, id, distance, more)."""
        if not self.kept:
            return pa.RecordBatch.from_pylist([], schema)
        self._merge()
        q, d, i, *more = self.kept[0]
        of = pa.array(names, schema.field(1).type)
        return pa.record_batch([pa.array(q, pa.int32()), of.take(pa.array(q)), pa.array(i.tolist(), schema.field(2).type), *(pa.array(x, pa.float64()) for x in (d, *more))], schema=schema)


def found_schema(qid: T.DataType, id: T.DataType, *more: str) -> tuple[T.StructType, pa.Schema]:
    """What a task yields: `Smallest.table`, for Spark and for Arrow."""
    fields = {"_q": T.IntegerType(), "qid": qid, "id": id} | {n: T.DoubleType() for n in ("distance", *more)}
    return T.StructType([T.StructField(n, t) for n, t in fields.items()]), pa.schema([(n, to_arrow_type(t)) for n, t in fields.items()])


def merged(scans: Sequence[DataFrame], k: int) -> DataFrame:
    """The k best, with `rank`, of what the tasks of all passes yield: one shuffle of k rows a task and query. Queries are
    told apart by pass and position."""
    passes = [s.withColumn("_q", F.struct(F.lit(n).alias("pass"), F.col("_q").alias("at"))) for n, s in enumerate(scans)]
    return best(reduce(DataFrame.unionByName, passes), k, [F.col("distance"), F.col("id")], by="_q")


def tiles(queries: int, rows: int, block: int) -> Iterator[np.ndarray]:
    """Positions of the queries, at most `block` at a time and no more than make a tile with so many rows."""
    step = max(1, min(block, TILE // max(rows, 1)))
    for at in range(0, queries, step):
        yield np.arange(at, min(at + step, queries))


def id_array(column: pa.Array) -> np.ndarray:
    """Ids as NumPy values that sort; those of several fields by these in order."""
    if pa.types.is_struct(column.type):
        parts = {f.name: id_array(column.field(n)) for n, f in enumerate(column.type)}
        out = np.empty(len(column), [(n, p.dtype) for n, p in parts.items()])
        for n, p in parts.items():
            out[n] = p
        return out
    return np.array(column.to_pylist(), dtype=str) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are vectors of `dim` finite numbers, and their positions; others are left out."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == dim)
    rows = column.take(pa.array(good))
    flat = rows.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    finite = np.isfinite(values).all(axis=1)  # a null component reads as NaN
    return values[finite], good[finite]
