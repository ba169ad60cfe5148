"""Product quantisation: a vector as a few small codes, searched by tables of partial distances.

A codebook is an array (subspaces, codes, width). Codes are an array<smallint>, one per subspace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.config import PqConfig
from skein.errors import ConfigError, QueryError
from skein.functions import vectors as V
from skein.operators.ivf import kmeans, training_sample
from skein.operators.knn import BLOCK, distances, empty_result, normalized, query_blocks, ranked
from skein.operators.topk import DECIMALS, Smallest, best, check_k, found_schema, id_array, matrix, tiles


def train_codebook(rows: DataFrame, config: PqConfig | None = None, metric: str = "cosine", *, id: str = "id", vector: str = "vector") -> np.ndarray:
    """A codebook fitted on `config.train_sample` rows at most, one k-means per subspace."""
    config = config or PqConfig()
    sample = training_sample(rows, config.train_sample, id, vector)
    if not len(sample):
        raise QueryError("a codebook needs rows to learn from")
    return fit_codebook(normalized(sample) if metric == "cosine" else sample, config)


def fit_codebook(sample: np.ndarray, config: PqConfig) -> np.ndarray:
    if sample.shape[1] % config.subvectors:
        raise ConfigError("the dimension must be a multiple of subvectors")
    parts = np.split(sample, config.subvectors, axis=1)
    return np.stack([kmeans(p, config.centroids, config.train_iters, config.seed + s)[0] for s, p in enumerate(parts)])


def encode_matrix(values: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Codes of the rows: per subspace the nearest centroid, the first of equals."""
    parts = np.split(values, len(book), axis=1)
    return np.stack([distances("l2", p, b).argmin(axis=1) for p, b in zip(parts, book, strict=True)], axis=1)


def decode_matrix(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.concatenate([book[s][codes[:, s]] for s in range(len(book))], axis=1)


def encode(vector: Column, book: np.ndarray, metric: str = "cosine") -> Column:
    """The codes of a vector (of unit length under cosine); null for what is no finite vector of that size."""
    dim = book.shape[0] * book.shape[2]

    @F.arrow_udf("array<smallint>")
    def of(column: pa.Array) -> pa.Array:
        values, at = matrix(column, dim)
        codes = encode_matrix(normalized(values) if metric == "cosine" else values, book) if len(at) else np.zeros((0, len(book)), int)
        has = np.zeros(len(column), bool)
        has[at] = True
        ends = np.concatenate([[0], np.cumsum(has * len(book))]).astype(np.int32)
        offsets = pa.array(ends, pa.int32(), mask=np.append(~has, False))
        return pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1).astype(np.int16)))

    return of(vector)


def decode(codes: Column, book: np.ndarray) -> Column:
    """The vector that codes stand for: their centroids, end to end."""
    tables = F.array(*(F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in b)) for b in book)) if book.size <= 4096 else None
    if tables is not None:
        return F.flatten(F.transform(codes, lambda c, s: F.get(F.get(tables, s), c.cast("int"))))

    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([None if c is None else decode_matrix(np.array([c]), book)[0] for c in column.to_pylist()], pa.list_(pa.float64()))

    return of(codes)


def query_tables(q: np.ndarray, book: np.ndarray, metric: str) -> np.ndarray:
    """Partial distances (query, subspace, code) of queries to centroids; with 1 added once under cosine."""
    parts = np.split(q, len(book), axis=1)
    by = "l2" if metric == "l2" else "dot"
    tables = np.stack([distances(by, p, b) for p, b in zip(parts, book, strict=True)], axis=1)
    if metric == "cosine":
        tables[:, 0, :] += 1.0
    return tables


def adc(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Approximate distances (query, row) from `query_tables`."""
    return np.round(sum(tables[:, s, :][:, codes[:, s]] for s in range(codes.shape[1])), DECIMALS)


def centroid_tables(book: np.ndarray, metric: str) -> np.ndarray:
    """Partial distances (subspace, code, code) between centroids, for distances between codes."""
    by = "l2" if metric == "l2" else "dot"
    return np.stack([distances(by, b, b) for b in book])


def sdc(a: np.ndarray, b: np.ndarray, tables: np.ndarray, metric: str) -> np.ndarray:
    """Distances (row of `a`, row of `b`) between codes, from `centroid_tables`."""
    return (1.0 if metric == "cosine" else 0.0) + sum(tables[s][a[:, s]][:, b[:, s]] for s in range(len(tables)))


def adc_knn(coded: DataFrame, queries: DataFrame, book: np.ndarray, k: int = 10, metric: str = "cosine", *, id: str = "id", codes: str = "codes", qid: str = "qid", query: str = "vector", block: int = BLOCK) -> DataFrame:
    """The `k` rows of the least approximate distance to every query: the columns of `exact_knn`. Only ids and codes
    are read; k rows a task and query are shuffled."""
    check_k(k)
    shape, to_arrow = found_schema(queries.schema[qid].dataType, coded.schema[id].dataType)
    narrow = coded.select(F.col(id).alias("id"), F.col(codes).alias("codes")).where("id IS NOT NULL AND codes IS NOT NULL")
    scans = []
    for ids, raw in query_blocks(queries, qid, query) if k else ():
        tables = query_tables(normalized(raw) if metric == "cosine" else raw, book, metric)

        def run(batches: Iterator[pa.RecordBatch], asked: list = ids, tables: np.ndarray = tables) -> Iterator[pa.RecordBatch]:
            kept = Smallest(len(tables), k)
            for batch in batches:
                values, at = matrix(batch.column(1), len(book))
                if len(at):
                    given, names = values.astype(np.int64), id_array(batch.column(0))[at]
                    for some in tiles(len(tables), len(at), block):
                        kept.add(some, adc(given, tables[some]), names)
            yield kept.table(to_arrow, asked)

        scans.append(narrow.mapInArrow(run, shape))
    return ranked(scans, k, metric) if scans else empty_result(coded, queries, id, qid)


def rerank(candidates: DataFrame, rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", *, id: str = "id", vector: str = "vector", qid: str = "qid", query: str = "vector") -> DataFrame:
    """The `k` best candidates `(qid, id)` by their exact distance: an equi-join back to the full vectors."""
    asked = queries.select(F.col(qid).alias("qid"), F.col(query).alias("_q"))
    full = rows.select(F.col(id).alias("id"), F.col(vector).alias("_v"))
    found = candidates.select("qid", "id").join(full, "id").join(asked, "qid")
    found = found.withColumn("distance", F.round(V.distance(metric, F.col("_q"), F.col("_v")), DECIMALS)).drop("_q", "_v")
    return best(found, k, [F.col("distance"), F.col("id")]).select("qid", "id", "distance", V.score(metric, F.col("distance")).alias("score"), "rank")


def two_stage(coded: DataFrame, queries: DataFrame, book: np.ndarray, k: int = 10, metric: str = "cosine", factor: int = 8, *, id: str = "id", vector: str | None = "vector", codes: str = "codes", qid: str = "qid", query: str = "vector") -> DataFrame:
    """`k * factor` candidates by codes, then the `k` best of them by full vectors; without full vectors (`vector`
    None) by the vectors that the codes stand for."""
    rows = coded if vector else coded.withColumn("_decoded", decode(F.col(codes), book))
    near = adc_knn(coded, queries, book, k * factor, metric, id=id, codes=codes, qid=qid, query=query)
    return rerank(near, rows, queries, k, metric, id=id, vector=vector or "_decoded", qid=qid, query=query)


def memory(rows: int, dim: int, config: PqConfig) -> dict:
    """Bytes of codes and of full vectors, and how many times smaller codes are."""
    code, full = rows * config.subvectors, rows * dim * 4
    return {"code_bytes": code, "memory_bytes": code + (full if config.keep_originals else 0), "compression_ratio": 4.0 * dim / config.subvectors}
