"""Seeded vectors for benchmarks: plain normal, clustered, and queries near given rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.vectors import normalize


def _normals(dim: int, seed: int):
    """An array of `dim` normal draws that depends on the row's id and the seed only (Box-Muller over hashes)."""
    uniform = lambda i, salt: (F.shiftrightunsigned(F.xxhash64("id", i, F.lit(seed), F.lit(salt)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.sqrt(-2.0 * F.log(uniform(i, 0))) * F.cos(2.0 * np.pi * uniform(i, 1)))


def _unit(df: DataFrame, unit: bool) -> DataFrame:
    return df.withColumn("vector", (normalize(F.col("vector")) if unit else F.col("vector")).cast("array<float>"))


def random_vectors(spark: SparkSession, n: int, dim: int, *, seed: int = 0, unit: bool = True) -> DataFrame:
    """`(id, vector)` with normal components."""
    return _unit(spark.range(n).withColumn("vector", _normals(dim, seed)), unit)


def clustered_vectors(spark: SparkSession, n: int, dim: int, *, clusters: int = 64, spread: float = 0.15, seed: int = 0, unit: bool = True) -> DataFrame:
    """`(id, cluster, vector)`: normal clouds around `clusters` random centres of unit length."""
    centers = np.random.default_rng(seed).normal(size=(clusters, dim))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster int, center array<double>")
    rows = spark.range(n).withColumn("cluster", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(7)), F.lit(clusters)).cast("int")).withColumn("noise", _normals(dim, seed + 1))
    rows = rows.join(F.broadcast(table), "cluster")  # as many rows as clusters
    return _unit(rows.select("id", "cluster", F.zip_with("center", "noise", lambda c, x: c + spread * x).alias("vector")), unit)


def near_queries(rows: DataFrame, count: int, *, seed: int = 1, jitter: float = 0.05, unit: bool = True) -> DataFrame:
    """`(qid, vector)`: the `count` rows with the smallest hash, each moved a little."""
    dim = len((rows.select("vector").first() or [[0.0]])[0])
    picked = rows.select("id", "vector").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count).withColumn("noise", _normals(dim, seed))
    return _unit(picked.select(F.col("id").alias("qid"), F.zip_with("vector", "noise", lambda v, x: v.cast("double") + jitter * x).alias("vector")), unit)
