"""Recall and latency figures of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_per_query(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """`(qid, recall)`: the share of k that `found` has in common with `truth`; both are `(qid, id, ...)`."""
    common = found.select("qid", "id").join(truth.select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("n"))
    return truth.select("qid").distinct().join(common, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("recall"))


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the mean recall over the queries of `truth`."""
    return recall_per_query(found, truth, k).agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"))


def latency(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Per `by`: n, p50 (the interpolated median), p95 and p99 (see `nearest_ranks`), qps (n over the sum)."""
    ranks = nearest_ranks(samples, by, value, (0.95, 0.99))
    base = samples.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("p50"), (F.count("*") / F.sum(value)).alias("qps"))
    return base.join(ranks, by).select(by, "n", "p50", F.col("p0").alias("p95"), F.col("p1").alias("p99"), "qps")


def nearest_ranks(samples: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Per `by`, for each share p the value at position floor(n * p), from 0, of the sorted values (the last at most).

    Repeated values are counted first, and running counts are taken over the distinct ones.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(by)
    upto = counts.withColumn("_end", F.sum("_n").over(whole.orderBy("_v"))).withColumn("_all", F.sum("_n").over(whole))
    at = lambda p: F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(p)))
    pick = lambda p: F.min(F.when(F.col("_end") > at(p), F.col("_v")))
    return upto.groupBy(by).agg(*(pick(p).alias(f"p{i}") for i, p in enumerate(shares)))
