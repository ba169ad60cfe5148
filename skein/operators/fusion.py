"""Fusion of ranked lists `(qid, id, score, rank)` into one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.topk import DECIMALS, best

RRF_K = 60.0


def _weights(lists: Sequence, weights: Sequence[float] | None) -> list[float]:
    out = [float(w) for w in weights or [1.0] * len(lists)]
    if len(out) != len(lists):
        raise ValueError(f"{len(lists)} lists but {len(out)} weights")
    return out


def _union(lists: Sequence[DataFrame], value: list) -> DataFrame:
    # ranks stay per list, so ties keep the order of first sight: list by list, then by place
    parts = [d.select("qid", "id", v.alias("part"), F.col("score").alias("own"), *(F.when(F.lit(j == i), F.col("rank")).alias(f"rank_{j}") for j in range(len(lists)))) for i, (d, v) in enumerate(zip(lists, value, strict=True))]
    return reduce(DataFrame.unionByName, parts)


def _total(lists: Sequence[DataFrame], value: list) -> DataFrame:
    places = [f"rank_{j}" for j in range(len(lists))]
    return _union(lists, value).groupBy("qid", "id").agg(F.sum("part").alias("score"), F.max("own").alias("own"), *(F.min(p).alias(p) for p in places))


def _order(lists: int) -> list:
    return [F.round("score", DECIMALS).desc(), *(F.col(f"rank_{j}").asc_nulls_last() for j in range(lists)), F.col("id")]


def _fused(lists: Sequence[DataFrame], value: list, k: int | None) -> DataFrame:
    total, order = _total(lists, value).drop("own"), _order(len(lists))
    if k:
        return best(total, k, order)
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long"))


def reciprocal_rank_fusion(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, *, rrf_k: float = RRF_K, k: int | None = None) -> DataFrame:
    """`(qid, id, score, rank_0.., rank)`: the sum of weight / (rrf_k + rank) over the lists an id is in. Ties keep the
    order in which the lists, one after the other, name the ids. No `k`, or 0: all."""
    return _fused(lists, [F.lit(w) / (F.lit(float(rrf_k)) + F.col("rank")) for w in _weights(lists, weights)], k)


def weighted_fusion(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, *, k: int | None = None) -> DataFrame:
    """The weighted sum of scores, each list's scaled to [0, 1] per query; scores that are all equal become 1."""
    whole = Window.partitionBy("qid")
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    scaled = [d.withColumn("_s", F.when(high - low < 1e-12, 1.0).otherwise((F.col("score") - low) / (high - low))) for d in lists]
    return _fused(scaled, [F.lit(w) * F.col("_s") for w in _weights(lists, weights)], k)


def merge(dense: DataFrame, lexical: DataFrame, k: int, weights: Sequence[float] | None = None, rrf_k: float = RRF_K) -> DataFrame:
    """Hybrid results `(qid, id, score, rank)`: fused where a query has both lists; where one is empty, the other as it
    is, with its own scores."""
    score, whole = [F.lit(w) / (F.lit(float(rrf_k)) + F.col("rank")) for w in _weights([0, 1], weights)], Window.partitionBy("qid")
    # Both lists are read once: they are whole searches.
    total = _total([dense, lexical], score).withColumn("both", F.max("rank_0").over(whole).isNotNull() & F.max("rank_1").over(whole).isNotNull())
    found = best(total, k, _order(2)) if k else total.withColumn("rank", F.row_number().over(whole.orderBy(*_order(2))).cast("long"))
    return found.select("qid", "id", F.when(F.col("both"), F.col("score")).otherwise(F.col("own")).alias("score"), "rank")
