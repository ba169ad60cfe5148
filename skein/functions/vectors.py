"""Column expressions over vectors (arrays of float). All arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.config import METRICS
from skein.errors import QueryError

TINY = 1e-12


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    return F.element_at(F.transform(F.array(F.greatest(norm(v), F.lit(TINY))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance(metric: str, q: Column, v: Column) -> Column:
    """Smaller is closer. Cosine expects vectors as they are and divides by their lengths."""
    if metric == "cosine":
        return F.lit(1.0) - dot(q, v) / (F.greatest(norm(q), F.lit(TINY)) * F.greatest(norm(v), F.lit(TINY)))
    if metric == "l2":
        return squared_l2(q, v)
    if metric == "dot":
        return F.lit(0.0) - dot(q, v)
    raise QueryError(f"metric is one of {METRICS}")


def score(metric: str, dist: Column) -> Column:
    """Larger is closer: the similarity for cosine and dot, the negated squared distance for l2."""
    return (F.lit(1.0) if metric == "cosine" else F.lit(0.0)) - dist


def is_valid(v: Column, dim: int) -> Column:
    """Whether a vector has `dim` finite components; false for null."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce((F.size(v) == dim) & F.forall(v, finite), F.lit(False))
