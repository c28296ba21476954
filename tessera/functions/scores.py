"""Score normalisation and vector functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-6


def _list(by: Sequence[str]):
    return Window.partitionBy(*by)


def minmax(score: Column, by: Sequence[str] = (), clamp: bool = True, eps: float = EPS) -> Column:
    """To 0..1 within each list; a range below eps counts as eps."""
    low, high = F.min(score).over(_list(by)), F.max(score).over(_list(by))
    scaled = (score - low) / F.greatest(high - low, F.lit(eps))
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) if clamp else scaled


def zscore(score: Column, by: Sequence[str] = (), eps: float = EPS) -> Column:
    """Distance from the list's mean in population standard deviations."""
    return (score - F.avg(score).over(_list(by))) / F.greatest(F.stddev_pop(score).over(_list(by)), F.lit(eps))


def logistic(score: Column, mid: float, steepness: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-steepness) * (score - F.lit(mid))))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """To length 1; a zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    sizes = norm(a) * norm(b)
    return F.when(sizes > 0, dot(a, b) / sizes).otherwise(F.lit(0.0))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors (array of arrays) whose mask is not 0, scaled to length 1."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    total = F.aggregate(kept, F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0)), lambda s, x: F.zip_with(s, x["v"], lambda p, q: p + q.cast("double")))
    return normalize(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))
