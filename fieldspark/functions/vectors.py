"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import col


def dot(a, b) -> Column:
    """Dot product in DOUBLE."""
    products = F.zip_with(col(a), col(b), lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v, eps: float | None = None, mode: str = "max") -> Column:
    """Unit vector. ``max`` floors the norm at 1e-12; ``add`` adds 1e-8 to it."""
    v = col(v)
    if mode == "max":
        scale = F.greatest(norm(v), F.lit(1e-12 if eps is None else eps))
    elif mode == "add":
        scale = norm(v) + F.lit(1e-8 if eps is None else eps)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # one-element array: the norm is computed once, not per vector component
    return F.element_at(
        F.transform(F.array(scale), lambda s: F.transform(v, lambda x: x.cast("double") / s)), 1
    )


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def argmax(arr) -> Column:
    """0-based position of the largest element; the first one on ties."""
    arr = col(arr)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def subsample(points, n: int = 256) -> Column:
    """At most ``n`` elements, evenly spaced (half-to-even rounding), ends included."""
    points = col(points)
    last = (F.size(points) - 1).cast("double")
    picked = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda step: F.get(points, F.bround(step * (last / F.lit(float(n - 1))), 0).cast("int")),
    )
    return F.when(F.size(points) > n, picked).otherwise(points)
