"""Vectors as arrays of floats: sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """The unit vector; zeros for a zero or non-finite vector."""
    good = lambda n: (n > 0) & ~F.isnan(n) & (n < F.lit(float("inf")))
    scaled = lambda s: F.transform(s["v"], lambda x: F.when(s["good"], x.cast("double") / s["n"]).otherwise(0.0).cast("float"))
    measured = lambda w: once(norm(w), lambda n: F.struct(w.alias("v"), n.alias("n"), good(n).alias("good")))
    return once(v, lambda w: once(measured(w), scaled))


def dot(a: Column, b: Column) -> Column:
    """Dot product, clamped to -1..1."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def valid(v: Column, dim: int | None = None) -> Column:
    """Not empty, all finite, and of the dimension if one is asked for."""
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok & (F.size(v) == dim) if dim else ok, F.lit(False))
