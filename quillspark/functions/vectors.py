"""Arithmetic on ``array<float>`` columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_TOLERANCE = 1e-2 + 1e-5
NO_SIGNAL = 1e-6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a vector without signal stays as it is."""
    n = norm(v)
    return F.when(n > NO_SIGNAL, F.transform(v, lambda x: x / n)).otherwise(v)
