"""Numeric kernels on arrays: quantisation and normalisation, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def ternary(v: Column) -> tuple[Column, Column]:
    """(scale, values in -1, 0, 1): the mean magnitude, at least 1e-5, and each value over it, rounded half away from zero."""
    d = _doubles(v)
    scale = F.greatest(_sum(F.transform(d, F.abs)) / F.size(d), F.lit(1e-5))
    return scale, F.transform(d, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(x / scale))).cast("int"))


def int8(v: Column) -> tuple[Column, Column]:
    """(scale, values from -128 to 127): 127 over the largest magnitude, at least 1e-5; rounded half to even."""
    d = _doubles(v)
    scale = 127.0 / F.greatest(F.array_max(F.transform(d, F.abs)), F.lit(1e-5))
    return scale, F.transform(d, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint(x * scale))).cast("int"))


def rms_norm(v: Column, epsilon: float = 1e-6) -> Column:
    d = _doubles(v)
    root = F.sqrt(_sum(F.transform(d, lambda x: x * x)) / F.size(d) + epsilon)
    return F.transform(d, lambda x: x / root)


def valid_labels(labels: Column, ignored: int = -100) -> Column:
    return F.greatest(F.size(F.filter(labels, lambda x: x != ignored)), F.lit(1))


def duplicated_layer(i: Column, first: int = 32, shift: int = 24) -> Column:
    """Source layer of a grown model's layer."""
    return F.when(i < first, i).otherwise(i - shift)
