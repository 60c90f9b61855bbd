"""Arithmetic on array columns, element by element, without leaving the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``x``, which is computed once however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def matrix(values) -> Column:
    """A small matrix as one constant."""
    return F.from_json(F.lit(json.dumps([[float(v) for v in row] for row in values])), "array<array<double>>")


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def scale(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit variance within the vector."""

    def scaled(apart: Column) -> Column:
        spread = F.sqrt(total(F.transform(apart, lambda v: v * v)) / F.size(apart) + eps)
        return let(spread, lambda s: F.transform(apart, lambda v: v / s))

    return let(x, lambda y: let(total(y) / F.size(y), lambda mean: let(F.transform(y, lambda v: v - mean), scaled)))


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison; no negative zero."""
    return F.transform(x, lambda v: F.round(v, digits) + F.lit(0.0))
