"""Expressions over adjacency strings: k * k characters of 0 and 1, by rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nodes(key: Column) -> Column:
    return F.round(F.sqrt(F.length(key))).cast("int")


def _ones(text: Column) -> Column:
    return F.length(F.replace(text, F.lit("0"), F.lit("")))


def edges(key: Column) -> Column:
    return _ones(key)


def out_degrees(key: Column) -> Column:
    k = nodes(key)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: _ones(F.substring(key, i * k + 1, k)))


def in_degrees(key: Column) -> Column:
    k = nodes(key)
    cell = lambda i, j: F.substring(key, i * k + j + 1, F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.aggregate(F.transform(F.sequence(F.lit(0), k - 1), lambda i: cell(i, j)), F.lit(0), lambda a, v: a + v))


def linear(key: Column) -> Column:
    """Whether a connected graph is one path."""
    return (edges(key) == nodes(key) - 1) & (F.array_max(in_degrees(key)) <= 1) & (F.array_max(out_degrees(key)) <= 1)
