"""Expressions over a design's slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Slots in which two designs differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)


def family_valid(slots: Column, families: int = 12) -> Column:
    """Whether no family (part number modulo ``families``) is used twice."""
    own = F.transform(slots, lambda p: p % families)
    return F.size(F.array_distinct(own)) == F.size(slots)


def slots_string(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda p: p.cast("string")), "-")


def slots_of_text(text: Column) -> Column:
    """The slots that a text lists: ``3-1-7``, ``[3 1 7]`` or ``[3, 1, 7]``; null for null, no slots for an empty text."""
    words = F.split(F.translate(text, "[](),-", "      "), r"\s+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: w.try_cast("int"))


def differing(a: Column, b: Column) -> Column:
    """For each slot whether two designs differ in it."""
    return F.zip_with(a, b, lambda x, y: x != y)


def feature_ids(slots: Column, parts: int) -> Column:
    """The places of the ones in the one-hot row of a design: slot times ``parts`` plus part less one."""
    return F.transform(slots, lambda p, i: i * parts + p - 1)


def joint_cell(slots: Column, i: int, j: int, parts: int) -> Column:
    """One number for the parts of two slots."""
    return (F.get(slots, F.lit(i)) - 1) * parts + F.get(slots, F.lit(j)) - 1


def named(slots: Column, names: list[str]) -> Column:
    """The names of the parts; null for a part outside the library."""
    return F.transform(slots, lambda p: F.get(F.array(*[F.lit(n) for n in names]), p - 1))


def deepest_first(slots: Column, depths: Column) -> Column:
    """The parts by falling depth of their slot, of equals the earlier slot first."""
    rows = F.zip_with(slots, depths, lambda p, d: F.struct((-d).alias("by"), p.alias("part")))
    placed = F.transform(rows, lambda r, i: F.struct(r["by"].alias("by"), i.alias("slot"), r["part"].alias("part")))
    return F.transform(F.array_sort(placed), lambda r: r["part"])
