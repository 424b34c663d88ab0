"""What a source text says: one target, a list of targets, or a baseline of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from designlens.shared import once
from designlens.sources.readers import listed_texts

_BASELINE = "baseline:"


def parent_target(source: Column) -> Column:
    """The text without its baseline prefix, up to the first slash; null for null."""
    return F.substring_index(F.replace(source, F.lit(_BASELINE), F.lit("")), "/", 1)


def primary_source(source: Column) -> Column:
    """The first target of a list, the parent of a baseline, else the text itself; null for null, the text for an empty list."""
    first = F.get(F.when(source.startswith("["), listed_texts(source)), F.lit(0))
    return F.coalesce(first, F.when(source.startswith(_BASELINE), F.substring_index(F.substring(source, len(_BASELINE) + 1, 1_000_000), "/", 1)).otherwise(source))


def with_class(rows: DataFrame, source: str, classes: DataFrame, name: str = "class", unknown: str = "?") -> DataFrame:
    """``rows`` with the class of their primary source; ``classes`` (target, class) may lack some. A target that it repeats takes its least class."""
    one = classes.groupBy(F.col("target").alias("_primary")).agg(F.min("class").alias(name))
    return once(rows, rows.columns, _primary=primary_source(F.col(source))).join(one, "_primary", "left").fillna(unknown, [name]).drop("_primary")


def class_counts(rows: DataFrame, source: str, classes: DataFrame) -> DataFrame:
    """parent, primary, class, n over source texts; each distinct text is read once, however many rows have it."""
    texts = with_class(rows.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_n")), "_source", classes)
    read = once(texts, ["class", "_n"], parent=parent_target(F.col("_source")), primary=primary_source(F.col("_source")))
    return read.groupBy("parent", "primary", "class").agg(F.sum("_n").alias("n"))
