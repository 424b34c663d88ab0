"""Readers of text files of metrics, rankings, records, graphs and wide counts, and writers that check first."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.functions.slots import slots_of_text
from designlens.operators.expectations import require

MEASURES = ("n", "mse", "rmse", "r2", "pearson")


def read_metrics(spark: SparkSession, path: str, keys: dict[str, str], tasks: list[str]) -> DataFrame:
    """A row for each key (name -> type) of CSV rows key, task, n, mse, rmse, r2, pearson: a struct of measures for each task, null where it has none."""
    schema = ", ".join([*(f"{k} {t}" for k, t in keys.items()), "task string", "n bigint", *(f"{m} double" for m in MEASURES[1:])])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.groupBy(*keys).pivot("task", tasks).agg(F.first(F.struct(*MEASURES)))


def read_ranked(spark: SparkSession, path: str, slots: str, schema: str) -> DataFrame:
    """A CSV ranking whose ``slots`` column lists parts as ``[3 1 7]``, ``[3, 1, 7]`` or ``3-1-7``: an array afterwards."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumn(slots, slots_of_text(F.col(slots)))


def read_records(spark: SparkSession, paths: list[str], slots: str, aliases: dict[str, str]) -> DataFrame:
    """JSON shards as one table; columns under an alias get their name, slots become arrays, shards may lack columns."""
    shards = []
    for path in paths:
        shard = spark.read.json(path)
        shard = shard.withColumnsRenamed({old: new for old, new in aliases.items() if old in shard.columns and new not in shard.columns})
        own = F.col(slots)
        text = own if dict(shard.dtypes)[slots] == "string" else F.array_join(own.cast("array<string>"), "-")
        shards.append(shard.withColumn(slots, slots_of_text(text)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def read_wide_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """``keys``, view, k, motif, n: a CSV with a column ``view:k:motif`` for each motif, zero counts left out."""
    wide = spark.read.option("header", True).csv(path)
    named = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, [F.col(f"`{c}`") for c in named], "name", "n")
    part = F.split("name", ":")
    return long.select(*keys, F.get(part, F.lit(0)).alias("view"), F.get(part, F.lit(1)).cast("int").alias("k"), F.get(part, F.lit(2)).alias("motif"), F.col("n").cast("bigint").alias("n")).where("n > 0")


def read_all(spark: SparkSession, paths: dict[str, str], label: str) -> DataFrame:
    """Parquet tables as one with their name in ``label``; a table that is not there is warned of and left out, but one must be."""
    found = []
    for name, path in paths.items():
        try:
            found.append(spark.read.parquet(path).withColumn(label, F.lit(name)))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"no table {name} at {path}", stacklevel=2)
    if not found:
        raise FileNotFoundError(", ".join(paths.values()))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, node) and edges (graph, source, target) of JSON rows graph, nodes, edges."""
    rows = spark.read.schema("graph string, nodes array<bigint>, edges array<struct<source:bigint,target:bigint>>").json(path)
    return rows.select("graph", F.explode("nodes").alias("node")), rows.select("graph", F.explode("edges").alias("e")).select("graph", "e.*")


def graph_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, n_nodes, edges (sorted structs) with the nodes of each graph numbered from 0 by their id. A graph goes to one task; graphs are small."""
    listed = nodes.groupBy("graph").agg(F.array_sort(F.collect_set("node")).alias("ids"))
    linked = edges.groupBy("graph").agg(F.collect_set(F.struct("source", "target")).alias("own"))
    at = lambda v: (F.array_position(F.col("ids"), v) - 1).cast("int")
    renamed = F.array_sort(F.transform(F.coalesce("own", F.array().cast("array<struct<source:bigint,target:bigint>>")), lambda e: F.struct(at(e["source"]).alias("source"), at(e["target"]).alias("target"))))
    return listed.join(linked, "graph", "left").select("graph", F.size("ids").alias("n_nodes"), renamed.alias("edges"))


def listed_texts(text: Column) -> Column:
    """The texts of a JSON list, or of one in single quotes; null for anything else."""
    return F.coalesce(F.from_json(text, "array<string>"), F.from_json(F.translate(text, "'", '"'), "array<string>"))


def emit(df: DataFrame, path: str, rules: dict[str, Column], format: str = "parquet") -> None:
    """Write a table, all of it or nothing: rows for which a rule (name -> what holds) fails raise an error before any file is made, and an existing path is never touched."""
    require(df, rules).write.format(format).mode("errorifexists").save(path)
