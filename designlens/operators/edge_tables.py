"""Graphs from tables of nodes and edges, in any order and with any ids.

A graph that fits a row becomes an array of nodes in topological order, each
with the places that it points to; with ``linked`` as their edge, all operators
of ``graphs`` and ``typed`` take it. ``levels`` needs no such row: it peels
graphs that fit none by rounds of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from designlens.shared import materialize, once


def linked(a: Column, b: Column) -> Column:
    """Whether one packed node points to another."""
    return F.array_contains(a["succ"], b["place"])


def _listed(nodes: DataFrame, edges: DataFrame, keep: list[str], node: str, source: str, target: str) -> DataFrame:
    """``keep``, s, t: a row for each edge, whose ends are nodes too, and with a null t one for each node; null ends make no edge."""
    kind = nodes.schema[node].dataType
    s, t = F.col(source).cast(kind), F.col(target).cast(kind)
    ends = edges.select(*keep, F.coalesce(s, t).alias("s"), F.when(s.isNotNull(), t).alias("t"))
    return nodes.select(*keep, F.col(node).alias("s"), F.lit(None).cast(kind).alias("t")).unionByName(ends)


def _peeled(listed: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ids, succ (places in ids), depth (-1 on or behind a cycle): a row for each graph of ``_listed``."""
    ids = F.array_sort(F.array_union(F.collect_set("s"), F.collect_set("t")))
    rows = listed.groupBy(*keep).agg(ids.alias("ids"), F.collect_set(F.when(F.col("t").isNotNull(), F.struct("s", "t"))).alias("own"))
    at = lambda v: F.array_position(F.col("ids"), v).cast("int") - 1
    side = lambda end, other: F.transform("ids", lambda v: F.transform(F.filter("own", lambda e: e[end] == v), lambda e: at(e[other])))
    rows = once(rows, [*keep, "ids"], pred=side("t", "s"), succ=side("s", "t"))
    # the nodes whose predecessors all have a depth get the next one, as often as there are nodes
    peel = lambda done, r: F.transform(done, lambda d, i: F.when(d >= 0, d).when(F.forall(F.get("pred", i), lambda p: F.get(done, p) >= 0), r).otherwise(d))
    depth = F.aggregate(F.sequence(F.lit(0), F.size("ids")), F.transform("ids", lambda _: F.lit(-1)), peel)
    return once(rows, [*keep, "ids", "succ"], depth=depth)


def packed(nodes: DataFrame, edges: DataFrame, keep: list[str], node: str = "node", source: str = "source", target: str = "target") -> DataFrame:
    """``keep``, nodes (structs node, place, succ in topological order), acyclic: a row for each graph.

    Nodes are those of ``nodes`` and the ends of edges; repeated rows count once, null
    ends make no edge. Nodes of equal depth stand by id. In a graph with a cycle the
    nodes on or behind it stand last and ``acyclic`` is false. A graph goes to one task.
    """
    rows = _peeled(_listed(nodes, edges, keep, node, source, target), keep)
    last = F.size("ids")
    order = F.array_sort(F.transform("ids", lambda _, i: F.struct(F.when(F.get("depth", i) < 0, last).otherwise(F.get("depth", i)).alias("depth"), i.alias("i"))))
    rows = once(rows, [*keep, "ids", "succ"], acyclic=F.forall("depth", lambda d: d >= 0), order=F.transform(order, lambda o: o["i"]))
    place = lambda i: F.array_position(F.col("order"), i).cast("int") - 1
    own = F.transform("order", lambda i, p: F.struct(F.get("ids", i).alias("node"), p.alias("place"), F.array_sort(F.transform(F.get("succ", i), place)).alias("succ")))
    return once(rows, [*keep, "acyclic"], nodes=own).select(*keep, "nodes", "acyclic")


#: Nodes and edges of a graph whose levels are worked out in its row.
FITS = 400


def levels(nodes: DataFrame, edges: DataFrame, keep: list[str], node: str = "node", source: str = "source", target: str = "target", fits: int = FITS) -> DataFrame:
    """``keep``, node, level: the longest path that ends at each node, null on or behind a cycle; for graphs of any size.

    A graph of at most ``fits`` rows of nodes and edges is peeled in its row, the others by rounds of joins; a job
    while the plan is built sorts them out, in one shuffle, and writes levels of the former and rows of the latter.
    """
    all_rows = _listed(nodes, edges, keep, node, source, target).where("s is not null").withColumn("_size", F.count("*").over(Window.partitionBy(*keep)))
    done = _peeled(all_rows.where(F.col("_size") <= fits).drop("_size"), keep).select(*keep, F.explode(F.arrays_zip("ids", "depth")).alias("x"))
    found = done.select(*keep, F.col("x.ids").alias("node"), F.when(F.col("x.depth") >= 0, F.col("x.depth")).alias("level"))
    sorted_out = materialize(found.unionByName(all_rows.where(F.col("_size") > fits).drop("_size"), allowMissingColumns=True), "levels")
    small = sorted_out.where("s is null").select(*keep, "node", "level")
    large = sorted_out.where("s is not null").select(*keep, "s", "t")
    if not large.head(1):
        return small
    return small.unionByName(_levels_by_rounds(large, keep))


def _levels_by_rounds(listed: DataFrame, keep: list[str]) -> DataFrame:
    """Levels of graphs that no row holds.

    Every round takes the nodes all of whose predecessors are done; it is a join of their edges alone, and the counts
    that are left are written once a round. There are as many rounds as levels, each a job while the plan is built.
    """
    links = listed.where("t is not null").select(*keep, F.col("s").alias("_s"), F.col("t").alias("_t")).distinct()
    links = materialize(links, "links")
    into = links.groupBy(*keep, F.col("_t").alias("node")).agg(F.count("*").alias("_left"))
    ends = listed.select(*keep, F.col("s").alias("node")).unionByName(links.select(*keep, F.col("_t").alias("node")))
    waiting = materialize(ends.distinct().join(into, [*keep, "node"], "left").fillna(0, ["_left"]), "waiting")
    done, level = [], 0
    while True:
        ready = waiting.where("_left = 0").select(*keep, "node")
        if not ready.head(1):
            break
        done.append(ready.withColumn("level", F.lit(level)))
        freed = links.join(ready.withColumnRenamed("node", "_s"), [*keep, "_s"]).groupBy(*keep, F.col("_t").alias("node")).agg(F.count("*").alias("_freed"))
        rest = waiting.where("_left > 0").join(freed, [*keep, "node"], "left")
        waiting = materialize(rest.select(*keep, "node", (F.col("_left") - F.coalesce("_freed", F.lit(0))).alias("_left")), "waiting")
        level += 1
    out = waiting.select(*keep, "node", F.lit(None).cast("int").alias("level"))
    for part in done:
        out = out.unionByName(part)
    return out
