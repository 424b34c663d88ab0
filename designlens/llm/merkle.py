"""Merkle manifest of a dataset: a persistent tree in aligned blocks, with versions that copy only a path.

Every row is a leaf. The leaves of a group stand in order of their key, and
every ``FAN`` consecutive nodes become their parent until one is left, the
group's subroot; the subroots make the root in the same way. ``FAN ** DEPTH``
leaves make an aligned block, which one task folds and which is stored as one
row; the roots of blocks are the nodes of the next layer, again in blocks, so
that no task holds more than one block whatever the group's size.

A tampered leaf makes a version of the tree: the base version's nodes are
shared, and only the ancestors of that leaf are copied, in its block by the
block's task and above it along the path that each block carries.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from designlens.llm.columns import arrow_map
from designlens.llm.places import placed
from designlens.shared import materialize

#: Children of a node.
FAN = 8
#: Levels of a block: it holds FAN ** DEPTH nodes at most.
DEPTH = 3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_PATH = "array<struct<left: string, right: string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hash of a row's values."""
    return F.sha2(F.concat(*map(field, values)), 256)


# --- one block


def levels(nodes: list[str], total: int, depth: int = DEPTH) -> list[list[str]]:
    """A block's levels from ``nodes`` up: while the whole layer (of ``total`` nodes) has several, at most ``depth`` times."""
    out = [nodes]
    while total > 1 and len(out) <= depth:
        nodes = [digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
        total = -(-total // FAN)
        out.append(nodes)
    return out


def path(base: list[list[str]], at: int) -> list[tuple[str, str]]:
    """The siblings before and after the node ``at`` and after its ancestors, level by level below the block's root."""
    out = []
    for nodes in base[:-1]:
        start = at - at % FAN
        out.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + FAN])))
        at //= FAN
    return out


def copied(node: str, steps: list[tuple[str, str]]) -> list[str]:
    """A version's own nodes: the changed one and copies of its ancestors along ``steps``; all others are the base's."""
    out = [node]
    for left, right in steps:
        node = digest(left + node + right)
        out.append(node)
    return out


# --- layers of blocks


def _blocks(nodes: DataFrame, group: str, payload: list[str], name: str, depth: int) -> DataFrame:
    """``group``, block, total, nodes (at, node, ``payload``; in order) and root of each aligned block of ``nodes``."""
    member = F.struct((F.col("place") % FAN**depth).cast("int").alias("at"), "node", *payload)
    grouped = nodes.groupBy(group, F.floor(F.col("place") / FAN**depth).alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(member)).alias("nodes"))

    def run(batches):
        for batch in batches:
            roots = [
                levels([x["node"] for x in nodes], total, depth)[-1][0]
                for nodes, total in zip(batch.column("nodes").to_pylist(), batch.column("total").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "root"])

    return materialize(arrow_map(grouped, run, StructType([*grouped.schema.fields, StructField("root", StringType())])), name)


def _descend(blocks: DataFrame, above: DataFrame, group: str, payload: list[str], depth: int) -> DataFrame:
    """``group``, block (the node's place), ``payload`` and path of each node of ``blocks``; ``above`` has the paths of the blocks."""
    rows = blocks.join(above, [group, "block"])
    kinds = {f.name: f.dataType for f in blocks.schema["nodes"].dataType.elementType.fields}
    key = blocks.schema[group].dataType

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.select([group, "block", "total", "nodes", "path"]).to_pylist():
                upper = [(s["left"], s["right"]) for s in row["path"]]
                base = levels([x["node"] for x in row["nodes"]], row["total"], depth)
                for x in row["nodes"]:
                    steps = [{"left": a, "right": b} for a, b in path(base, x["at"]) + upper]
                    out.append({group: row[group], "block": row["block"] * FAN**depth + x["at"], "path": steps} | {p: x[p] for p in payload})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(group, batch.schema.field(group).type), ("block", pa.int64()), *[(p, batch.schema.field("nodes").type.value_type.field(p).type) for p in payload], ("path", _PATH_TYPE)]))

    return arrow_map(rows, run, ", ".join([f"{group} {key.simpleString()}", "block bigint", *[f"{p} {kinds[p].simpleString()}" for p in payload], f"path {_PATH}"]))


def _fold(leaves: DataFrame, group: str, payload: list[str], name: str, depth: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The blocks of placed ``leaves``, the top node of each group (``group``, root), and the layers of blocks above."""
    first = _blocks(leaves, group, payload, f"{name}-blocks", depth)
    below, above = first, []
    while True:
        count = F.ceil(F.col("total") / FAN**depth)
        if not below.where(count > 1).head(1):
            break
        nodes = below.select(group, F.col("block").alias("place"), count.alias("total"), F.col("root").alias("node"))
        below = _blocks(nodes, group, [], f"{name}-layer", depth)
        above.append(below)
    return first, below.select(group, "root"), above


def _paths(tops: DataFrame, above: list[DataFrame], group: str, depth: int) -> DataFrame:
    """``group``, block, path of each first block; ``tops`` (``group``, path) has the steps above each group's top node."""
    paths = tops.select(group, F.lit(0).cast("bigint").alias("block"), "path")
    for layer in reversed(above):
        paths = _descend(layer, paths, group, [], depth)
    return paths


@dataclass
class Manifest:
    """Stored blocks of leaves, and what lies above each block."""

    blocks: DataFrame  # _group, block, total, nodes (at, node, key, changed), root
    above: DataFrame  # _group, block, path, subroot, top
    depth: int


def build(leaves: DataFrame, depth: int = DEPTH) -> Manifest:
    """The manifest of ``leaves``: ``part`` (string, may be null), ``key``, ``node`` (hash of the row) and ``changed``.

    ``changed`` is the hash of the row as it is found now, null where it was not
    tampered with. Leaves of a part ascend by key (null first), equal keys by
    hash, so copies of a row stand side by side. Parts ascend by their UTF-8
    bytes, the null part first. An empty table has no blocks.
    """
    group = F.coalesce(F.concat(F.lit("="), "part"), F.lit(""))
    rows = materialize(leaves.select(group.alias("_group"), "key", "node", "changed"), "merkle-leaves")
    ordered = placed(rows, "_group", ["key", "node"], ["key", "node"], "merkle-placed")
    blocks, tops, above = _fold(ordered, "_group", ["key", "changed"], "merkle", depth)
    # the subroots are the leaves of one more tree
    upper = tops.select(F.lit("").alias("_all"), F.col("_group").alias("part"), F.col("root").alias("node"))
    parts, root, over = _fold(placed(upper, "_all", ["part"], ["part"], "merkle-parts"), "_all", ["part"], "merkle-parts", depth)
    empty = F.array().cast(_PATH)
    steps = _descend(parts, _paths(root.select("_all", empty.alias("path")), over, "_all", depth), "_all", ["part"], depth)
    steps = steps.join(root.withColumnRenamed("root", "top"), "_all").select(F.col("part").alias("_group"), "path", "top")
    steps = materialize(steps.join(tops.withColumnRenamed("root", "subroot"), "_group"), "merkle-roots")
    return Manifest(blocks, materialize(_paths(steps, above, "_group", depth).join(steps.drop("path"), "_group"), "merkle-paths"), depth)


def proofs(manifest: Manifest, full: bool = True) -> DataFrame:
    """Of each leaf: key, node, subroot, root, proof_sha256, folded_root, verified; ``full`` adds siblings and copied.

    siblings has the texts of the proof, level by level; copied has the nodes of
    the version in which this one leaf is the changed one (empty if it was not
    tampered with), from the leaf to the root. folded_root is that version's
    root, or the root folded from the leaf itself.
    """
    depth = manifest.depth
    rows = manifest.blocks.select("_group", "block", "total", "nodes").join(manifest.above, ["_group", "block"])
    key = manifest.blocks.schema["nodes"].dataType.elementType["key"].dataType
    schema = f"key {key.simpleString()}, node string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(batches):
        for batch in batches:
            kind = batch.schema.field("nodes").type.value_type.field("key").type
            for row in batch.to_pylist():
                out = {c: [] for c in ("key", "node", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings", "copied")}
                upper = [(s["left"], s["right"]) for s in row["path"]]
                upper_text = "".join(a + b for a, b in upper)
                base = levels([x["node"] for x in row["nodes"]], row["total"], depth)
                for x in row["nodes"]:
                    steps = path(base, x["at"])
                    text = "".join(a + b for a, b in steps) + upper_text
                    version = copied(x["node"] if x["changed"] is None else x["changed"], steps + upper)
                    out["key"].append(x["key"])
                    out["node"].append(x["node"])
                    out["proof_sha256"].append(digest(text))
                    out["folded_root"].append(version[-1])
                    out["verified"].append(version[-1] == row["top"])
                    if full:
                        out["siblings"].append([a + b for a, b in steps + upper])
                        out["copied"].append([] if x["changed"] is None else version)
                n = len(row["nodes"])
                out["subroot"], out["root"] = [row["subroot"]] * n, [row["top"]] * n
                types = [kind, *[pa.string()] * 5, pa.bool_(), *[pa.list_(pa.string())] * 2]
                columns = [pa.array(v, t) for v, t in zip(out.values(), types)]
                yield pa.RecordBatch.from_arrays(columns if full else columns[:-2], list(out) if full else list(out)[:-2])

    return arrow_map(rows, run, schema + (", siblings array<string>, copied array<string>" if full else ""))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``docs`` (doc_id, source, lang, n_chars, text; any may be null), as found after tampering.

    Where 3 divides the crc32 of the decimal doc_id the text's A-Z are lower-cased;
    a null text stays null, and a row without a doc_id is never tampered with.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", CAPITALS, CAPITALS.lower())
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return docs.select(
        F.col("lang").cast("string").alias("part"), F.col("doc_id").cast("long").alias("key"), leaf(*values).alias("node"), F.when(tampered, leaf(*values[:-1], lowered)).alias("changed")
    )


def manifest_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row; no rows of an empty table."""
    return proofs(build(document_leaves(docs)), full=False).withColumnsRenamed({"key": "doc_id", "node": "leaf"})
