"""WARC shards, and a Merkle audit of their replicas.

Shards hold WARC/1.1 resource records, each a gzip member of its own whose
header carries the "sl" skip-length field, so that a reader finds the next
record without unpacking this one. Members follow each other without a byte
between them, so any gzip or WARC reader opens a shard. Spark's committed file
writer stores them (``shard=K/`` folders), so lost executors leave no partial
shards.

Audit. Every record of a replica is hashed with its offset and length. Ordered
offset ranges are hashed into a tree: ``RANGE`` bytes of a shard, ``FANOUT`` of
those, and so on up to the shard, then ``GROUP`` neighbouring shards, ``GROUP`` of
those groups, and so on up to the root, so no node has more than ``GROUP``
children. Each level of both replicas is written once, as a small table. The
roots are compared first; only children of nodes that differ are read on the next
level, down to the records. So equal branches are never looked into, and damage
is located by shard and offset. A record whose gzip checksum fails, or that isn't
there, is the damaged one.

Defined results: null html is an empty payload, a null or blank url makes a
metadata record, which needs no address, a null page_id is a record without a
Page-ID field. Record ids come from a record's place, so repeated pages are
records of their own with ids of their own. White space of a url is written as
%20. Pages of any length are records of one member. Replicas of
an empty table are equal. Only ``page_id``, ``url`` and ``html`` are read, so
further columns and their names have no effect.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.llm.columns import arrow_map, slices
from designlens.shared import materialize, shared_path

#: Packed bytes after which a task begins a new shard.
SHARD_BYTES = 16 << 20
#: Bytes of the least range of offsets, children of a node, levels of a shard's ranges.
RANGE, FANOUT, LEVELS = 1 << 18, 16, 3
#: Shards of a group, as bits of the shard's number: its task and, in the lower 20 bits, its place in the task.
GROUP_BITS, GROUP_LEVELS = 10, 5
#: First bytes of a member: gzip, deflate, an extra field of 12 bytes with "sl" of 8 bytes.
HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0"


def pack(record: bytes) -> bytes:
    """A gzip member with skip lengths: packed bytes of the member, and unpacked ones."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    return HEAD + struct.pack("<II", len(HEAD) + 8 + len(body) + 8, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def unpack(member: bytes) -> bytes | None:
    """The record of a member, or None if it is damaged."""
    try:
        z = zlib.decompressobj(31)
        out = z.decompress(member)
        return out if z.eof and not z.unused_data else None
    except zlib.error:
        return None


def record(page_id: int | None, url: str | None, html: str | None, place: str, date: str) -> bytes:
    """A WARC record; ``place`` (shard and number in it) gives its id, ``date`` is a UTC time like 2024-01-31T23:59:59Z."""
    payload, address = (html or "").encode(), "%20".join((url or "").split())
    head = [b"WARC/1.1", b"WARC-Type: " + (b"resource" if address else b"metadata"), b"WARC-Date: " + date.encode()]
    head.append(b"WARC-Record-ID: " + uuid.uuid5(uuid.NAMESPACE_URL, f"{place}:{page_id}").urn.join("<>").encode())
    if address:
        head.append(b"WARC-Target-URI: " + address.encode())
    if page_id is not None:
        head.append(b"Page-ID: %d" % page_id)
    head += [b"WARC-Payload-Digest: sha256:" + hashlib.sha256(payload).hexdigest().encode(), b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def information(place: str, date: str) -> bytes:
    """A warcinfo record for what follows it."""
    fields = b"software: designlens\r\n"
    head = [b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Date: " + date.encode(), b"WARC-Record-ID: " + uuid.uuid5(uuid.NAMESPACE_URL, f"info:{place}").urn.join("<>").encode()]
    return b"\r\n".join([*head, b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(fields)]) + b"\r\n\r\n" + fields + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Pack ``pages`` (page_id, url, html) into shards below ``path``, without a shuffle; ``date`` of the records is now by default."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        task = TaskContext.get().partitionId()
        shard, size, count = task << 20, 0, 0
        for batch in slices(batches, "html"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))
            block = b"".join(pack(record(*x, f"{task}:{count + i}", date)) for i, x in enumerate(rows))
            count += batch.num_rows
            if block[-1]:
                # the writer needs a zero at the end: the last member's size has one below 16 MB
                block += pack(information(f"{task}:{count}", date))
            if size and size + len(block) > SHARD_BYTES:
                shard, size = shard + 1, 0
            size += len(block)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([shard], pa.int64())], ["block", "shard"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write(arrow_map(rows, run, "block binary, shard long"), path)


def _write(blocks: DataFrame, path: str) -> None:
    # a binary cast to string keeps its bytes; the writer's separator, a zero, is the last byte of a block (of one with another end it is padding)
    last = F.length("block") - F.when(F.expr("endswith(block, X'00')"), 1).otherwise(0)
    blocks.select(F.col("block").substr(F.lit(1), last).cast("string").alias("value"), "shard").write.partitionBy("shard").option("lineSep", "\0").option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long").alias("shard"), "content")


def members(content: memoryview):
    """Offset and length of each member; after damage the search goes on at the next head of a member."""
    data, at = bytes(content), 0
    while (at := data.find(HEAD, at)) >= 0:
        length = struct.unpack_from("<I", data, at + len(HEAD))[0] if at + len(HEAD) + 4 <= len(data) else 0
        follows = data.find(HEAD, at + len(HEAD))
        limit = len(data) if follows < 0 else follows
        # a damaged length reaches to the next member
        length = length if len(HEAD) + 16 <= length and (at + length <= limit or data[at + length : at + length + len(HEAD)] == HEAD) else limit - at
        yield at, length
        at += length


LEAVES = "shard long, offset long, length long, page_id long, sound boolean, hash string"


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of a replica: place, page, whether its checksum holds, hash of its bytes."""

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                view, rows = memoryview(content.as_buffer()), []
                for offset, length in members(view):
                    member = bytes(view[offset : offset + length])
                    text = unpack(member)
                    page = None
                    if text is not None and b"\r\nPage-ID: " in (head := text[: text.find(b"\r\n\r\n")]):
                        page = int(head.split(b"\r\nPage-ID: ", 1)[1].split(b"\r\n", 1)[0])
                    rows.append((shard, offset, length, page, text is not None, hashlib.sha256(member).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], [c.split()[0] for c in LEAVES.split(", ")])

    return arrow_map(_files(spark, path), run, LEAVES)


def tree(found: DataFrame) -> list[DataFrame]:
    """Levels of the trees above ``found`` (leaves with their ``side``), each written: side, shard, node, hash.

    First come ranges of a shard (node: place of the range), then whole shards,
    then groups of shards (shard: number of the group) up to the root. A node's
    hash covers the places and hashes of its children in their order.
    """
    level, out = found.select("side", "shard", F.col("offset").alias("child"), F.concat_ws(":", "offset", "length", "hash").alias("said")), []
    for k in range(LEVELS + 1):
        node = F.lit(0) if k == LEVELS else F.floor(F.col("child") / (FANOUT if k else RANGE))
        out.append(materialize(_parents(level, F.col("shard"), node), "warc-level"))
        level = out[-1].select("side", "shard", F.col("node").alias("child"), F.concat_ws(":", "node", "hash").alias("said"))
    for _ in range(GROUP_LEVELS):
        level = out[-1].select("side", F.shiftright("shard", GROUP_BITS).alias("shard"), F.col("shard").alias("child"), F.concat_ws(":", "shard", "hash").alias("said"))
        out.append(materialize(_parents(level, F.col("shard"), F.lit(0)), "warc-level"))
    return out


def _parents(level: DataFrame, shard, node) -> DataFrame:
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("child", "said"))), lambda x: x["said"]), "|")
    return level.groupBy("side", shard.cast("long").alias("shard"), node.cast("long").alias("node")).agg(F.sha2(ordered, 256).alias("hash"))


def _different(level: DataFrame) -> DataFrame:
    """shard, node of the nodes that are not the same on both sides."""
    sides = level.groupBy("shard", "node").agg(F.count("*").alias("n"), F.min("hash").alias("a"), F.max("hash").alias("b"))
    return sides.where("n < 2 or a <> b").select("shard", "node")


def audit(spark: SparkSession, path_a: str, path_b: str) -> DataFrame:
    """page_id, shard, offset, length, sound_a, sound_b of each record that differs between two replicas."""
    both = leaves(spark, path_a).withColumn("side", F.lit("a")).union(leaves(spark, path_b).withColumn("side", F.lit("b")))
    found = materialize(both, "warc-leaves")
    levels = tree(found)
    bad = _different(levels[-1])
    for k in reversed(range(len(levels) - 1)):
        # children of the nodes that differ on the level above
        shard, node = (F.col("shard"), F.floor(F.col("node") / FANOUT)) if k < LEVELS - 1 else (F.col("shard"), F.lit(0)) if k == LEVELS - 1 else (F.shiftright("shard", GROUP_BITS), F.lit(0))
        above = bad.select(F.col("shard").alias("above"), F.col("node").alias("above_node"))
        below = levels[k].withColumns({"above": shard, "above_node": node.cast("long")}).join(above, ["above", "above_node"], "left_semi")
        bad = materialize(_different(below), "warc-different")
    ranged = found.withColumn("node", F.floor(F.col("offset") / RANGE)).join(bad, ["shard", "node"], "left_semi")
    of = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c}_{side}")
    out = ranged.groupBy("shard", "offset").agg(*[of(c, s) for c in ("length", "page_id", "sound", "hash") for s in "ab"])
    out = out.where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    return out.select(F.coalesce("page_id_a", "page_id_b").alias("page_id"), "shard", "offset", F.coalesce("length_a", "length_b").alias("length"), F.coalesce("sound_a", F.lit(False)).alias("sound_a"), F.coalesce("sound_b", F.lit(False)).alias("sound_b"))


#: The table of pages has no times; a stated one lets runs give the same bytes.
DATE = "2000-01-01T00:00:00Z"
#: One record in so many is damaged by ``damaged_copy``, for each kind of damage.
DAMAGE = 211


def damaged_copy(spark: SparkSession, source: str, path: str) -> None:
    """A replica of ``source`` with faults at places that its bytes determine: a changed byte, an erased head, a cut end of a shard."""

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                data = bytearray(content.as_buffer())
                found = list(members(memoryview(content.as_buffer())))
                for offset, length in found:
                    kind = zlib.crc32(data[offset : offset + length]) % DAMAGE
                    if kind == 0:
                        data[offset + length // 2] ^= 0x20
                    elif kind == 1:
                        data[offset : offset + 16] = bytes(16)
                if found and shard % 5 == 3:
                    del data[found[-1][0] + found[-1][1] // 2 :]
                yield pa.RecordBatch.from_arrays([pa.array([bytes(data)], pa.binary()), pa.array([shard], pa.int64())], ["block", "shard"])

    _write(arrow_map(_files(spark, source), run, "block binary, shard long"), path)


def audited_pages(pages: DataFrame) -> DataFrame:
    """Pack ``pages``, copy the shards with faults, and audit the two replicas."""
    spark = pages.sparkSession
    first, second = shared_path(spark, "warc-a"), shared_path(spark, "warc-b")
    write_warc(pages, first, DATE)
    damaged_copy(spark, first, second)
    return audit(spark, first, second)
