"""Exact inner-product search over an index of distances to pivots.

Components become integers, so scores are exact. Every vector is keyed by its
nearest pivot and its distance to it, and the index is sorted by that key: a
shard holds some thousands of neighbouring vectors, a cell a few hundred of one
pivot, that is an annulus around it. A vector x in an annulus from lo to hi is
at least lo - d or d - hi away from a query q at distance d of the pivot, and

    2 <q, x> = |q|^2 + |x|^2 - |q - x|^2,

so the annulus bounds the score of all it holds. A query first expands the
annuli of its own shard, best bound first, until the next bound falls below its
k-th score; then it meets the other shards, in blocks of queries, wherever a
bound still reaches that score, and expands their annuli in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from designlens.llm.columns import arrow_map
from designlens.shared import materialize

#: Vectors of a shard (about; ranges are sampled) and of a cell, and queries of a block.
SHARD, CELL, BLOCK = 8192, 512, 1024
#: Pivots are fitted on so many vectors at most, those of least hash; the fit never changes a result.
PIVOTS, SAMPLE, ROUNDS = 64, 4096, 4
SCALE = 256
#: Annuli (pivot, lo, hi, norm) of shards that are sent to all tasks; with more of them, every block meets every shard.
SENT = 1 << 20
#: In the place of a null id, after all others.
NO_ID = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min
#: Bounds are raised by this share, far more than the error of a double.
SLACK = 1e-9

_KEYED = "pivot int, distance double, norm double, vec_id bigint, vec binary"
_SHARDS = (
    "shard bigint, ids binary, vecs binary, cells array<struct<pivot: int, lo: double, hi: double, norm: double, first: int, n: int>>, "
    "queries array<struct<row: int, query_id: bigint, vec: binary, least: bigint, ids: array<bigint>, scores: array<bigint>>>"
)
_BLOCKS = "shard bigint, home array<bigint>, rows array<int>, query_ids array<bigint>, vecs binary, least array<bigint>"
_FOUND = "home bigint, row int, query_id bigint, vec_id bigint, score bigint"


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as 4-byte floats where those are exact, else as 8-byte ones."""
    return x.astype("<f4" if not x.size or np.abs(x).max() <= 1 << 24 else "<f8").tobytes()


def _unpack(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * rows * dim else "<f8").reshape(rows, dim)


def whole_numbers(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """floor(256 x) of each component; a shorter vector counts as followed by zeros."""
    flat, at = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    n = np.diff(at)
    out = np.zeros((len(vectors), dim))
    rows = np.repeat(np.arange(len(vectors)), n)
    out[rows, np.arange(len(flat)) - at[:-1][rows]] = np.floor(SCALE * flat.astype(np.float64))
    return out


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of ``x`` to each point, without cancellation."""
    out = np.empty((len(x), len(points)))
    for j, p in enumerate(points):
        out[:, j] = np.linalg.norm(x - p, axis=1)
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in the least type that holds all sums; beyond the range of long they stop at its ends."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 1 << 24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, LOWEST + 1, NO_ID).astype(np.int64)


def fit_pivots(sample: np.ndarray) -> np.ndarray:
    """At most PIVOTS centres of ``sample``: its first distinct vectors, moved by a few rounds of k-means."""
    distinct = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
    pivots = distinct[:PIVOTS].astype(np.float64)
    for _ in range(ROUNDS):
        near = distances(distinct, pivots).argmin(1)
        pivots = np.stack([distinct[near == j].mean(0) if (near == j).any() else p for j, p in enumerate(pivots)])
    return pivots


@dataclass
class Cells:
    """Annuli: pivot, least and greatest distance, greatest squared norm, and the rows that they hold."""

    pivot: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    norm: np.ndarray
    first: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, pivot: np.ndarray, distance: np.ndarray, norm: np.ndarray) -> "Cells":
        """Runs of at most CELL rows of one pivot; rows stand in order of pivot and distance."""
        starts = np.concatenate(([0], np.flatnonzero(np.diff(pivot)) + 1, [len(pivot)]))
        first = np.concatenate([np.arange(a, b, CELL) for a, b in zip(starts, starts[1:])])
        ends = np.append(first[1:], len(pivot))
        return cls(pivot[first], distance[first], distance[ends - 1], np.maximum.reduceat(norm, first), first, ends - first)

    def bounds(self, to_pivots: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The highest score that each query (rows) may reach in each cell (columns)."""
        d = to_pivots[:, self.pivot]
        with np.errstate(all="ignore"):  # beyond the range of a double nothing is bounded
            gap = np.maximum(np.maximum(self.lo - d, d - self.hi), 0)
            both = norms[:, None] + self.norm
            out = (both - gap * gap) / 2 + SLACK * both + 1
        return np.where(np.isfinite(out), out, np.inf)


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, n = k, least.copy(), len(least)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.counts = np.zeros(n, np.int64)

    def add(self, rows: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        """Scores ``s`` of the queries ``rows`` (LOWEST where a pair is none) with the vectors ``ids``."""
        floor = self.least[rows]
        if s.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        q, x = np.nonzero((s >= floor[:, None]) & (s != LOWEST))
        query, score, vec = np.concatenate((self.query, rows[q])), np.concatenate((self.score, s[q, x])), np.concatenate((self.id, ids[x]))
        order = np.lexsort((vec, -score, query))
        query, score, vec = query[order], score[order], vec[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], vec[keep]
        last = place == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])


def expand(q: np.ndarray, norms: np.ndarray, to_pivots: np.ndarray, best: Best, cells: Cells, x: np.ndarray, ids: np.ndarray, own: np.ndarray | None = None) -> int:
    """Visit annuli from the highest bound down while a bound reaches a query's k-th score; returns the pairs compared.

    ``own`` has the row of ``x`` that is the query itself.
    """
    bounds, pairs = cells.bounds(to_pivots, norms), 0
    for c in np.argsort(-bounds.max(0), kind="stable"):
        if bounds[:, c].max() < best.least.min():
            break  # nor does any later one
        rows = np.flatnonzero(bounds[:, c] >= best.least)
        if len(rows):
            first, n = cells.first[c], cells.n[c]
            s = scores(q[rows], x[first : first + n])
            if own is not None:
                inside = (own[rows] >= first) & (own[rows] < first + n)
                s[np.flatnonzero(inside), own[rows][inside] - first] = LOWEST
            best.add(rows, s, ids[first : first + n])
            pairs += s.size
    return pairs


@dataclass
class Index:
    """Stored shards, the pivots, and the number of components."""

    shards: DataFrame
    pivots: np.ndarray
    dim: int
    k: int


def build(vectors: DataFrame, id_column: str, vector_column: str, k: int, every: int) -> Index | None:
    """Index ``vectors`` and search each query's own shard; None if no vector takes part.

    A vector takes part if it is not null and holds neither nulls nor non-finite
    components. Rows without an id are candidates after all others. Queries are the
    rows whose id ``every`` divides.
    """
    x = F.col(vector_column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("vec")).where(x.isNotNull() & finite)
    n, dim = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return None
    sample = rows.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toArrow().column(0).combine_chunks()
    pivots = fit_pivots(whole_numbers(sample, dim))

    def key(batches):
        for batch in batches:
            whole = whole_numbers(batch.column("vec"), dim)
            d = distances(whole, pivots)
            near = d.argmin(1)
            columns = [near.astype(np.int32), d[np.arange(len(d)), near], (whole * whole).sum(1)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), batch.column("vec_id"), pa.array([_pack(v) for v in whole], pa.binary())], ["pivot", "distance", "norm", "vec_id", "vec"]
            )

    keyed = materialize(arrow_map(rows, key, _KEYED).withColumn("_row", F.monotonically_increasing_id()), "topk-keyed")
    # equal vectors are dealt by their row, so any number of copies share no task
    dealt = keyed.repartitionByRange(-(-n // SHARD), "pivot", "distance", "_row").sortWithinPartitions("pivot", "distance", "_row")

    def shard(batches):
        for place, batch in enumerate(_runs(batches, 4 * SHARD)):
            yield _shard_row((TaskContext.get().partitionId() << 20) + place, batch, pivots, dim, k, every)

    return Index(materialize(arrow_map(dealt.drop("_row"), shard, _SHARDS), "topk-shards"), pivots, dim, k)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A task's rows as batches of at most ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _shard_row(number: int, batch: pa.RecordBatch, pivots: np.ndarray, dim: int, k: int, every: int) -> pa.RecordBatch:
    """Pack a shard, and search it for the queries among its own rows."""
    x = np.stack([_unpack(v, 1, dim)[0] for v in batch.column("vec").to_pylist()]).astype(np.float64)
    pivot, distance, norm = (batch.column(c).to_numpy() for c in ("pivot", "distance", "norm"))
    known = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
    ids = batch.column("vec_id").fill_null(NO_ID).to_numpy()
    cells = Cells.of(pivot, distance, norm)
    own = np.flatnonzero(known & (ids % every == 0))
    queries = []
    if len(own):
        best = Best(k, np.full(len(own), LOWEST))
        expand(x[own], norm[own], distances(x[own], pivots), best, cells, x, ids, own)
        at = np.searchsorted(best.query, np.arange(len(own) + 1))
        for i, r in enumerate(own):
            one = slice(at[i], at[i + 1])
            queries.append({"row": r, "query_id": ids[r], "vec": _pack(x[r]), "least": best.least[i], "ids": best.id[one].tolist(), "scores": best.score[one].tolist()})
    parts = [dict(zip(("pivot", "lo", "hi", "norm", "first", "n"), c)) for c in zip(*[getattr(cells, c).tolist() for c in ("pivot", "lo", "hi", "norm", "first", "n")])]
    fields = [("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("norm", pa.float64()), ("first", pa.int32()), ("n", pa.int32())]
    asked = [("row", pa.int32()), ("query_id", pa.int64()), ("vec", pa.binary()), ("least", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))]
    types = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary()), ("cells", pa.list_(pa.struct(fields))), ("queries", pa.list_(pa.struct(asked)))])
    return pa.RecordBatch.from_pylist([{"shard": number, "ids": ids.astype("<i8").tobytes(), "vecs": _pack(x), "cells": parts, "queries": queries}], types)


def _cells(parts: list[dict]) -> Cells:
    return Cells(*[np.array([c[f] for c in parts]) for f in ("pivot", "lo", "hi", "norm", "first", "n")])


def _blocks(index: Index) -> DataFrame:
    """Blocks of queries by the shard that they have still to meet."""
    pivots, dim = index.pivots, index.dim
    queries = index.shards.select(F.col("shard").alias("home"), F.explode("queries").alias("q")).select("home", "q.row", "q.query_id", "q.vec", "q.least")
    annulus = F.explode("cells").alias("c")
    # one ring a shard and pivot; they are sent to the tasks only if there are few
    rings = index.shards.select("shard", annulus).groupBy("shard", "c.pivot").agg(F.min("c.lo").alias("lo"), F.max("c.hi").alias("hi"), F.max("c.norm").alias("norm"))
    found = rings.limit(SENT + 1).toPandas()
    ring = None
    if len(found) <= SENT:
        found = found.sort_values("shard", ignore_index=True)
        numbers, shard_of = np.unique(found["shard"].to_numpy(), return_inverse=True)
        ring = Cells(found["pivot"].to_numpy(), found["lo"].to_numpy(), found["hi"].to_numpy(), found["norm"].to_numpy(), shard_of, shard_of)
        starts = np.searchsorted(shard_of, np.arange(len(numbers)))

    def meet(batches):
        for batch in _runs(batches, BLOCK):
            q = np.stack([_unpack(v, 1, dim)[0] for v in batch.column("vec").to_pylist()]).astype(np.float64)
            home, row, ids, least = (batch.column(c).to_numpy() for c in ("home", "row", "query_id", "least"))
            if ring is None:
                yield _block_row(None, slice(None), home, row, ids, q, least)
                continue
            bounds = np.maximum.reduceat(ring.bounds(distances(q, pivots), (q * q).sum(1)), starts, axis=1)
            for j, number in enumerate(numbers.tolist()):
                wanted = np.flatnonzero((bounds[:, j] >= least) & (home != number))
                if len(wanted):
                    yield _block_row(number, wanted, home, row, ids, q, least)

    blocks = arrow_map(queries, meet, _BLOCKS)
    if ring is None:
        blocks = blocks.drop("shard").crossJoin(index.shards.select("shard"))  # blocks of queries, not queries, meet shards
    return blocks


def _block_row(number: int | None, at, home, row, ids, q, least) -> pa.RecordBatch:
    types = pa.schema([("shard", pa.int64()), ("home", pa.list_(pa.int64())), ("rows", pa.list_(pa.int32())), ("query_ids", pa.list_(pa.int64())), ("vecs", pa.binary()), ("least", pa.list_(pa.int64()))])
    values = {"shard": number, "home": home[at].tolist(), "rows": row[at].tolist(), "query_ids": ids[at].tolist(), "vecs": _pack(q[at]), "least": least[at].tolist()}
    return pa.RecordBatch.from_pylist([values], types)


def search(index: Index) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all rows but itself, ties to the smaller id."""
    pivots, dim, k = index.pivots, index.dim, index.k
    pairs = _blocks(index).join(index.shards.select("shard", "ids", F.col("vecs").alias("candidates"), "cells"), "shard")

    def meet(batches):
        for batch in batches:
            for b in batch.to_pylist():
                home = np.array(b["home"])
                other = np.flatnonzero(home != b["shard"])
                if not len(other):
                    continue
                q = _unpack(b["vecs"], len(home), dim).astype(np.float64)[other]
                ids = np.frombuffer(b["ids"], "<i8")
                best = Best(k, np.array(b["least"])[other])
                expand(q, (q * q).sum(1), distances(q, pivots), best, _cells(b["cells"]), _unpack(b["candidates"], len(ids), dim), ids)
                at = other[best.query]
                columns = [home[at], np.array(b["rows"], np.int32)[at], np.array(b["query_ids"])[at], best.id, best.score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["home", "row", "query_id", "vec_id", "score"])

    own = index.shards.select(F.col("shard").alias("home"), F.explode("queries").alias("q"))
    own = own.select("home", "q.row", "q.query_id", F.explode(F.arrays_zip("q.ids", "q.scores")).alias("x")).select("home", "row", "query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    found = own.unionByName(arrow_map(pairs, meet, _FOUND))
    order = Window.partitionBy("home", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != int(NO_ID), F.col("vec_id")).alias("vec_id"), "score")


def top_k(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """The k highest integer inner products of each query (rows whose id ``every`` divides) with every other row.

    Components are floor(256 x). Null vectors and those with null or non-finite
    components take no part; a shorter vector counts as followed by zeros. Equal
    scores go to the smaller id, rows without an id last. A query with fewer
    candidates gets all of them; an empty table gives no rows. Rows that repeat an
    id are rows of their own. Builds and stores the index while the plan is made.
    """
    index = build(vectors, id_column, vector_column, k, every)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return search(index)
