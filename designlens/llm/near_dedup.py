"""MinHash near-duplicate groups by a chosen-path set similarity join.

A document's set holds its distinct ``words``-word shingles. Documents are
linked when the Jaccard similarity of their sets reaches ``threshold``; the
groups are the connected components of those links.

Method. Equal sets are first joined to one representative, by a grouped
minimum. Every representative then walks ``TREES`` independent trees, each with
coordinates of its own. At a node the documents branch by minwise tokens: those
that share the token of the node's coordinate go on together. The first
``ROOT`` levels, whose nodes are large in any corpus, are walked at once; below
them a node chooses ``BRANCH`` coordinates by its own hash. A node is compared
exhaustively once it holds at most ``LEAF`` documents. Larger nodes branch
again, unless all their documents are in one group already, where no further
link can change the result. In nodes that are still large after ``DEPTH``
levels, the documents outside the largest group are compared, in blocks, with
all documents of the node, so no link is given up there either.

A pair of similarity s is missed by the roots with probability
(1 - s^ROOT)^TREES: 3e-8 at 0.8, before what deeper levels lose.

Candidates must agree in enough signature coordinates (a bound that loses a
pair at the threshold with probability under 1e-6), and every link is then
confirmed on the full sets. In the last comparison this happens inside the
node: the full sets of its documents that have a candidate meet there, and only
links leave it, no more than connect the groups that it holds. So a node whose
documents are similar but stay under the threshold emits rows by its size.

Data with hot groups: equal sets meet only in partial aggregates and in joins
whose skewed side Spark splits. Near groups grow by ``ROUNDS`` rounds before
nodes are compared exhaustively: every document names the likeliest member of
another group in its nodes (nodes dealt into blocks of ``LEAF``), and those
links are confirmed. So a group of n documents costs n links a round, not n * n;
the last comparison only sees pairs of groups that are still apart.

Defined results: every row is a document, also rows that repeat a doc_id; a
component_id is the least doc_id of all rows in the component, so one doc_id with
two texts may be in two components. Null text and text without words have the
empty set, form their own component and are linked with nothing. A text with
fewer words than a shingle has its whole word sequence as its only shingle. Rows
without a doc_id are linked like others; a component of such rows alone has a
null component_id. Texts of any length are taken whole, a long one in a slice of
its own. An empty table gives an empty one. Only ``doc_id`` and ``text`` are
read, so further columns and their names have no effect; ``one_of_each_group``
returns them as they are. Of equal candidates for the row that stays it keeps
the least doc_id, then the least hash of the text, then any one of equal rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from designlens.llm.columns import Words, arrow_map, hash_strings, mix, slices
from designlens.llm.components import connected_components
from designlens.shared import materialize

TREES, ROOT, BRANCH, DEPTH = 24, 3, 2, 4
#: Signature coordinates: no two trees share one. Beyond the roots a byte of each is kept.
COORDINATES = TREES * ROOT
#: Documents of a node that are compared exhaustively; documents of a block in larger nodes.
LEAF, BLOCK = 1024, 256
#: Tokens and documents of a part of a node whose full sets are compared, and columns of a product at once.
PART_TOKENS, PART_DOCUMENTS, TOKENS_AT_ONCE = 1 << 19, 2048, 2048
#: Rounds in which each document names its likeliest partner.
ROUNDS = 3


def agreement_bound(threshold: float, coordinates: int = COORDINATES, loss: float = 1e-6) -> int:
    """The largest number of agreeing coordinates that a pair at the threshold falls short of with probability under ``loss``."""
    p, total = (1 - threshold) ** coordinates, 0.0
    for k in range(coordinates + 1):
        if total + p > loss:
            return k
        total += p
        p *= (coordinates - k) / (k + 1) * threshold / max(1 - threshold, 1e-12)
    return coordinates


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the bounds of each text's run."""
    w = Words(texts, lower=True)
    h, n = hash_strings(w.distinct)[w.codes], w.counts()
    parts: list[np.ndarray] = []
    if len(h) >= words:
        s = np.zeros(len(h) - words + 1, np.uint64)
        for i in range(words):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(s)]
        s = mix(s)
    bounds = np.zeros(len(texts) + 1, np.int64)
    for row, (a, count) in enumerate(zip(w.bounds[:-1], n)):
        if count >= words:
            parts.append(np.unique(s[a : a + count - words + 1]))
        elif count:
            parts.append(np.array([xxhash.xxh64_intdigest(h[a : a + count].tobytes(), seed=int(count))], np.uint64))
        bounds[row + 1] = bounds[row] + (len(parts[-1]) if count else 0)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values, one row for each set that isn't empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), COORDINATES), np.int32)
    rng = np.random.default_rng(20240229)
    for j in range(COORDINATES):
        a, b = (int(x) for x in rng.integers(1, 2**63, 2))
        v = ((sets * np.uint64(a | 1) + np.uint64(b)) >> np.uint64(32)).astype(np.uint32)
        if len(starts):
            out[:, j] = np.minimum.reduceat(v, starts).view(np.int32)
    return out


FEATURES = "doc_id long, text_key long, n_shingles long, set_key binary, roots array<long>, sig binary"


def paths(sig: np.ndarray) -> np.ndarray:
    """The node of each tree that a signature reaches by its first levels."""
    h = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(sig), 1))
    tokens = sig.view(np.uint32).astype(np.uint64).reshape(len(sig), TREES, ROOT)
    for level in range(ROOT):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + tokens[:, :, level] + np.uint64(1))
    return h.view(np.int64)


def features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, hash of the text, size of the shingle set, 128-bit key of the whole set, root nodes and a byte of each MinHash value (null for the empty set)."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets, bounds = shingle_sets(batch.column("text"), words)
            n = np.diff(bounds)
            sig = signatures(sets, bounds)
            keys = [xxhash.xxh3_128_digest(sets[a:b].tobytes()) if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]
            offsets = np.concatenate(([0], np.cumsum((n > 0) * TREES))).astype(np.int32)
            roots = pa.ListArray.from_arrays(pa.array(offsets), pa.array(paths(sig).ravel(), pa.int64()), mask=pa.array(n == 0))
            low = iter((sig & 0xFF).astype(np.uint8))
            shown = [next(low).tobytes() if k else None for k in n]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), roots, pa.array(shown, pa.binary())], [c.split()[0] for c in FEATURES.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_key(docs).alias("text_key")), run, FEATURES)


def _text_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def _row_key(doc_id: Column, text_key: Column) -> tuple[Column, Column]:
    """What a row is looked up by: its doc_id, or the hash of its text where it has none."""
    return doc_id.isNull().alias("keyless"), F.coalesce(doc_id.cast("long"), text_key).alias("row_key")


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The full sets of the representatives in ``wanted`` (rep, keyless, row_key, set_key), as sorted 64-bit hashes."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets, bounds = shingle_sets(batch.column("text"), words)
            blobs = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            # a doc_id may be on several rows, of other sets as well
            own = pa.array([xxhash.xxh3_128_digest(x) == k for x, k in zip(blobs, batch.column("set_key").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(blobs, pa.binary())], ["rep", "hashes"]).filter(own)

    texts = docs.select(*_row_key(F.col("doc_id"), _text_key(docs)), F.col("text").cast("string"))
    return arrow_map(texts.join(wanted, ["keyless", "row_key"]).select("rep", "set_key", "text"), run, "rep long, hashes binary")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different documents whose full sets reach the threshold."""

    def run(batches):
        for batch in slices(batches, "set_b"):
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= round(100 * threshold) * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("set_a")), "a")
    joined = joined.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    return arrow_map(joined, run, "a long, b long").distinct()


def _nearest(nodes: DataFrame, seed: int, threshold: float) -> DataFrame:
    """For each document (rep, label, n, sig) the likeliest partner of another group in its nodes, as a pair (a, b), if signatures allow one."""
    at_least, ratio = agreement_bound(threshold), round(100 * threshold)

    def run(batches):
        for batch in batches:
            for members in batch.column("members"):
                m = members.values
                rep, label, n = (m.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "label", "n"))
                sig = _matrix(m.field("sig"))
                agree = np.zeros((len(rep), len(rep)), np.int16)
                for j in range(COORDINATES):
                    agree += sig[:, j, None] == sig[None, :, j]
                agree[label[:, None] == label[None, :]] = 0
                agree[np.minimum(n[:, None], n[None, :]) * 100 < np.maximum(n[:, None], n[None, :]) * ratio] = 0
                best = agree.argmax(1)
                most = agree[np.arange(len(rep)), best]
                ok = most >= at_least
                yield pa.RecordBatch.from_arrays([pa.array(rep[ok]), pa.array(rep[best[ok]]), pa.array(most[ok].astype(np.int32))], ["a", "b", "agree"])

    # larger nodes are dealt into blocks, anew in each round
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    dealt = nodes.join(sizes.select("node", F.ceil(F.col("size") / LEAF).cast("int").alias("of")), "node")
    block = F.pmod(F.xxhash64("rep", "node", F.lit(seed)), F.col("of"))
    grouped = dealt.groupBy("node", block.alias("block")).agg(F.collect_list(F.struct("rep", "label", "n", "sig")).alias("members"))
    named = arrow_map(grouped.select("members"), run, "a long, b long, agree int")
    best = named.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("minus"))).alias("x"))
    return best.select(F.greatest("a", -F.col("x.minus")).alias("a"), F.least("a", -F.col("x.minus")).alias("b")).distinct()


def _possible(nodes: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, rep, label, n) of ``nodes`` (with sig, asks) that their signatures let reach a document of another group of the node, if one of both asks."""
    at_least, ratio = agreement_bound(threshold), round(100 * threshold)

    def run(batches):
        for batch in batches:
            for node, members in zip(batch.column("node"), batch.column("members")):
                m = members.values
                rep, label, n, asks = (m.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "label", "n", "asks"))
                sig = _matrix(m.field("sig"))
                order = np.argsort(~asks, kind="stable")
                rep, label, n, sig = rep[order], label[order], n[order], sig[order]
                met = np.zeros(len(rep), bool)
                for i in range(int(asks.sum())):
                    other = (label[i + 1 :] != label[i]) & (np.minimum(n[i + 1 :], n[i]) * 100 >= np.maximum(n[i + 1 :], n[i]) * ratio)
                    near = np.flatnonzero(other) + i + 1
                    near = near[(sig[near] == sig[i]).sum(1) >= at_least]
                    met[near] = True
                    met[i] |= len(near) > 0
                k = int(met.sum())
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, node.as_py(), np.int64)), pa.array(rep[met]), pa.array(label[met]), pa.array(n[met])], ["node", "rep", "label", "n"])

    grouped = nodes.groupBy("node").agg(F.collect_list(F.struct("rep", "label", "n", "sig", "asks")).alias("members"))
    return arrow_map(grouped, run, "node long, rep long, label long, n long")


def spanning_links(sets: list[np.ndarray], label: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links of similarity ``threshold`` or more between sets of different labels, as few as connect the labels that all such links connect."""
    ratio, label = round(100 * threshold), np.unique(label, return_inverse=True)[1]
    n = np.array([len(x) for x in sets], np.int64)
    left = np.arange(len(sets))
    while len(left):
        tokens, owner = np.concatenate([sets[i] for i in left]), np.repeat(np.arange(len(left)), n[left])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        of = label[left][owner]
        # a token of one label only is in no intersection of two
        shared = np.minimum.reduceat(of, starts) < np.maximum.reduceat(of, starts)
        code = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tokens))))
        keep = shared[code]
        common = np.bincount(owner[keep], minlength=len(left))
        can = 100 * common >= ratio * n[left]
        if can.all():
            break
        left = left[can]
    if len(left) < 2:
        return []
    code, owner = (np.cumsum(shared) - 1)[code[keep]], owner[keep]
    names, n = label[left], n[left]
    asks = np.flatnonzero(names != np.bincount(names).argmax())
    both = np.zeros((len(asks), len(left)), np.float32)
    for first in range(0, int(shared.sum()), TOKENS_AT_ONCE):
        a, b = np.searchsorted(code, (first, first + TOKENS_AT_ONCE))
        has = np.zeros((len(left), TOKENS_AT_ONCE), np.float32)
        has[owner[a:b], code[a:b] - first] = 1
        both += has[asks] @ has.T
    linked = (100 * both >= ratio * (n[asks, None] + n[None, :] - both)) & (names[asks, None] != names[None, :])
    out, root = [], np.arange(names.max() + 1)
    for row, i in enumerate(asks):
        near = np.flatnonzero(linked[row])
        for other, at in zip(*np.unique(root[names[near]], return_index=True)):
            if other != root[names[i]]:
                out.append((int(left[i]), int(left[near[at]])))
                root[root == other] = root[names[i]]
    return out


def _node_links(possible: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the groups that meet in a node, by the full sets of its documents; of each node, no more than connect its groups."""

    def run(table: pa.Table) -> pa.Table:
        reps, label = table.column("rep").to_numpy(), table.column("label").to_numpy()
        links = spanning_links([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")], label, threshold)
        ends = [(max(reps[i], reps[j]), min(reps[i], reps[j])) for i, j in links]
        return pa.table({"a": pa.array([x for x, _ in ends], pa.int64()), "b": pa.array([x for _, x in ends], pa.int64())})

    # nodes of many tokens are dealt into parts, and each two parts of a node meet in a block
    weights = possible.groupBy("node").agg(F.greatest(F.sum("n") / PART_TOKENS, F.count("*") / PART_DOCUMENTS).alias("weight"))
    parts = F.when(F.col("weight") <= 2, 1).otherwise(F.ceil("weight")).cast("int")
    dealt = possible.join(weights.select("node", parts.alias("parts")), "node").withColumn("x", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or x <> y")
    dealt = dealt.select(F.xxhash64("node", F.least("x", "y"), F.greatest("x", "y")).alias("node"), "rep", "label")
    full = dealt.join(sets.groupBy("rep").agg(F.first("hashes").alias("hashes")), "rep")
    return full.groupBy("node").applyInArrow(run, "a long, b long").distinct()


def _branch(nodes: DataFrame, level: int) -> DataFrame:
    """The children of every node: its documents by the minwise token of each coordinate that the node selects."""
    j = lambda b: F.pmod(F.xxhash64("node", F.lit(level), F.lit(b)), F.lit(COORDINATES)).cast("int")
    child = lambda b: F.xxhash64("node", F.lit(level), F.lit(b), F.substring("sig", j(b) + 1, F.lit(1)))
    return nodes.select("rep", "label", "n", "sig", F.explode(F.array(*[child(b) for b in range(BRANCH)])).alias("node"))


def _block_pairs(large: DataFrame) -> DataFrame:
    """Nodes that stay large: blocks of the documents outside a node's largest group meet blocks of all its documents."""
    by_label = large.groupBy("node", "label").agg(F.count("*").alias("k"))
    most = by_label.groupBy("node").agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("size"))
    most = most.select("node", F.col("m.label").alias("main"), F.col("size"), (F.col("size") - F.col("m.k")).alias("rest"))
    parts = lambda c, per: F.ceil(F.col(c) / F.lit(per)).cast("int")
    dealt = large.join(most, "node").withColumns({"asking": parts("rest", BLOCK), "asked": parts("size", LEAF), "h": F.xxhash64("rep")})
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.col("h"), F.col(c)).cast("int")
    keep = ["node", "rep", "label", "n", "sig"]
    asks = dealt.where("label <> main").select(*keep, own("asking").alias("x"), each("asked").alias("y"), F.lit(True).alias("asks"))
    answers = dealt.select(*keep, each("asking").alias("x"), own("asked").alias("y"), F.lit(False).alias("asks"))
    return asks.union(answers).withColumn("node", F.xxhash64("node", "x", "y")).drop("x", "y")


def linked_groups(docs: DataFrame, feats: DataFrame, words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The representatives (rep, least, n, sig, set_key) of equal sets, and the component of each that has a link (id, component)."""
    row = F.struct(*_row_key(F.col("doc_id"), F.col("text_key")))
    by_set = feats.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min(row).alias("row"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("roots").alias("roots"))
    # numbers are given as the table is written, so they stay as they are
    reps = materialize(by_set.select(F.monotonically_increasing_id().alias("rep"), "least", "row.keyless", "row.row_key", "n", "sig", "roots", "set_key"), "near-reps")
    known = reps.select("rep", "keyless", "row_key", "set_key")
    walked = reps.select("rep", F.explode("roots").alias("node"))
    stats = walked.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").select("node")
    nodes = materialize(walked.join(stats, "node").join(reps.select("rep", "n", "sig"), "rep"), "near-nodes")
    # first the likeliest partners; every document with a possible partner gets its full set read once
    here, groups, tried, sets = nodes.withColumn("label", F.col("rep")), None, None, None
    for seed in range(ROUNDS):
        pairs = _nearest(here, seed, threshold)
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        sets = _with_sets(docs, known, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), sets, words)
        new = materialize(confirm(pairs, sets, threshold), "near-links")
        groups = _merged(groups, new)
        here = nodes.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").select("node", "rep", "n", "sig", F.coalesce("component", "rep").alias("label"))
    # then all pairs of different groups that meet in a node
    mixed = here.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("node", "size")
    here = here.join(mixed, "node")
    found: list[DataFrame] = []
    for level in range(DEPTH + 1):
        here = materialize(here, "near-mixed")
        leaf = here.where(F.col("size") <= LEAF).withColumn("asks", F.lit(True))
        found.append(_possible(leaf, threshold))
        large = here.where(F.col("size") > LEAF).drop("size")
        if large.isEmpty():
            break
        if level == DEPTH:
            found.append(_possible(_block_pairs(large), threshold))
            break
        below = _branch(large, level)
        mixed = below.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("node", "size")
        here = below.join(mixed, "node")
    possible = found[0]
    for x in found[1:]:
        possible = possible.union(x)
    possible = materialize(possible, "near-possible")
    sets = _with_sets(docs, known, possible.select("rep"), sets, words)
    second = materialize(_node_links(possible, sets, threshold), "near-links")
    return reps, _merged(groups, second)


def _merged(groups: DataFrame | None, found: DataFrame) -> DataFrame:
    """The components (id, component) of ``groups`` once the links ``found`` (a, b) join some of them."""
    known = [] if groups is None else [groups.select(F.col("id").alias("a"), F.col("component").alias("b"))]
    return connected_components(functools.reduce(DataFrame.union, known, found))


def _with_sets(docs: DataFrame, known: DataFrame, ids: DataFrame, sets: DataFrame | None, words: int) -> DataFrame:
    """``sets`` and the full sets of the representatives ``ids`` (rep) that it lacks."""
    ids = ids.distinct()
    if sets is not None:
        ids = ids.join(sets.select("rep"), "rep", "left_anti")
        if ids.isEmpty():
            return sets
    more = materialize(_sets_of(docs, known.join(ids, "rep", "left_semi"), words), "near-sets")
    return more if sets is None else sets.union(more)


def grouped_rows(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """doc_id, text_key, n_shingles, set_group (null for the empty set) and the group's least doc_id of each row of ``docs``."""
    feats = materialize(features(docs, words), "near-features")
    reps, groups = linked_groups(docs, feats, words, threshold)
    of_set = reps.select("set_key", "rep", "least").join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left")
    of_set = of_set.select("set_key", "least", F.coalesce("component", "rep").alias("set_group"))
    joined = groups.select(F.col("component").alias("set_group")).distinct().join(of_set, "set_group").groupBy("set_group").agg(F.min("least").alias("of_all"))
    named = of_set.join(joined, "set_group", "left").select("set_key", "set_group", F.when(F.col("of_all").isNull(), F.col("least")).otherwise(F.col("of_all")).alias("group_id"))
    return feats.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left").drop("set_key")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    out = grouped_rows(docs, words, threshold)
    component = F.when(F.col("n_shingles") > 0, F.col("group_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of near duplicates; rows with the empty set all stay."""
    rows = materialize(grouped_rows(docs, words, threshold).where("n_shingles > 0").select("set_group", *_row_key(F.col("doc_id"), F.col("text_key")), "text_key"), "near-rows")
    first = rows.groupBy("set_group").agg(F.min(F.struct("keyless", "row_key", "text_key")).alias("x"), F.count("*").alias("k")).where("k > 1")
    staying = first.select("set_group", F.col("x").alias("stays"))
    own = F.struct("keyless", "row_key", "text_key")
    in_groups = rows.join(staying, "set_group").select("keyless", "row_key", "text_key", (own == F.col("stays")).alias("stays"))
    # the row that stays may be there more than once
    ruled = in_groups.groupBy("keyless", "row_key", "text_key").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("times"))
    ruled = materialize(ruled.where("not stays or times > 1").select(*[F.col(c).alias(f"near_{c}") for c in ("keyless", "row_key", "text_key", "stays")]), "near-ruled")
    keyless, row_key = _row_key(F.col("doc_id"), _text_key(docs))
    same = lambda r: (keyless == r["near_keyless"]) & (row_key == r["near_row_key"]) & (_text_key(docs) == r["near_text_key"])
    out = docs.join(ruled, same(ruled), "left_anti").select(*docs.columns)
    repeated = ruled.where("near_stays")
    if repeated.isEmpty():
        return out
    one = docs.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.unionByName(one.select(*docs.columns))
