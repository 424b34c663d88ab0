"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased, so case and punctuation do
not hide a copy. One pass over the corpus counts, for every ``n``-word sequence
of the benchmark, the documents that hold it. An item's seeds are its sequences
that at most ``RARE`` of all documents hold, and in any case those that are at
most ``FAR`` times as frequent as its median one. The sequences of an item that
many documents copy are about as frequent as each other, so it keeps all of them,
also the ones that edited copies keep most; only sequences that are common apart
from the item go. A sequence may be a seed of one item and not of another: what a
short item made of a common phrase keeps is no seed of longer ones. A second pass
joins the seeds to the documents' words, gathers hits on neighbouring diagonals
and aligns the item with the words around them (match +2, mismatch -1, gap -1).
One hit is enough for an alignment, which alone decides; the alignments of a
slice of documents are computed together, in tables of at most ``CELLS`` cells.
A document is contaminated by an item if the alignment's score reaches
``min_score`` of a perfect one and that of ``MIN_WORDS`` words in a row; of an item
with fewer words, ``WHOLE`` of a perfect one. So short items count by whole or
nearly whole copies only.

Both passes see whole texts and need no shuffle of them: the benchmark goes to
the tasks in blocks of at most ``BLOCK_WORDS`` words, each block in passes of
its own, so what is sent at once has a fixed bound for a benchmark of any size.

Defined results: null and empty texts hit nothing; an item with fewer than
``n`` words has no seeds and is never matched, since one or two words are no
evidence of a copy; items that repeat an item_id are separate items with one id,
the best score counts, of equal scores the later passage; ``decontaminate`` judges
rows that repeat a document one by one, ``contaminated`` names a doc_id and item
once; items without an item_id are not used. Texts of any length are read whole,
a long one in a slice of its own; empty tables contaminate nothing. Of ``docs``
only ``doc_id`` and ``text`` are read; further columns are passed through by
``decontaminate`` under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designlens.llm.columns import Words, arrow_map, slices

N, MIN_SCORE, RARE, FAR = 3, 0.4, 1e-4, 8
#: Least evidence: words in a row, or this share of an item with fewer words.
MIN_WORDS, WHOLE = 6, 0.8
#: Cells of the tables that alignments are computed in at once (a single alignment may need more).
CELLS = 1 << 18
#: Words of the benchmark that are sent to the tasks at once.
BLOCK_WORDS = 1_000_000


def plain_words(texts: pa.Array) -> Words:
    return Words(pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\pL\pN]+", " "))


def needed(length: int, min_score: float = MIN_SCORE) -> float:
    """Least score that makes a copy of an item of ``length`` words."""
    return 2 * max(min_score * length, min(MIN_WORDS, WHOLE * length))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item's word codes with its passage: score, and the place after its last word (the first of equal ones)."""
    longest, widest = max(map(len, items)), max(map(len, passages))
    # what fills up an item or a passage equals nothing
    left, right = np.full((len(items), longest), -1), np.full((len(items), widest), -2)
    for k, (item, passage) in enumerate(zip(items, passages)):
        left[k, : len(item)], right[k, : len(passage)] = item, passage
    left[left == 0] = -1
    steps = np.arange(widest + 1)
    rows = np.zeros((len(items), widest + 1), np.int64)
    best, end = np.zeros((2, len(items)), np.int64)
    for i in range(longest):
        diagonal = rows[:, :-1] + np.where(left[:, i : i + 1] == right, 2, -1)
        above = np.maximum(np.maximum(diagonal, rows[:, 1:] - 1), 0)
        # a gap along the words costs 1 a step: a running maximum
        rows[:, 1:] = np.maximum.accumulate(above + steps[1:], axis=1) - steps[1:]
        place = rows.argmax(1)
        top = rows[np.arange(len(rows)), place]
        end = np.where(top > best, place, end)
        best = np.maximum(top, best)
    return best, end


class Block:
    """Items of the benchmark, their words, their sequences, and which items hold each."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        w = plain_words(pa.array(texts, pa.string()))
        self.n, self.ids, self.vocabulary = n, ids, w.distinct
        self.items = [w.codes[a:b].astype(np.int64) + 1 for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        self.size = len(w.distinct) + 1
        keys, items, places = [], [], []
        for k, codes in enumerate(self.items):
            g = self.grams(codes)
            keys.append(g)
            items.append(np.full(len(g), k))
            places.append(np.arange(len(g)))
        keys, items, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, items, places))
        order = np.argsort(keys, kind="stable")
        self.item_of, self.place_of = items[order], places[order]
        self.keys, starts = np.unique(keys[order], return_index=True)
        self.starts = np.append(starts, len(order))

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """A key for each n words in a row; negative where a word isn't in the benchmark."""
        count = max(len(codes) - self.n + 1, 0)
        key, known = np.zeros(count, np.uint64), np.ones(count, bool)
        for i in range(self.n):
            part = codes[i : i + count]
            # exact while size ** n fits; beyond that a 63-bit hash
            key = key * np.uint64(self.size if self.size**self.n < 1 << 63 else 0x9E3779B97F4A7C15) + part.astype(np.uint64)
            known &= part > 0
        return np.where(known, (key & np.uint64((1 << 63) - 1)).astype(np.int64), -1)

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, word places and sequences of all hits; also the texts' codes and bounds."""
        w = plain_words(texts)
        known = pc.index_in(w.distinct, self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        codes = known[w.codes]
        g = self.grams(codes)
        if len(g):
            g = np.where(w.rows[: len(g)] == w.rows[self.n - 1 :], g, -1)
        at = np.flatnonzero(g >= 0)
        if not len(self.keys):
            at = at[:0]
        k = np.minimum(np.searchsorted(self.keys, g[at]), max(len(self.keys) - 1, 0))
        same = self.keys[k] == g[at] if len(at) else np.zeros(0, bool)
        self._codes, self._bounds = codes, w.bounds
        return w.rows[at[same]], at[same], k[same], codes

    def count(self, texts: pa.Array) -> np.ndarray:
        """Texts that hold each sequence."""
        rows, _, k, _ = self.hits(texts)
        pairs = np.unique(rows * max(len(self.keys), 1) + k)
        return np.bincount(pairs % max(len(self.keys), 1), minlength=len(self.keys))

    def choose(self, frequency: np.ndarray, documents: int, rare: float) -> None:
        """Keep each item's rare sequences, and those that are not far more frequent than its median one."""
        gram = np.repeat(np.arange(len(self.keys)), np.diff(self.starts))
        often = frequency[gram]
        order = np.lexsort((often, self.item_of))
        first, last = (np.searchsorted(self.item_of[order], self.item_of, side=x) for x in ("left", "right"))
        median = often[order][(first + last) // 2] if len(order) else often
        keep = (often <= rare * documents) | (often <= FAR * np.maximum(median, 1))
        self.item_of, self.place_of = self.item_of[keep], self.place_of[keep]
        self.starts = np.concatenate(([0], np.cumsum(keep)))[self.starts]

    def matches(self, texts: pa.Array, min_score: float) -> Iterator[tuple[int, int, float, int, int]]:
        """Row, item, score as a share of a perfect one, first and last word of the aligned passage."""
        rows, places, k, codes = self.hits(texts)
        before = None
        bounds = self._bounds
        many = np.diff(self.starts)[k]
        at = np.repeat(self.starts[k], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        row, place, item, own = np.repeat(rows, many), np.repeat(places, many), self.item_of[at], self.place_of[at]
        order = np.lexsort((place - own, item, row))
        row, item, own, diagonal = row[order], item[order], own[order], (place - own)[order]
        length = np.array([len(x) for x in self.items], np.int64)[item] if len(item) else item
        # hits go on with the last one on a diagonal within half an item of it
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > length[1:] // 2 + 4)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(row))[: len(starts)] - 1
        row, item, words = row[starts], item[starts], length[starts]
        slack = words // 4 + 4
        low = np.maximum(bounds[row], diagonal[starts] - slack)
        high = np.minimum(bounds[row + 1], diagonal[ends] + words + slack)
        score, end = np.zeros((2, len(starts)), np.int64)
        # passages of like lengths together, so that little is filled up
        order = np.lexsort((high - low, words))
        at = 0
        while at < len(order):
            wide = np.maximum.accumulate((high - low)[order[at : at + CELLS]]) + 1
            some = order[at : at + max(1, int((wide * np.arange(1, len(wide) + 1) <= CELLS).sum()))]
            score[some], end[some] = align([self.items[i] for i in item[some]], [codes[a:b] for a, b in zip(low[some], high[some])])
            at += len(some)
        found = np.flatnonzero(score >= np.array([needed(len(x), min_score) for x in self.items])[item])
        found = found[np.lexsort((found, -score[found], item[found], row[found]))]
        for r, i, x, last, begin, own in zip(*(v[found].tolist() for v in (row, item, score, end, low - bounds[row], words))):
            if (r, i) != before:
                yield r, i, x / (2 * own), begin + max(0, last - 2 * own), begin + last
            before = (r, i)


def blocks(benchmark: DataFrame, n: int, block_words: int) -> Iterator[Block]:
    """The benchmark, in blocks of a bounded number of words, read one after the other."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    # about four characters and a space for a word at the least
    count = max(1, -(-total // (5 * block_words)))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield Block([r.item_id for r in rows], [r.text for r in rows], n)


def seeded_blocks(docs: DataFrame, benchmark: DataFrame, n: int = N, rare: float = RARE, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Blocks with their seeds chosen by document frequency over all of ``docs``."""
    texts = docs.select(F.col("text").cast("string"))
    for block in blocks(benchmark, n, block_words):

        def run(batches, block=block):
            total, documents = np.zeros(len(block.keys), np.int64), 0
            for batch in slices(batches, "text"):
                total += block.count(batch.column("text"))
                documents += batch.num_rows
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(total[k], documents))], ["k", "n"])

        # a row for each sequence of the block at most, whatever the size of the corpus
        counts = arrow_map(texts, run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        k, c = counts.column("k").to_numpy(), counts.column("n").to_numpy()
        frequency = np.zeros(len(block.keys), np.int64)
        frequency[k[k >= 0]] = c[k >= 0]
        block.choose(frequency, int(c[k < 0].sum()), rare)
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, min_score: float = MIN_SCORE, rare: float = RARE) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word of each document and item that it holds a copy of."""
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in seeded_blocks(docs, benchmark, n, rare):

        def run(batches, block=block):
            for batch in slices(batches, "text"):
                found = list(block.matches(batch.column("text"), min_score))
                if not found:
                    continue
                row, item, score, first, last = zip(*found)
                cols = [batch.column("doc_id").take(pa.array(row)), pa.array([block.ids[i] for i in item], pa.int64()), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "score", "first_word", "last_word"])

        out = out.union(arrow_map(rows, run, schema))
    best = F.max(F.struct("score", "first_word", "last_word")).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, min_score: float = MIN_SCORE, rare: float = RARE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no copy of a benchmark item."""
    out = docs
    for block in seeded_blocks(docs, benchmark, n, rare):

        def run(batches, block=block):
            for batch in slices(batches, "text"):
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in block.matches(batch.column("text"), min_score):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        out = arrow_map(out, run, docs.schema)
    return out
