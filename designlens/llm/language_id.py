"""Language identification by Bayesian fusion of text and address evidence.

Evidence for each language l of a document:

* text: a naive Bayes score of the character trigrams of its words, each word
  once for each time it occurs, tempered because neighbouring trigrams are not
  independent;
* the declared language (the markup's ``lang``, or a table's label): right with
  probability ``trust``;
* the host: a prior from grouped counts of declared languages, smoothed level by
  level: host towards the address suffix, suffix towards the whole corpus.

An unknown class stands beside the languages, so that texts in none of them can
be rejected: each trigram comes half from the mean of all languages and half from
any trigram alike, and the class has ``UNKNOWN`` of the prior. Random letters fit
the even half better than any language, and a text in a further language fits the
mean of several better than one of them, by an amount that grows with its length.
So that texts with passages in several of the languages stay, the class is held
against the best language of each ``PASSAGE`` words, not of the whole text.

The trigram counts come from all documents, by declared language, as a grouped
table of exact trigrams, so it grows with the corpus. Documents fall into two
halves by a hash of their text; the text of a document is scored with the counts
of the other half, so no document, nor an exact copy of it, is judged by a model
that holds its own label. Languages are all declared ones, however few their
documents; a half of the documents is judged among those that some document with
letters of the other half declares, as nothing is known of the trigrams of others.
More than ``MAX_LANGUAGES`` names are no languages but a wrong column and raise an
error. The table goes to the tasks in
blocks of about ``BLOCK_CELLS`` counts; a larger one takes further passes, each
carrying on the scores of the passages, so what is on the driver and sent to
tasks at once has a fixed bound and nothing is left out.

A document is rejected if it has no letters, or if its best language has a
posterior under ``min_posterior`` among all languages and the unknown class.

Defined results: null, empty and letterless texts get language "und", posterior
0 and are rejected; a text that the unknown class fits best gets "und" and the
posterior of its best language; a null or unknown declared language says nothing; a null
host takes the suffix's prior (none, then the corpus's); without any declared
language in the table every document is "und"; a declared language that only the
document's own half holds says nothing. Of languages with equal scores
the first by name wins. Rows are judged one by one, so repeated rows get equal
results. Texts of any length are scored whole. An empty table gives an empty one.
Further columns are passed through under any name; input columns named
``lid_lang``, ``lid_posterior`` or ``lid_kept`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from designlens.llm.columns import SLICE_BYTES, Words, arrow_map, run_sums, slices
from designlens.shared import materialize

#: Names that may be declared; all languages of the world have fewer.
MAX_LANGUAGES = 10_000
#: Counts of the trigram table that are sent to the tasks at once, and languages that are scored at once in a task.
BLOCK_CELLS, LANGUAGES_AT_ONCE = 1_000_000, 64
TRUST, TEMPER, MIN_POSTERIOR, UNKNOWN = 0.9, 0.5, 0.5, 1e-3
PASSAGE = 16
#: Log-likelihood of a trigram in a language of which nothing is known: never the best one.
UNHEARD = -1e6
#: Weight of the level above, in documents.
SUFFIX_WEIGHT, HOST_WEIGHT = 50.0, 20.0
#: A table of host priors goes to all tasks up to this many hosts; a larger one is joined.
BROADCAST_HOSTS = 50_000
FOLDS = 2


def letter_words(texts: pa.Array) -> Words:
    """Runs of letters; those with digits among them (numbers, keys, hashes) say nothing about a language."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"\pL*\pN[\pL\pN]*", " ")
    return Words(pc.replace_substring_regex(plain, r"[^\pL]+", " "))


def trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of each word, with its borders as spaces, as 63-bit numbers end to end, and the bounds of each word's run."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer((" " + " ".join(words.to_pylist()) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    t = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    keep = np.ones(len(t), bool)
    keep[starts[1:] - 1] = False  # a trigram around the space between two words
    return t[keep], np.concatenate(([0], np.cumsum(lengths)))


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1))


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")


def languages(docs: DataFrame, declared: str) -> list[tuple[str, int]]:
    """Declared languages and their documents."""
    counts = docs.groupBy(F.col(declared).cast("string").alias("l")).agg(F.count("*").alias("n"))
    found = counts.where(F.col("l").isNotNull()).orderBy("l").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"{declared} declares more than {MAX_LANGUAGES} languages")
    return [(r.l, r.n) for r in found]


def count_trigrams(docs: DataFrame, names: list[str]) -> DataFrame:
    """fold, l (place in ``names``), f (trigram), n, over all documents (text, label, fold) with a label of ``names``."""
    place = {name: i for i, name in enumerate(names)}

    def run(batches):
        for batch in slices(batches, "text"):
            label = np.array([place.get(x, -1) for x in batch.column("label").to_pylist()])
            w = letter_words(batch.column("text"))
            if not len(w.distinct):
                continue
            found, bounds = trigrams(w.distinct)
            keys, code = np.unique(found, return_inverse=True)
            group = np.where(label < 0, -1, label * FOLDS + batch.column("fold").to_numpy())[w.rows]
            for g in np.unique(group[group >= 0]):
                words = np.bincount(w.codes[group == g], minlength=len(w.distinct))
                total = np.bincount(code, weights=np.repeat(words, np.diff(bounds)), minlength=len(keys)).astype(np.int64)
                f = np.flatnonzero(total)
                cols = [pa.array(np.full(len(f), x), pa.int32()) for x in (g % FOLDS, g // FOLDS)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(keys[f]), pa.array(total[f])], ["fold", "l", "f", "n"])

    return arrow_map(docs.select("text", "label", "fold"), run, "fold int, l int, f long, n long").groupBy("fold", "l", "f").agg(F.sum("n").alias("n"))


class TextModel:
    """Log-likelihoods of passages in each language and, last, in the unknown class, by a block of the trigram table.

    The model of a half is smoothed by the number of its distinct trigrams
    (Witten-Bell) towards any of ``kinds`` trigrams alike. Scores of a block are
    what its trigrams add to those of passages of unseen trigrams. ``heard`` has
    the languages that the model of each half knows.
    """

    def __init__(self, cells: pa.Table, totals: np.ndarray, distinct: np.ndarray, kinds: int, first: bool):
        # totals, distinct: by fold and language, of the whole table
        self.first, self.even = first, 1.0 / max(kinds, 1)
        keys, code = np.unique(cells.column("f").to_numpy(), return_inverse=True)
        fold, l, n = (cells.column(c).to_numpy() for c in ("fold", "l", "n"))
        self.keys, self.languages = keys, totals.shape[1]
        self.models, self.heard = [], totals.sum(0) - totals > 0
        for k in range(FOLDS):
            use = fold != k
            own = (totals.sum(0) - totals[k], distinct.sum(0) - distinct[k] + 1)
            unseen = own[1] * self.even / (own[0] + own[1])
            order = np.lexsort((l[use], code[use]))
            at, lang, count = code[use][order], l[use][order], n[use][order].astype(float)
            more = count / (own[0] + own[1])[lang]
            heard = max(int(self.heard[k].sum()), 1)
            rest = unseen[self.heard[k]].sum() / heard
            mean = rest + np.bincount(at, weights=more, minlength=len(keys)) / heard
            none = 0.5 * rest + 0.5 * self.even
            unknown = np.log((0.5 * mean + 0.5 * self.even) / none)
            add = np.log1p(more / unseen[lang]).astype(np.float32)
            self.models.append((np.append(np.where(self.heard[k], np.log(unseen), UNHEARD), np.log(none)), np.searchsorted(at, np.arange(len(keys) + 1)), lang.astype(np.int32), add, unknown.astype(np.float32)))

    def score(self, texts: pa.Array, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each passage in each class, the bounds of each text's passages, and its number of trigrams."""
        w = letter_words(texts)
        classes = self.languages + 1
        if not len(w.distinct):
            return np.zeros((0, classes)), np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts), np.int64)
        found, bounds = trigrams(w.distinct)
        own, code = np.unique(found, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
        known = self.keys[at] == own if len(self.keys) else np.zeros(len(own), bool)
        length = np.diff(bounds)
        starts = np.flatnonzero((np.arange(len(w.codes)) - w.bounds[w.rows]) % PASSAGE == 0)
        passage_fold = folds[w.rows[starts]]
        out = np.zeros((len(starts), classes))
        for k, (unseen, begin, lang, add, unknown) in enumerate(self.models):
            if not (passage_fold == k).any():
                continue
            many = np.where(known, np.diff(begin)[at] if len(self.keys) else 0, 0)
            cell = np.repeat(begin[at], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            trigram = np.repeat(np.arange(len(own)), many)
            here = lang[cell]
            for first in range(0, classes, LANGUAGES_AT_ONCE):
                last = min(first + LANGUAGES_AT_ONCE, classes)
                table = np.zeros((len(own), last - first), np.float32)
                use = (here >= first) & (here < last)
                table[trigram[use], here[use] - first] = add[cell[use]]
                if last == classes and len(self.keys):
                    table[known, -1] = unknown[at[known]]
                for j in range(first, last):
                    word = np.add.reduceat(table[code, j - first].astype(float), bounds[:-1])
                    word += unseen[j] * length if self.first else 0
                    x = np.add.reduceat(word[w.codes], starts)
                    out[passage_fold == k, j] = x[passage_fold == k]
        return out, np.searchsorted(starts, w.bounds), run_sums(length[w.codes], w.bounds)


def host_counts(labelled: DataFrame, names: list[str]) -> DataFrame:
    """host, and documents by place in ``names`` (l, n) of it and of its suffix, from (host, label)."""
    places = F.broadcast(labelled.sparkSession.createDataFrame(list(enumerate(names)), "l int, label string"))
    counted = labelled.groupBy("host", "label").agg(F.count("*").alias("n")).join(places, "label").select("host", suffix_of(F.col("host")).alias("suffix"), "l", "n")
    listed = F.collect_list(F.struct("l", "n"))
    by_host = counted.where("host is not null").groupBy("host", "suffix").agg(listed.alias("of_host"))
    by_suffix = counted.groupBy("suffix", "l").agg(F.sum("n").alias("n")).groupBy("suffix").agg(listed.alias("of_suffix"))
    both = by_host.join(by_suffix, by_host["suffix"].eqNullSafe(by_suffix["suffix"]))
    return both.select("host", "of_host", "of_suffix")


def _counts(lists: pa.ListArray, languages: int) -> np.ndarray:
    """Each row's counts by place."""
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    place, n = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
    out = np.zeros((len(lists), languages))
    out[row, place] = n
    return out


class Fusion:
    """The verdict from text scores, declared language and host prior."""

    def __init__(self, names: list[str], overall: np.ndarray, trust: float, min_posterior: float):
        self.names, self.place, self.overall = names, {x: i for i, x in enumerate(names)}, overall
        self.trust, self.min_posterior = trust, min_posterior

    def judge(self, passages: np.ndarray, bounds: np.ndarray, n: np.ndarray, heard: np.ndarray, declared: list, of_host: pa.ListArray, of_suffix: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior and whether it is kept, of each text; ``heard`` has the languages that each text's model knows."""
        many = len(self.names)
        text = np.stack([run_sums(x, bounds) for x in passages.T], 1) if len(passages) else np.zeros((len(n), many + 1))
        place = np.array([self.place.get(x, -1) for x in declared], np.int64)
        # a language that the model doesn't know can't be held against others
        place[~heard[np.arange(len(place)), place]] = -1
        others = heard.sum(1)
        wrong = (1 - self.trust) / np.maximum(others - 1, 1)
        said = np.repeat(np.where(place < 0, 0.0, np.log(np.where(wrong > 0, wrong, 1.0)))[:, None], many, 1)
        own = np.flatnonzero(place >= 0)
        said[own, place[own]] = np.log(self.trust)
        h, s = _counts(of_host, many), _counts(of_suffix, many)
        prior = (h + HOST_WEIGHT * (s + SUFFIX_WEIGHT * self.overall) / (s.sum(1, keepdims=True) + SUFFIX_WEIGHT)) / (h.sum(1, keepdims=True) + HOST_WEIGHT)
        post = text[:, :many] * TEMPER + said + np.log(prior) + np.log(1 - UNKNOWN)
        best = post.argmax(1)
        top = post[np.arange(len(post)), best]
        # a text in several languages fits none as a whole: what it gains by a language for each passage is taken from the unknown class
        gain = run_sums(passages[:, :many].max(1) if len(passages) else np.zeros(0), bounds) - text[np.arange(len(text)), best]
        unknown = TEMPER * text[:, -1] + np.where(place < 0, 0.0, -np.log(np.maximum(others, 1))) + np.log(UNKNOWN) - TEMPER * gain
        sure = np.where(n > 0, 1 / (np.exp(np.logaddexp.reduce(post, 1) - top) + np.exp(np.minimum(unknown - top, 700.0))), 0.0)
        name = [self.names[b] if k and u <= t else "und" for b, k, u, t in zip(best, n > 0, unknown, top)]
        return name, sure, (n > 0) & (sure >= self.min_posterior)


def identify(docs: DataFrame, declared: str = "lang", host: str = "source", text: str = "text", trust: float = TRUST, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The rows of ``docs`` with all their columns and, after them, ``lid_lang``, ``lid_posterior``, ``lid_kept``."""
    found = ["lid_lang", "lid_posterior", "lid_kept"]
    passed = [c for c in docs.columns if c not in found]
    known = languages(docs, declared)
    if not known:
        return docs.select(*[F.col(f"`{c}`") for c in passed], F.lit("und").alias("lid_lang"), F.lit(0.0).alias("lid_posterior"), F.lit(False).alias("lid_kept"))
    names = [x for x, _ in known]
    overall = np.array([n for _, n in known], float)
    fusion = Fusion(names, (overall + 1) / (overall + 1).sum(), trust, min_posterior)
    # own names inside, so that no column of the input can clash
    plain = [F.col(text).cast("string").alias("text"), F.col(declared).cast("string").alias("label"), F.lower(F.col(host).cast("string")).alias("host"), fold_of(F.col(text).cast("string")).alias("fold")]
    counted = materialize(count_trigrams(docs.select(*plain), names), "trigrams")
    sums = counted.groupBy("fold", "l").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    totals, distinct = np.zeros((2, FOLDS, len(names)))
    for r in sums:
        totals[r.fold, r.l], distinct[r.fold, r.l] = r.n, r.kinds
    kinds = counted.select("f").distinct().count()
    blocks = max(1, -(-int(distinct.sum()) // BLOCK_CELLS))
    priors = materialize(host_counts(docs.select(*plain), names), "host-priors")
    # a row for each host
    small = priors.count() <= BROADCAST_HOSTS
    others = [c for c in passed if c != text]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)], *plain)
    rows = rows.join(F.broadcast(priors) if small else priors, "host", "left").drop("host")
    own = rows.columns
    for b in range(blocks):
        cells = counted.where(F.pmod(F.xxhash64("f"), F.lit(blocks)) == b).toArrow()
        model, last = TextModel(cells, totals, distinct, kinds, b == 0), b == blocks - 1

        def run(batches, model=model, first=b == 0, last=last):
            # scores take a row of numbers a passage, so fewer texts at once with many languages
            for batch in slices(batches, "text", SLICE_BYTES * LANGUAGES_AT_ONCE // max(LANGUAGES_AT_ONCE, model.languages)):
                folds = batch.column("fold").to_numpy()
                passages, bounds, n = model.score(batch.column("text"), folds)
                if not first:
                    passages = passages + batch.column("passages").flatten().to_numpy(zero_copy_only=False).reshape(passages.shape)
                kept = [batch.column(c) for c in own]
                if last:
                    lang, sure, keep = fusion.judge(passages, bounds, n, model.heard[folds], batch.column("label").to_pylist(), batch.column("of_host"), batch.column("of_suffix"))
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(keep, pa.bool_())], [*own, *found])
                else:
                    ends = pa.array(bounds * passages.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(ends, pa.array(passages.ravel()))], [*own, "passages"])

        types = {"lid_lang": F.lit(""), "lid_posterior": F.lit(0.0), "lid_kept": F.lit(True)} if last else {"passages": F.array(F.lit(0.0))}
        rows = arrow_map(rows, run, rows.select(*own).withColumns(types).schema)
        rows = rows if last else materialize(rows, "languages")
    back = {c: F.col(f"_{i}").alias(c) for i, c in enumerate(others)} | {text: F.col("text").cast(docs.schema[text].dataType).alias(text)}
    return rows.select(*[back[c] for c in passed], *found)
