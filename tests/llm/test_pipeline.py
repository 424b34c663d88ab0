"""The whole pipeline against plain Python, stage by stage, on rows with nulls, empties, repeats, ties, a long text and clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from designlens.llm import decontaminate, unigram
from designlens.llm.queries import tokenizer_file

WORD = re.compile("[^\x20\x09-\x0d]+")
SYLLABLES = {"en": "the and wi th ho use ri ver".split(), "de": "der und mit haus flu schö ein".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def quality_fails(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows, at = {}, set()
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            at.update(i + k for i in places for k in range(3))
    n, chars = len(words), sum(map(len, words))
    return (
        n < 1 or 100 * len(at) > 50 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n or not 2 * n <= chars <= 15 * n
        or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or 10 * text.count("!!") > n or 10 * sum(c.isupper() for c in text) > 3 * chars
    )


def near_groups(rows):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(31), f"file://{tmp_path_factory.mktemp('sf')}"
    base = prose(rng, "en", 80).split()
    items = [prose(rng, "en", 25) for _ in range(3)]
    rows = [(i, prose(rng, lang, rng.randrange(30, 90)), lang) for i, lang in enumerate(["en", "de"] * 25)]
    for k in range(6):
        copy = list(base)
        copy[k * 7] = "changed"
        rows.append((100 + k, " ".join(copy), "en"))
    rows += [(110, " ".join(base), "en"), (110, " ".join(base), "en"), (110, prose(rng, "de", 60), "de"), (None, " ".join(base), "en"), (None, prose(rng, "en", 50), "en"), (None, rows[0][1], "en")]
    rows += [(120, f"{prose(rng, 'en', 30)} {items[0]} {prose(rng, 'en', 30)}", "en"), (121, f"{prose(rng, 'de', 30)} {items[1].upper()}", "de")]
    rows += [(130, None, "en"), (131, "", None), (132, "### $$$ %%%", "en"), (133, "!! " + "WITH!! THE!! " * 9, "en"), (134, "\n".join(["the with house river"] * 40), "en"), (135, "αβγδ εζηθ ικλμ νξοπ ρστυ φχψω " * 8, None), (136, prose(rng, "en", 30_000), "en"), (137, "the house", "en")]
    docs = spark.createDataFrame([(*r, f"src{i % 3}", i, "x", 1.5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, set_group string, lid_posterior double")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(7, None), (8, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_pipeline_equals_plain_python(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    listed = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    # languages: letterless, empty and foreign texts go
    after = stages["language_id"](spark, docs, path)
    assert after.columns == docs.columns
    left = listed(after)
    assert left == sorted(((d, t) for d, t, _ in rows if t and t.strip() and re.search(r"[a-zA-Z]", t)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    after = spark.createDataFrame(after.collect(), docs.schema)
    after = stages["quality_rules"](spark, after, path)
    left = [(d, t) for d, t in left if not quality_fails(t)]
    assert after.columns == docs.columns and listed(after) == left
    after = spark.createDataFrame(after.collect(), docs.schema)
    after = stages["near_dedup"](spark, after, path)
    groups, kept = near_groups(left), {}
    for (d, t), g in zip(left, groups):
        order = (d is None, d or 0)
        kept[g] = min(kept.get(g, (order, d, t)), (order, d, t), key=lambda x: x[0])
    got = listed(after)
    assert after.columns == docs.columns and len(got) == len(kept)
    assert sorted((d is None, d or 0) for d, _ in got) == sorted(x[0] for x in kept.values()) and set(got) <= set(left)
    after = spark.createDataFrame(after.collect(), docs.schema)
    after = stages["decontamination"](spark, after, path)
    left = got

    def contaminated(text):
        words = re.findall(r"[^\W_]+", text.lower())
        for item in items:
            own = re.findall(r"[^\W_]+", item.lower())
            codes = {w: i + 1 for i, w in enumerate(dict.fromkeys(own))}
            if {tuple(own[i : i + 3]) for i in range(len(own) - 2)} & {tuple(words[i : i + 3]) for i in range(len(words) - 2)}:
                score = decontaminate.align([np.array([codes[w] for w in own])], [np.array([codes.get(w, 0) for w in words])])[0][0]
                if score >= max(0.8 * len(own), min(12, 1.6 * len(own))):
                    return True
        return False

    left = [(d, t) for d, t in left if not contaminated(t)]
    assert listed(after) == left and not {120, 121} & {d for d, _ in left}
    vocab = unigram.Vocabulary(tokenizer_file("piece_bpe_32k.model"))
    out = {(r.doc_id, r.n_pieces, r.ids_crc32) for r in stages["sentencepiece"](spark, after, path).collect() if r.round_trip}
    expected = set()
    for d, t in left:
        words = unigram.MARKED.findall("▁" + t.replace(" ", "▁"))
        units = [u for w in words for u in vocab.units(w)]
        solved = vocab.segment(list(set(units)))
        ids = [i for u in units for i in solved[u]]
        expected.add((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert out == expected
    assert {(r.doc_id, r.n_pieces, r.ids_crc32) for r in corpus_pipeline.run(spark, path).collect()} == expected


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    path = folder[0]
    spark.read.parquet(f"{path}/documents.parquet").where("1 = 0").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
