"""Merkle manifests, repaired conversations and exact search on small tables, against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from designlens.llm import conversation, merkle, topk_search
from designlens.llm.queries import ORACLES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def empty(df):
    return df.where("1 = 0")


# --- manifests


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def climb(nodes):
        """All levels, the last of one node."""
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def steps(tree, i):
        for nodes in tree[:-1]:
            a = i - i % 8
            yield nodes[a:i], nodes[i + 1 : a + 8]
            i //= 8

    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for p in names:
        parts[p].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[p] = climb([leaf(r) for r in parts[p]])
    upper = climb([trees[p][-1][0] for p in names])
    out = []
    for k, p in enumerate(names):
        for i, r in enumerate(parts[p]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node, proof = leaf((*r[:4], low(r[4]))) if tampered else leaf(r), ""
            for left, right in [*steps(trees[p], i), *steps(upper, k)]:
                proof += "".join(left + right)
                node = sha("".join([*left, node, *right]))
            out.append((r[0], leaf(r), trees[p][-1][0], upper[-1][0], sha(proof), node, node == upper[-1][0]))
    return sorted(out, key=repr)


DOC = "doc_id long, source string, lang string, n_chars long, text string"


def made_documents(n, langs):
    r = random.Random(n)
    rows = [(r.randrange(10 * n), r.choice(["a.de", None, ""]), langs[i % len(langs)] if i % 3 else langs[0], r.choice([None, i]), r.choice([None, "", f"Text {i} É\n", "SHOUT", "quiet"])) for i in range(n)]
    return rows + rows[:5] + [(None, None, None, None, None), (None, "s", langs[0], 3, "No Key"), (rows[0][0], "other", langs[0], 1, "Same Key")]


def digests(found):
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (30, ["en", None, "", "é", "Z"]), (700, ["en", "de"])])
def test_manifest_equals_plain_python(spark, n, langs):
    rows = made_documents(n, langs)
    assert digests(merkle.manifest_digest(spark.createDataFrame(rows, DOC).repartition(3))) == plain_manifest(rows)


def test_manifest_of_several_layers_and_many_parts(spark):
    """Blocks of eight nodes, so that two hundred leaves of a part need layers of blocks, and so do the parts."""
    rows = made_documents(200, [f"l{i:02d}" for i in range(11)])
    leaves = merkle.document_leaves(spark.createDataFrame(rows, DOC))
    assert digests(merkle.proofs(merkle.build(leaves, depth=1)).withColumnsRenamed({"key": "doc_id", "node": "leaf"})) == plain_manifest(rows)


def test_manifest_of_nothing_one_row_and_clashing_columns(spark):
    none = spark.createDataFrame([], DOC)
    assert merkle.manifest_digest(none).count() == 0
    one = spark.createDataFrame([(7, None, None, None, "A")], DOC)
    row = merkle.manifest_digest(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")
    extra = one.selectExpr("*", "1 AS key", "'x' AS node", "'y' AS changed", "'z' AS part", "0 AS place", "1 AS total", "2 AS block", "3 AS _group")
    assert digests(merkle.manifest_digest(extra)) == digests(merkle.manifest_digest(one))


def test_versions_share_all_but_their_own_path(spark):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(600)]
    built = merkle.build(merkle.document_leaves(spark.createDataFrame(rows, DOC)))
    found = {r.key: r for r in merkle.proofs(built).collect()}
    root = found[0].root
    for key, r in found.items():
        assert len(r.siblings) == 4  # levels of 600 leaves
        tampered = zlib.crc32(str(key).encode()) % 3 == 0
        assert bool(r.copied) == tampered and r.verified == (not tampered) and (r.folded_root == root) == (not tampered)
        if tampered:
            assert len(r.copied) == 5 and r.copied[0] != r.node and r.copied[-1] == r.folded_root


# --- conversations


def plain_repair(rows):
    """Every way of editing up to a cost, by search over sequences: (cost, audit, turns) of the least (cost, audit)."""
    faults = conversation_faults(rows)
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = None

    def go(i, state, cost, audit, turns):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and state in ("", "a") and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, turns)
        for letter, role in (("u", "user"), ("a", "assistant")):
            if letter in step[state] and not audit.endswith("II"):
                go(i, letter, cost + 2, audit + "I", [*turns, (role, "")])
        if i == len(rows):
            return
        role, text = rows[i]
        go(i + 1, state, cost + 3, audit + "D", turns)
        if faults[i] in ("blank", "duplicate"):
            return
        extra = faults[i] == "truncated"
        if role[:1] in step[state]:
            go(i + 1, role[0], cost + extra, audit + "K", [*turns, (role, text)])
        for letter, new in (("u", "user"), ("a", "assistant")):
            if letter in step[state]:
                go(i + 1, letter, cost + 2 + extra, audit + "R", [*turns, (new, text)])

    go(0, "", 0, "", [])
    return best


def conversation_faults(rows):
    out = []
    for i, (role, text) in enumerate(rows):
        body = re.findall("[^\x20\x09-\x0d]", text)
        out.append("blank" if not body else "duplicate" if (role, text) in rows[:i] else "truncated" if body[-1] not in ".!?" else "")
    return out


def plain_digest(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns, pairs = [r[0] for r in rows if r[0] is not None], [r[1:] for r in rows]
    faults, cost_audit = conversation_faults(pairs), plain_repair(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost_audit[0], cost_audit[1], sha("\n".join(f"{a}:{b}" for a, b in cost_audit[2])))


def made_conversations(n, seed, most=6):
    r, rows = random.Random(seed), []
    for conv in range(n):
        for _ in range(r.randrange(1, most + 1)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "s", "User"])
            text = r.choice(["Yes.", "No", "", " \n", "What?", "Go! ", "a b\n.", "é"])
            rows.append((conv if conv else None, r.choice([None, 0, 1, 2, 3, 5, 9]), role, text, r.choice([0, 1, 1, 1, 2])))
    return rows


ROWS = "conv_id long, turn long, role string, text string, copies int"


def expected_digests(rows):
    convs = {}
    for conv, turn, role, text, copies in rows:
        convs.setdefault(conv, []).extend([(turn, role, text)] * copies)
    return sorted((plain_digest(c, x) for c, x in convs.items()), key=repr)


@pytest.mark.parametrize("limit, chunk", [(1000, 256), (0, 256), (2, 2)])
def test_repair_equals_a_search_of_all_edits(spark, monkeypatch, limit, chunk):
    """By the stream, by chunks, and by chunks of two rows that are joined two at a time."""
    monkeypatch.setattr(conversation, "CHUNK", chunk)
    monkeypatch.setattr(conversation, "JOINED", 2 if chunk == 2 else 16)
    rows = made_conversations(60, 1)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert sorted((tuple(r) for r in conversation.repair_digest(df, long_rows=limit).collect()), key=repr) == expected_digests(rows)
    turns = {}
    for t in conversation.repaired_turns(df, long_rows=limit).orderBy("place").collect():
        turns.setdefault(t.conv_id, []).append((t.role, t.text))
    for row in expected_digests(rows):
        own = turns.get(row[0], [])
        assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in own))
        assert sha("\n".join(f"{a}:{b}" for a, b in own)) == row[8]


def test_repair_of_long_conversations_joins_chunks(spark):
    """One conversation of 3,000 rows and others of a few: chunks and the stream agree."""
    r = random.Random(3)
    rows = [(1, i // 2, r.choice(["user", "assistant"]), f"{r.randrange(900)}{r.choice('.!x')}", 1) for i in range(3000)] + [(2, 0, "user", "Hi.", 1), (2, 1, "assistant", "Yes.", 1), (3, 0, "user", "gone", 0)]
    df = spark.createDataFrame(rows, ROWS)
    by_chunks = sorted(map(tuple, conversation.repair_digest(df).collect()))
    assert by_chunks == sorted(map(tuple, conversation.repair_digest(df, long_rows=10_000).collect()))
    assert by_chunks[1][6:8] == (0, "KK")
    assert by_chunks[2] == (3, 0, 0, 0, 0, 0, 0, "", sha(""))


def test_damage_of_odd_rows(spark):
    rows = [(i % 7 if i % 5 else None, i if i % 4 else None, None if i % 6 == 0 else "user", None if i % 9 == 0 else f"A.{i}!") for i in range(80)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    text = lambda v: " " if v is None else str(v)
    expected = []
    for conv, turn, role, body in rows:
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        body = "" if kind == 1 else re.sub("[.!?]", "", text(body)) if kind == 2 else text(body)
        expected.append((conv, turn, "user" if kind == 4 else text(role), body, {0: 0, 3: 2}.get(kind, 1)))
    assert [tuple(r) for r in conversation.damage(df.withColumn("copies", df.turn)).collect()] == expected
    assert conversation.repair_digest(conversation.damage(empty(df))).count() == 0
    assert conversation.repair_digest(conversation.damage(df)).count() == 8


def test_weights_order_by_cost_then_audit():
    ways = conversation.Weights(4)
    made = [(c, a) for c in (0, 2) for a in ("", "D", "DI", "DK", "IKRD", "K", "RR")]
    assert sorted(made) == [ways.read(w) for w in sorted(ways.of(*x) for x in made)]


# --- search


def plain_top(rows, k=5, every=50):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(whole):
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, (j, v) in enumerate(whole) if m != n)[:k]
            out += [(i, rank, None if missing else j, -s) for rank, (s, missing, j) in enumerate(found, 1)]
    return sorted(out, key=repr)


def answers(df, **more):
    return sorted((tuple(r) for r in topk_search.top_k(df, **more).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def made_vectors(n, kind):
    r = np.random.default_rng(n)
    if kind == "copies":
        x = r.integers(-2, 3, (n, 3)) / 4
        x[n // 3 :] = x[0]
    elif kind == "clusters":
        x = r.normal(size=(8, 6))[r.integers(0, 8, n)] * 4 + r.normal(size=(n, 6)) / 20
    else:
        x = r.normal(size=(n, 6)) * (1e6 if kind == "large" else 1)
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies", "large"])
@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_search_equals_brute_force(spark, monkeypatch, kind, sent):
    monkeypatch.setattr(topk_search, "SHARD", 100)
    monkeypatch.setattr(topk_search, "SENT", sent)
    rows = made_vectors(700, kind)
    assert answers(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)) == plain_top(rows)


def test_search_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [9.0, 9.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [3.0]), (6, []), (50, [-1.0, 0.1, 0.7]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    padded = [(i, None if v is None else [*v, *[0.0] * (3 - len(v))]) for i, v in rows]
    assert answers(df) == plain_top(padded)
    assert answers(df.selectExpr("*", "1 AS vec", "2 AS pivot", "3 AS home", "4 AS score", "5 AS shard")) == plain_top(padded)
    assert answers(empty(df)) == [] and answers(df.where("vec_id = 0").limit(1)) == [] and answers(df.where("vec_id = 1")) == []
    huge = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0])]
    assert [r[3] for r in answers(spark.createDataFrame(huge, "vec_id long, embedding array<double>"))] == [2**63 - 1, -(2**63) + 1]


def test_bounds_hold_and_prune():
    """No vector scores above its annulus's bound, and clustered vectors are not all compared."""
    x = np.floor(256 * np.array([v for _, v in made_vectors(3000, "clusters")]))
    pivots = topk_search.fit_pivots(x[:500])
    d = topk_search.distances(x, pivots)
    order = np.lexsort((d.min(1), d.argmin(1)))
    x, d = x[order], d[order]
    norm = (x * x).sum(1)
    cells = topk_search.Cells.of(d.argmin(1), d.min(1), norm)
    assert cells.n.sum() == len(x) and cells.n.max() <= topk_search.CELL
    s, bounds = topk_search.scores(x[:40], x), cells.bounds(d[:40], norm[:40])
    for c in range(len(cells.n)):
        assert (s[:, cells.first[c] : cells.first[c] + cells.n[c]] <= bounds[:, [c]]).all()
    best = topk_search.Best(5, np.full(40, topk_search.LOWEST))
    pairs = topk_search.expand(x[:40], norm[:40], d[:40], best, cells, x, np.arange(len(x)), np.arange(40))
    assert pairs < 40 * len(x) / 2


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_conversation_repair", "op13_exact_topk"])
def test_query_equals_sql(spark, name):
    from designlens.llm.queries import QUERIES

    sf_dir, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel, df = con.sql(ORACLES[name]), QUERIES[name](spark, sf_dir)
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


# --- main texts

PROSE = [f"<p>This is paragraph {i} of an article with a good deal of plain text in it, so that it is content.</p>" for i in range(4)]
STAYS = [
    ('<h2 id="related-work">Related work</h2>', "Related work"), ('<p class="market-share">Market share was large.</p>', "Market share was large."), ('<p class="byline">By Somebody</p>', "By Somebody"),
    ('<section id="social"><p>Social matters are treated here at some length, with words enough to be content.</p></section>', "Social matters are treated here at some length, with words enough to be content."),
    ('<table class="toolbar-x"><tr><td>One</td><td>Two</td></tr></table>', "One Two"), ("<p>Sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> ends.</p>", "Sum x+1 ends."),
    ("<ol>" + "".join(f'<li><a href="{i}">A. Writer, Of the {i} things, 19{i}0</a></li>' for i in range(1, 5)) + "</ol>", " ".join(f"A. Writer, Of the {i} things, 19{i}0" for i in range(1, 5))),
]
GOES = [
    '<div class="ad"><a href="x">Buy now</a></div>', '<div class="share-buttons"><a>Tweet</a> <a>Post</a></div>', '<ul class="menu"><li><a>Home</a></li><li><a>About</a></li></ul>', "<nav><a>Next</a></nav>",
    "<aside><p>Aside of some words, which are many enough to look like content of the page.</p></aside>", "<form><label>Mail</label><input></form>", "<script>var x = 1;</script>", "<style>p {}</style>",
    '<div class="newsletter"><p>Subscribe to our letter, which comes each week with many good words in it.</p></div>', '<section class="comments"><p>Great article, a long comment with plain text in it for sure.</p></section>',
]
TEMPLATES = [
    "<html><body><nav><a>Home</a></nav><article>{}</article><footer>Imprint</footer></body></html>",
    "<html><body><div class='top menu'><a>A</a><a>B</a></div><div class='page'><main><section>{}</section></main><aside>Side</aside></div></body></html>",
    "<html><body><header><h1>Site</h1></header><div id='wrap'><div><article><div class='body'>{}</div></article></div></div><div class='cookie-notice'>We use cookies</div></body></html>",
]


def test_main_texts_of_three_templates():
    """Headings, tables, notes and lists of an article stay whatever their class; menus, adverts and frames go."""
    from designlens.llm.html_text import main_text

    words = lambda blocks: " ".join(re.sub("<[^>]*>", "", b) for b in blocks)
    for template in TEMPLATES:
        for block, text in STAYS:
            assert main_text(template.format("".join([*PROSE, block, *PROSE]))) == f"{words(PROSE)} {text} {words(PROSE)}", (template, block)
        for block in GOES:
            assert main_text(template.format("".join([*PROSE, block, *PROSE]))) == f"{words(PROSE)} {words(PROSE)}", (template, block)


def test_deeply_nested_pages_take_linear_time():
    import time

    from designlens.llm.html_text import main_text

    def seconds(n):
        began = time.perf_counter()
        assert main_text("<article>" + "<div>" * n + "deep" + "</div>" * n + "</article>") == "deep"
        return time.perf_counter() - began

    assert seconds(80_000) < 12 * max(seconds(20_000), 0.05)
