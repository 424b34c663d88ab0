"""Repair of damaged conversations: the cheapest edits that give a system turn, then user and assistant in turn.

A conversation's edits are a path through a small graph, whose nodes are
(rows read, state of the pattern). A path's weight is one integer: its cost in
the high digits, then a fixed number of digits of ``DIGIT`` bits, one for each
letter of its audit from the left and zeros after its end, then the number of
letters. The least integer is therefore the cheapest path and, of those, the
one whose audit is least in ASCII.

Conversations of bounded size are read as a sorted stream. Longer ones are
cut into chunks: a chunk's weights between any two states are found by
themselves, and neighbours are joined a few at a time until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from designlens.llm.columns import arrow_map
from designlens.llm.places import placed
from designlens.shared import materialize

#: A conversation of more rows or bytes of text than these is repaired in chunks.
LONG_ROWS, LONG_BYTES = 1024, 4 << 20
#: Rows of a chunk, and chunks that are joined at once.
CHUNK, JOINED = 256, 16

#: States of the pattern ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or an assistant turn may follow, and where it leads.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "\0DIKR"
DIGIT = 3
COUNT_BITS = 40
LEGAL = {"su", "ua", "au"}
#: Costs: delete, insert, give another role, and any undeleted truncated row.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SPACES = " \t\n\v\f\r"

DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "conv_id bigint, place bigint, edit string, role string, text string"


class Weights:
    """Integer weights of paths with at most ``letters`` letters."""

    def __init__(self, letters: int):
        self.letters, self.high = letters, DIGIT * letters + COUNT_BITS

    def step(self, weight: int, cost: int, letter: str) -> int:
        place = weight & ((1 << COUNT_BITS) - 1)
        return weight + (cost << self.high) + (LETTERS.index(letter) << (DIGIT * (self.letters - 1 - place) + COUNT_BITS)) + 1

    def of(self, cost: int, audit: str) -> int:
        digits = int(audit.translate({ord(x): str(i) for i, x in enumerate(LETTERS)}), 1 << DIGIT) if audit else 0
        return (cost << self.high) + (digits << (DIGIT * (self.letters - len(audit)) + COUNT_BITS)) + len(audit)

    def read(self, weight: int) -> tuple[int, str]:
        n = weight & ((1 << COUNT_BITS) - 1)
        digits = (weight >> COUNT_BITS) & ((1 << (DIGIT * self.letters)) - 1)
        octal = f"{digits:0{self.letters}o}" if self.letters else ""
        return weight >> self.high, octal[:n].translate({ord(str(i)): x for i, x in enumerate(LETTERS)})


def least(*weights: int | None) -> int | None:
    return min((w for w in weights if w is not None), default=None)


def best_paths(rows: list[tuple[str, bool, bool]], start: int) -> list[tuple[int, str] | None]:
    """Cost and audit of the least path from ``start`` to each state over ``rows`` (role initial, must go, truncated)."""
    ways = Weights(3 * len(rows) + 2)
    step = ways.step

    def inserted(w):
        w = list(w)
        w[USER] = least(w[USER], *[step(w[s], INSERT, "I") for s in (START, SYSTEM, ASSISTANT) if w[s] is not None])
        if w[USER] is not None:
            w[ASSISTANT] = least(w[ASSISTANT], step(w[USER], INSERT, "I"))
        return w

    w = [0 if s == start else None for s in range(4)]
    for initial, gone, truncated in rows:
        w = inserted(w)
        after = [None if x is None else step(x, DELETE, "D") for x in w]
        if not gone:
            extra = TRUNCATED * truncated
            if initial == "s" and w[START] is not None:
                after[SYSTEM] = least(after[SYSTEM], step(w[START], extra, "K"))
            for s, x in enumerate(w):
                if x is not None:
                    t = NEXT[s]
                    keeps = initial == ROLE[t][0]
                    after[t] = least(after[t], step(x, extra, "K") if keeps else step(x, extra + REROLE, "R"))
        w = after
    return [None if x is None else ways.read(x) for x in inserted(w)]


def joined(a: list, b: list) -> list:
    """The best paths over two neighbours; entry [s][t] of each leads from s to t."""
    out = []
    for row in a:
        ends = []
        for t in range(4):
            both = [(x[0] + y[t][0], x[1] + y[t][1]) for x, y in zip(row, b) if x is not None and y[t] is not None]
            ways = Weights(max((len(audit) for _, audit in both), default=0))
            ends.append(ways.read(min(ways.of(*x) for x in both)) if both else None)
        out.append(ends)
    return out


def chosen(from_start: list) -> tuple[int, str]:
    """The better of no turn at all and a pattern that ends with an assistant."""
    ways = Weights(max(len(x[1]) for x in (from_start[START], from_start[ASSISTANT]) if x is not None))
    return ways.read(least(*[ways.of(*x) for x in (from_start[START], from_start[ASSISTANT]) if x is not None]))


def is_blank(text: str) -> bool:
    return not text.strip(SPACES)


def is_truncated(text: str) -> bool:
    return text.rstrip(SPACES)[-1:] not in (".", "!", "?")


def faults(rows: list[tuple[str, str]]) -> list[str | None]:
    """The first fault of each (role, text): blank, duplicate, truncated or none."""
    seen, out = set(), []
    for row in rows:
        out.append("blank" if is_blank(row[1]) else "duplicate" if row in seen else "truncated" if is_truncated(row[1]) else None)
        seen.add(row)
    return out


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn that an audit leaves or makes."""
    state, rows = START, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K" and role[0] == "s":
            state = SYSTEM
        else:
            state = NEXT[state]
            role = role if letter == "K" else ROLE[state]
        yield letter, role, text


def text_digest(turns: Iterator[tuple[str, str, str]]) -> str:
    """Hash of ``role:text``, newline-joined, as a stream."""
    h, first = hashlib.sha256(), True
    for _, role, text in turns:
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return h.hexdigest()


def facts(turns: list[int | None], initials: list[str], found: list[str | None]) -> dict:
    """What a run of rows says about itself, such that neighbours can be added up."""
    known = [t for t in turns if t is not None]
    return {
        "lo": min(known, default=None), "hi": max(known, default=None), "first": known[0] if known else None, "last": known[-1] if known else None, "turns": len(set(known)),
        "head": initials[0], "tail": initials[-1], "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
    }


def added(a: dict, b: dict) -> dict:
    """Facts of two neighbouring runs, in order of their turns."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}
    out["turns"] = a["turns"] + b["turns"] - (a["last"] is not None and a["last"] == b["first"])
    out["illegal"] = a["illegal"] + b["illegal"] + (a["tail"] + b["head"] not in LEGAL)
    out |= {"lo": a["lo"] if a["lo"] is not None else b["lo"], "hi": b["hi"] if b["hi"] is not None else a["hi"]}
    out |= {"first": a["first"] if a["first"] is not None else b["first"], "last": b["last"] if b["last"] is not None else a["last"]}
    return out | {"head": a["head"], "tail": b["tail"]}


def gaps(f: dict) -> int:
    return 0 if f["lo"] is None else f["hi"] - f["lo"] + 1 - f["turns"]


# --- damage


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0 dropped, 2 repeated) after damage that conv_id and turn determine.

    A null role or text becomes one space, and a null in the key counts as one.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


# --- conversations of bounded size


def _stream(batches) -> Iterator[tuple[int | None, list[tuple[int | None, str, str]]]]:
    """conv_id and its rows (turn, role, text), copies written out, of a sorted stream."""
    def rows():
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")])

    for conv, members in groupby(rows(), key=lambda r: r[0]):
        yield conv, [r[1:4] for r in members for _ in range(r[4])]


def solved(rows: list[tuple[int | None, str, str]]) -> tuple[dict | None, int, str]:
    """Facts, cost and audit of one conversation; a conversation without rows costs nothing."""
    if not rows:
        return None, 0, ""
    found, initials = faults([r[1:] for r in rows]), [r[1][:1] for r in rows]
    known = facts([r[0] for r in rows], initials, found)
    paths = best_paths([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, found)], START)
    return known, *chosen(paths)


def _record(conv: int | None, known: dict | None, cost: int, audit: str, sha: str) -> tuple:
    counts = (0,) * 5 if known is None else (gaps(known), known["blank"], known["duplicate"], known["truncated"], known["illegal"])
    return (conv, *counts, cost, audit, sha)


_DIGEST_TYPES = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_TURN_TYPES = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _batches(rows: Iterator[tuple], types: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), types)], schema=types)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), types)], schema=types)


def _short_digest(batches):
    def rows():
        for conv, turns in _stream(batches):
            known, cost, audit = solved(turns)
            yield _record(conv, known, cost, audit, text_digest(edited(audit, (r[1:] for r in turns))))

    return _batches(rows(), _DIGEST_TYPES)


def _short_turns(batches):
    def rows():
        for conv, turns in _stream(batches):
            for place, turn in enumerate(edited(solved(turns)[2], (r[1:] for r in turns))):
                yield (conv, place, *turn)

    return _batches(rows(), _TURN_TYPES)


# --- longer conversations

_FACTS = "struct<lo: bigint, hi: bigint, first: bigint, last: bigint, turns: bigint, head: string, tail: string, illegal: bigint, blank: bigint, duplicate: bigint, truncated: bigint>"
_WAYS = "array<struct<cost: bigint, audit: string>>"  # sixteen entries, from state by to state
_CHUNKS = f"conv string, chunk bigint, facts {_FACTS}, ways {_WAYS}"
_FACT_TYPES = pa.struct([(c, pa.string() if c in ("head", "tail") else pa.int64()) for c in ("lo", "hi", "first", "last", "turns", "head", "tail", "illegal", "blank", "duplicate", "truncated")])
_CHUNK_TYPES = pa.schema([("conv", pa.string()), ("chunk", pa.int64()), ("facts", _FACT_TYPES), ("ways", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))])


def _packed(matrix: list) -> list:
    return [None if x is None else {"cost": x[0], "audit": x[1]} for row in matrix for x in row]


def _unpacked(ways: list) -> list:
    flat = [None if x is None else (x["cost"], x["audit"]) for x in ways]
    return [flat[i : i + 4] for i in range(0, 16, 4)]


def _solve_chunks(batches):
    def rows():
        for batch in batches:
            for conv, chunk, members in zip(*[batch.column(c).to_pylist() for c in ("conv", "chunk", "rows")]):
                members.sort(key=lambda m: m["place"])
                found = ["blank" if m["blank"] else "duplicate" if m["again"] else "truncated" if m["cut"] else None for m in members]
                initials = [m["initial"] for m in members]
                steps = [(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, found)]
                yield conv, chunk, facts([m["turn"] for m in members], initials, found), _packed([best_paths(steps, s) for s in range(4)])

    return _batches(rows(), _CHUNK_TYPES, 8)


def _join_chunks(batches):
    def rows():
        for batch in batches:
            for conv, chunk, members in zip(*[batch.column(c).to_pylist() for c in ("conv", "chunk", "parts")]):
                members.sort(key=lambda m: m["chunk"])
                known, matrix = members[0]["facts"], _unpacked(members[0]["ways"])
                for m in members[1:]:
                    known, matrix = added(known, m["facts"]), joined(matrix, _unpacked(m["ways"]))
                yield conv, chunk, known, _packed(matrix)

    return _batches(rows(), _CHUNK_TYPES, 1)


def _finish(batches):
    """conv, facts, cost and audit from the ways of whole conversations."""
    types = pa.schema([("conv", pa.string()), ("facts", _FACT_TYPES), ("cost", pa.int64()), ("audit", pa.string())])

    def rows():
        for batch in batches:
            for conv, known, ways in zip(*[batch.column(c).to_pylist() for c in ("conv", "facts", "ways")]):
                yield (conv, known, *chosen(_unpacked(ways)[START]))

    return _batches(rows(), types, 8)


def _audited_stream(batches) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """The first row of each conversation (its facts, cost, audit) and the stream of the others."""
    def rows():
        for batch in batches:
            yield from batch.to_pylist()

    for _, members in groupby(rows(), key=lambda r: r["conv"]):
        yield next(members), ((m["role"], m["text"]) for m in members)


def _long_digest(batches):
    def rows():
        for head, turns in _audited_stream(batches):
            yield _record(head["conv_id"], head["facts"], head["cost"], head["audit"], text_digest(edited(head["audit"], turns)))

    return _batches(rows(), _DIGEST_TYPES, 1)


def _long_turns(batches):
    def rows():
        for head, turns in _audited_stream(batches):
            for place, turn in enumerate(edited(head["audit"], turns)):
                yield (head["conv_id"], place, *turn)

    return _batches(rows(), _TURN_TYPES)


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _long(rows: DataFrame) -> DataFrame:
    """Rows of longer conversations, each after a first row with its conversation's facts, cost and audit, as a sorted stream.

    The audit of a conversation is one value, and so is the hash of its text: that last stream has one task for a
    conversation, which holds its audit and one row at a time. Everything before is dealt by chunks.
    """
    spread = rows.where("copies > 0").withColumn("conv", _key()).withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "_copy")
    turns = placed(spread, "conv", ["turn", "role", F.substring("text", 1, 32)], ["turn", "role", "text"], "repair-rows").drop("total")
    same = F.sha2("text", 256)
    body = F.rtrim("text", F.lit(SPACES))
    blank = body == ""
    narrow = turns.select("conv", "place", "turn", "role", same.alias("same"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"))
    firsts = narrow.groupBy("conv", "role", "same").agg(F.min("place").alias("_first"))
    marked = narrow.join(firsts, ["conv", "role", "same"]).withColumn("again", F.col("place") > F.col("_first"))
    members = F.collect_list(F.struct("place", "turn", "initial", "blank", "again", "cut")).alias("rows")
    chunks = marked.groupBy("conv", F.floor(F.col("place") / CHUNK).alias("chunk")).agg(members)
    parts = materialize(arrow_map(chunks, _solve_chunks, _CHUNKS), "repair-chunks")
    while parts.where(F.col("chunk") > 0).head(1):
        grouped = parts.groupBy("conv", F.floor(F.col("chunk") / JOINED).alias("chunk")).agg(F.collect_list(F.struct("chunk", "facts", "ways")).alias("parts"))
        parts = materialize(arrow_map(grouped, _join_chunks, _CHUNKS), "repair-joined")
    heads = arrow_map(parts, _finish, f"conv string, facts {_FACTS}, cost bigint, audit string")
    ids = F.when(F.col("conv") != "", F.substring("conv", 2, 30).cast("bigint")).alias("conv_id")
    stream = heads.select("conv", F.lit(-1).cast("bigint").alias("place"), ids, "facts", "cost", "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")).unionByName(
        turns.select("conv", "place", "role", "text"), allowMissingColumns=True
    )
    return stream.repartition("conv").sortWithinPartitions("conv", "place")


def _both(rows: DataFrame, short, long, schema: str, long_rows: int, long_bytes: int) -> DataFrame:
    sizes = rows.where("copies > 0").groupBy(_key().alias("conv")).agg(F.sum("copies").alias("_n"), F.sum(F.octet_length("text") * F.col("copies")).alias("_bytes"))
    large = materialize(sizes.where((F.col("_n") > long_rows) | (F.col("_bytes") > long_bytes)).select("conv"), "repair-long")
    keyed, some = rows.withColumn("conv", _key()), bool(large.head(1))
    bounded = (keyed.join(large, "conv", "left_anti") if some else keyed).repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    out = arrow_map(bounded.drop("conv"), short, schema)
    if some:
        out = out.unionByName(arrow_map(_long(keyed.join(large, "conv", "left_semi").drop("conv")), long, schema))
    return out


def repair_digest(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, copies): counts of faults, cost, audit, hash.

    Rows stand by turn (null first), equal turns by role and text. A null conv_id
    is a conversation like any other. A role without a first character fits no
    place, so its row is given another role or deleted. A conversation whose rows
    all have copies = 0 gets zeros, an empty audit and the hash of nothing.
    """
    return _both(rows, _short_digest, _long_digest, DIGEST, long_rows, long_bytes)


def repaired_turns(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired conversations: conv_id, place, edit (K, R or I), role, text of each turn that is left or made."""
    return _both(rows, _short_turns, _long_turns, TURNS, long_rows, long_bytes)

