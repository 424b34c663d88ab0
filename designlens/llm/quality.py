"""Quality rules over documents, with DataFrame and SQL functions only.

A rule is a condition on the measures of a text (``Measures``) under which the
document fails. ``ordered_rules`` measures a sample of at most ``SAMPLE`` rows
and takes from it each rule's selectivity (the rows that fail it) and its cost:
the characters, words, lines and comparisons that its measures go through
(``WORK``), counted for each sampled row. Rules are then put in order one by one:
next comes the rule that rejects most per cost, both among the sampled rows that
the rules before it leave, so rules that reject the same rows do not count twice
and a rule is not charged for long texts that are gone. Costs come from
counts, not from a clock, so the order of a table is the same in each run.

``failed_rule`` applies the rules as a short-circuit cascade: one CASE whose
later branches, with the measures that only they use, are not evaluated once a
rule has failed. The words of a text are split once, as a variable of a lambda.
The order changes the work, never the verdict.

Defined results: null text counts as the empty text, which has no words and
fails the rule on the number of words. Rows are judged one by one, so repeated
rows get equal results, and of rules that fail together the first in order is
named. Texts of any length are measured whole. An empty table gives an empty
one. ``judged`` puts its own columns after those of the input and leaves out
input columns of the same names; ``filter_quality`` returns the input's columns,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are measured for the order of the rules, and one row in how many is taken, from the first partitions that hold enough.
SAMPLE, SAMPLE_SHARE = 2_000, 0.1
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once: as the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first ones included.

    The windows are sorted with their places, so equal ones are neighbours; the
    places of those are spread to the three words of each window.
    """
    n = F.size(words) - 2
    windows = F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"), F.sequence(F.lit(0), n - 1).alias("i"))

    def twice(s: Column) -> Column:
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))

    repeated = let(F.sort_array(windows), twice)
    places = F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.when(n >= 2, F.size(F.array_distinct(places))).otherwise(0).cast("long")


class Measures:
    """Counts over a whole text, as expressions of the text and of its words."""

    def __init__(self, text: Column, words: Column):
        self.text, self.words = text, words
        self.lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        self.n_words = F.size(words).cast("long")
        self.word_chars = F.length(F.array_join(words, "")).cast("long")
        self.n_symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
        self.n_repeat_words = repeat_words(words)
        self.n_shouts = F.regexp_count(text, F.lit("!!")).cast("long")
        self.n_capitals = F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long")

    @staticmethod
    def dup_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Name, the condition under which a document fails, and what it measures. Base rules first.
Rule = tuple[Callable[[Measures], Column], tuple[str, ...]]
BASE_RULES: dict[str, Rule] = {
    "few_words": (lambda m: m.n_words < 50, ("n_words",)),
    "repeated_words": (lambda m: 100 * m.n_repeat_words > 50 * m.n_words, ("n_repeat_words",)),
}
RULES: dict[str, Rule] = BASE_RULES | {
    "symbols": (lambda m: 10 * m.n_symbols > m.n_words, ("n_symbols",)),
    "word_length": (lambda m: let(m.word_chars, lambda c: (c < 2 * m.n_words) | (c > 15 * m.n_words)), ("word_chars",)),
    "repeated_lines": (lambda m: let(m.lines, lambda x: 100 * Measures.dup_lines(x) > 50 * F.size(x)), ("lines",)),
    "shouting": (lambda m: 10 * m.n_shouts > m.n_words, ("n_shouts",)),
    "capitals": (lambda m: 10 * m.n_capitals > 3 * m.word_chars, ("n_capitals", "word_chars")),
}
#: What a measure goes through in a text with such counts: characters, words, lines, comparisons of the sort.
WORK: dict[str, Callable[[dict], float]] = {
    "n_words": lambda r: 1,
    "word_chars": lambda r: r["_words"] + r["_word_chars"],
    "n_symbols": lambda r: r["_chars"],
    "n_repeat_words": lambda r: 3 * r["_words"] * (1 + math.log2(r["_words"] + 1)),
    "lines": lambda r: r["_chars"] + r["_lines"],
    "n_shouts": lambda r: r["_chars"],
    "n_capitals": lambda r: r["_chars"],
}


def greedy_order(costs: list[dict[str, float]], failed: list[dict[str, bool]]) -> list[str]:
    """Names of the rules that ``costs`` and ``failed`` tell of for each row: most rejections per cost next, among the rows left; by cost, then name where they are equal."""
    left, order, rest = list(zip(costs, failed)), [], set(costs[0])
    while rest:

        def key(name: str) -> tuple[float, float, str]:
            cost = 1 + sum(c[name] for c, _ in left)
            return -sum(f[name] for _, f in left) / cost, cost, name

        order.append(min(rest, key=key))
        rest.remove(order[-1])
        left = [x for x in left if not x[1][order[-1]]]
    return order


def ordered_rules(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text") -> list[str]:
    """Names of ``rules``, the most rejecting per cost first, by a sample.

    Only verdicts and sizes of at most ``SAMPLE`` rows reach the driver, and only as many partitions are read as hold them.
    """
    t = F.coalesce(F.col("t"), F.lit(""))
    seen = docs.select(F.col(text).cast("string").alias("t")).sample(SAMPLE_SHARE, 7)
    m = Measures(t, words_of(t))
    facts = [F.length(t).alias("_chars"), m.n_words.alias("_words"), F.size(m.lines).alias("_lines"), m.word_chars.alias("_word_chars")]
    rows = [r.asDict() for r in seen.select(*facts, *[rule(m).alias(name) for name, (rule, _) in rules.items()]).take(SAMPLE)]
    costs = [{name: sum(WORK[m](r) for m in needs) for name, (_, needs) in rules.items()} for r in rows]
    return greedy_order(costs, rows) if rows else list(rules)


def cascade(order: list[str], rules: dict[str, Rule], measures: Measures) -> Column:
    """The first rule that fails, in the given order; null for a document that passes all."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(rules[name][0](measures), name).otherwise(out)
    return out


def failed_rule(text: Column, order: list[str], rules: dict[str, Rule] = RULES) -> Column:
    """The first rule that the text fails, evaluated lazily over words that are split once."""
    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(words_of(t), lambda w: cascade(order, rules, Measures(t, w))))


def judged(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``MEASURES``, ``failed_rule``, ``base_failed`` and ``kept``."""
    order = ordered_rules(docs, rules, text)
    own = [c for c in docs.columns if c not in {*MEASURES, "failed_rule", "base_failed", "kept"}]

    def facts(t: Column, w: Column) -> Column:
        m = Measures(t, w)
        base = F.struct(m.n_words.alias("n_words"), m.n_repeat_words.alias("n_repeat_words"))

        def verdict(b: Column) -> Column:
            known = Measures(t, w)
            known.n_words, known.n_repeat_words = b["n_words"], b["n_repeat_words"]
            failed = known.n_words < 0
            for rule, _ in BASE_RULES.values():
                failed = failed | rule(known)
            return F.struct(b["n_words"].alias("n_words"), m.word_chars.alias("word_chars"), m.n_symbols.alias("n_symbols"), let(m.lines, Measures.dup_lines).alias("n_dup_lines"), b["n_repeat_words"].alias("n_repeat_words"), cascade(order, rules, known).alias("failed_rule"), failed.alias("base_failed"))

        return let(base, verdict)

    found = let(F.coalesce(F.col(text).cast("string"), F.lit("")), lambda t: let(words_of(t), lambda w: facts(t, w)))
    rows = docs.select(*[F.col(f"`{c}`") for c in own], found.alias("_found")).select(*[F.col(f"`{c}`") for c in own], "_found.*")
    return rows.withColumn("kept", F.col("failed_rule").isNull() & ~F.col("base_failed"))


def filter_quality(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass all rules, with their own columns."""
    return docs.where(failed_rule(F.col(text), ordered_rules(docs, rules, text), rules).isNull())
