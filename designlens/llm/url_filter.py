"""URL filter: stated rules first, then a ratio of two character language models.

Rules name a host (with all its subdomains) and a start of the path; the longest
fitting rule decides. Other addresses are judged by two variable-order Markov
models over the characters of host and path, one of accepted and one of rejected
addresses: the probability of a character after its last ``k`` characters is
smoothed towards the one after ``k - 1`` (Witten-Bell), down to single
characters. An address is blocked if the log-likelihood difference per character
exceeds a bound that is calibrated on held-out accepted ones: at most
``FALSE_BLOCKS`` of them lie above it.

Labels are the verdicts of the rules on the addresses that they cover, and those
of further labelled addresses (``examples``), where given: so the models carry
the stated decisions over to addresses that no rule covers. One labelled address
in ``HELD_OUT``, by a hash, is kept out of the counts and used for the bound;
``held_out_error`` reports the models' errors there.

Counts are exact and grow with the input. A character with the ``ORDER`` before
it is a gram; the grouped table of grams holds the counts of all shorter contexts
as its sums. From single characters up, each distinct context with its character
gets its two probabilities from those sums and a join with the level before, and
the grams of each distinct address are joined to the last level and added up.
All of it is DataFrame functions; nothing of it is collected but two sums of
each class and the histogram for the bound. The joins name their kind: Spark takes
a table for as large as its compressed file, also after ``explode``, and would
broadcast the grams of all addresses through the driver.

Defined results: a null address or one without "://" has empty host and path,
fits no rule, has difference 0 and is allowed. Without examples of both classes
the difference is 0 for every address. Of rules of equal length that fit, the
later one by host and path decides, block before allow for the same host and
path. Rows are judged one by one, so repeated rows and null keys get results of
their own; addresses of any length are scored whole; an empty table gives an
empty one. Only the key and the address are read, so further columns and their
names have no effect.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from designlens.llm.quality import let
from designlens.shared import materialize

# The rules (verdict, host, path) of the query.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

ORDER, FALSE_BLOCKS, HELD_OUT = 4, 0.01, 5
#: Probability of each character alike, below single characters.
EVEN = 1 / 256
#: Steps of the calibration histogram, in nats per character.
STEP = 0.01
CLASSES = ("accepted", "rejected")


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of the address in column ``url``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, text.substr(at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host: str, path: str, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2], r[0])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, say).otherwise(verdict)
    return name, verdict


def grams(address: Column) -> Column:
    """Each character of an address and its end, with the ``ORDER`` characters before it."""
    marked = F.concat(F.lit("\x02" * ORDER), address, F.lit("\x03"))
    chars = F.filter(F.split(marked, ""), lambda c: c != "")
    return let(chars, lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - ORDER), lambda i: F.array_join(F.slice(x, i, ORDER + 1), "")))


def gram_ratios(addresses: DataFrame) -> DataFrame:
    """gram and ratio (log-likelihood, rejected less accepted) of every gram of ``addresses`` (address, class; null class: not counted)."""
    counted = addresses.groupBy("address").agg(*[F.count_if(F.col("class") == c).alias(c) for c in CLASSES])
    table = counted.select(*CLASSES, F.explode(grams(F.col("address"))).alias("gram")).groupBy("gram").agg(*[F.sum(c).alias(c) for c in CLASSES])
    table = materialize(table, "url-grams")
    tail = lambda k: F.substring("gram", ORDER + 1 - k, k + 1)  # noqa: E731  (the character after k others)
    sums = lambda df: [F.sum(c).alias(c) for c in CLASSES]
    kinds = [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in CLASSES]
    pairs = [materialize(table.groupBy(tail(k).alias("pair")).agg(*sums(table)), "url-pairs") if k < ORDER else table.withColumnRenamed("gram", "pair") for k in range(ORDER + 1)]
    total = pairs[0].agg(*sums(None), *kinds).first()
    out = None  # the probabilities of the pairs of the level before
    for k in range(ORDER + 1):
        level = pairs[k].select("pair", *[F.col(c).alias(f"n_{c}") for c in CLASSES])
        if k:
            # counts of the k characters before, and how many different characters follow them
            context = Window.partitionBy(F.substring("pair", 1, k))
            level = level.withColumns({f"c_{c}": F.sum(f"n_{c}").over(context) for c in CLASSES} | {f"t_{c}": F.count_if(F.col(f"n_{c}") > 0).over(context) for c in CLASSES})
            level = level.withColumn("shorter", F.substring("pair", 2, k)).join(out.hint("merge"), "shorter")
        else:
            level = level.withColumns({f"c_{c}": F.lit(total[c] or 0) for c in CLASSES} | {f"t_{c}": F.lit(total[f"{c}_kinds"] or 0) for c in CLASSES} | {f"p_{c}": F.lit(EVEN) for c in CLASSES})
        smooth = {f"p_{c}": F.when(F.col(f"c_{c}") > 0, (F.col(f"n_{c}") + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"c_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"p_{c}")) for c in CLASSES}
        out = level.withColumns(smooth).select(F.col("pair").alias("shorter"), *[f"p_{c}" for c in CLASSES])
    return out.select(F.col("shorter").alias("gram"), (F.ln("p_rejected") - F.ln("p_accepted")).alias("ratio"))


def scored_addresses(labelled: DataFrame) -> DataFrame:
    """address, class, held_out and ratio per character of each distinct address of ``labelled`` (address, class)."""
    # an address with both labels says nothing
    one = F.when(F.count_distinct("class") == 1, F.max("class"))
    distinct = materialize(labelled.where("address <> ''").groupBy("address").agg(one.alias("class")).withColumn("held_out", F.pmod(F.xxhash64("address"), F.lit(HELD_OUT)) == 0), "url-addresses")
    ratios = gram_ratios(distinct.select("address", F.when(~F.col("held_out"), F.col("class")).alias("class")))
    each = distinct.select("address", F.explode(grams(F.col("address"))).alias("gram")).join(ratios.hint("shuffle_hash"), "gram")
    summed = each.groupBy("address").agg((F.sum("ratio") / F.count("*")).alias("ratio"))
    return materialize(distinct.join(summed.hint("merge"), "address"), "url-scores")


def calibrated_bound(scores: DataFrame) -> float | None:
    """The least difference, at steps of ``STEP`` and 0 at least, that at most ``FALSE_BLOCKS`` of held-out accepted addresses exceed; None without both classes."""
    steps = scores.where("class is not null").groupBy("class", "held_out", F.floor(F.col("ratio") / STEP).alias("step")).agg(F.count("*").alias("n")).toPandas()
    if set(steps.loc[~steps["held_out"], "class"]) != set(CLASSES):
        return None
    # a table with too few labels for held-out ones takes those of the models
    held = steps[(steps["class"] == "accepted") & steps["held_out"]]
    own = (held if len(held) else steps[steps["class"] == "accepted"]).groupby("step")["n"].sum().sort_index()
    above = own.sum() - own.cumsum()
    return max(0.0, STEP * (float(own.index[above <= FALSE_BLOCKS * own.sum()][0]) + 1))


def _base(pages: DataFrame, rules: list[tuple[str, str, str]], url: str, key: str) -> DataFrame:
    host, path = host_and_path(url)
    base = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns("host", "path", rules)
    return base.withColumns({"rule": rule, "said": verdict, "address": F.concat("host", "path")})


def _labelled(base: DataFrame, examples: DataFrame | None) -> DataFrame:
    labelled = base.select("address", F.when(F.col("said") == "block", "rejected").when(F.col("said") == "allow", "accepted").alias("class"))
    if examples is not None:
        host, path = host_and_path("url")
        labelled = labelled.union(examples.select(F.concat(host, path), F.when(F.col("accepted"), "accepted").when(~F.col("accepted"), "rejected")))
    return labelled


def held_out_error(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, examples: DataFrame | None = None, url: str = "url") -> DataFrame:
    """class, n and blocked: distinct held-out labelled addresses, and how many of them the models alone would block."""
    scores = scored_addresses(_labelled(_base(pages, rules, url, url), examples))
    bound = calibrated_bound(scores)
    return scores.where("held_out and class is not null").groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("ratio") > (np.inf if bound is None else bound)).alias("blocked"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, examples: DataFrame | None = None, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, ratio of each row of ``pages``; ``examples`` (url, accepted) are labelled addresses besides those of the rules."""
    base = _base(pages, rules, url, key)
    scores = scored_addresses(_labelled(base, examples))
    bound = calibrated_bound(scores)
    ratio = F.lit(0.0) if bound is None else F.coalesce("ratio", F.lit(0.0))
    out = base.join(scores.select("address", "ratio").hint("merge"), "address", "left").withColumn("ratio", ratio)
    judged = F.coalesce("said", F.when(F.col("ratio") > float(bound or 0.0), "block").otherwise("allow"))
    return out.select(key, "host", "path", "rule", judged.alias("verdict"), "ratio")
