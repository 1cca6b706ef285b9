"""Quality rules as a learned decision list, in DataFrame functions only.

`statistics` computes text statistics of every document by column expressions.
`learn` grows an ordered list of rejecting rules from labelled statistics by
sequential covering: a rule starts empty and takes, one at a time, the threshold
condition with the best information gain over the growing rows still uncovered;
its last conditions are then dropped as long as that does not lower its worth on
the pruning rows. A rule that is precise enough there is kept, the rows it covers
leave, and the next rule is grown. `verdict` turns the list into one ordered
conditional expression; a document that no rule covers is kept.

Every count behind a decision is a Spark aggregate over the labelled sample, of
which about `FIT_ROWS` rows (chosen by a hash of doc_id) are used at most.

Null and empty texts have no words and zero statistics. Labels with a null are
ignored; of several labels of one document the lowest counts. With no labelled
rows of both kinds the list is empty. Repeated rows are judged each. Other
columns pass through `judge`; on a clash the statistics' names win.
"""

from __future__ import annotations

from math import log2
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfeed.functions.rows import bind
from factfeed.session import materialize

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
FIT_ROWS = 20_000
BINS = 24  # candidate thresholds per statistic
MOST_RULES, MOST_CONDITIONS = 8, 3
PRECISION = 0.95  # of a rule, on the pruning rows
LEAST = 3  # rows to reject that a rule must cover there

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# statistics the rules may test; shares are per word or per character
SHARES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
}


class Condition(NamedTuple):
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.name) > self.threshold if self.above else F.col(self.name) <= self.threshold


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """The input's columns, the five counts of BASE and the shares of SHARES."""
    made = {*BASE, *SHARES, "n_distinct_words", "n_upper", "n_digits"}
    kept = [c for c in docs.columns if c not in made and not c.startswith("_q_")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_q_text"))
    text, words, hashes, order = F.col("_q_text"), F.col("_q_words"), F.col("_q_hashes"), F.col("_q_order")
    out = bind(out, "_q_words", F.array_remove(F.split(text, SPACE), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACES) > 0)
    out = bind(out, "_q_lines", lines)
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    out = bind(out, "_q_hashes", F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)])))
    # only texts with a repeated window need to know where it is
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = bind(out, "_q_order", F.when(repeated, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.filter(
        order,
        lambda x, k: (F.get(order, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(order, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])),
    )
    out = bind(out, "_q_places", F.array_sort(F.transform(again, lambda x: x["i"])))
    places = F.col("_q_places")
    covered = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
    counts = {
        "n_words": n,
        "word_chars": _without(text, SPACES),
        "n_symbols": F.length(text) - _without(text, SYMBOLS),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, x: a + x),
        "n_distinct_words": F.size(F.array_distinct(words)),
        "n_upper": F.length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": F.length(text) - _without(text, "0123456789"),
    }
    out = out.select(*kept, *[c.cast("long").alias(k) for k, c in counts.items()])
    shares = {k: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0) for k, (a, b) in SHARES.items()}
    return out.withColumns(shares)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rejecting rules, in order, from documents with a label (1: good)."""
    names = [*SHARES, "n_words"]
    own = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    n = own.count()
    if not n:
        return []
    part = int(min(1.0, FIT_ROWS / n) * 1_000_000)
    sample = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    # about FIT_ROWS rows of two numbers, whatever the tables' sizes
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = statistics(chosen).where(~base_failed()).select(
        (F.col("_label") == 0).cast("int").alias("reject"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("pruning"), *names
    )
    rows = materialize(rows, "quality-fit")
    cuts = _cuts(rows, names)
    rules: list[list[Condition]] = []
    left = rows
    while len(rules) < MOST_RULES and cuts:
        rule = _grown(left.where(~F.col("pruning")), names, cuts)
        rule = _pruned(left.where("pruning"), rule)
        if not rule:
            break
        rules.append(rule)
        left = left.where(~_all(rule))
    return rules


def _all(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _cuts(rows: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """Thresholds: halfway between neighbouring quantiles of the rows to reject
    and of the others, so that a rule keeps its distance from either."""
    quantiles = [(i + 0.5) / BINS for i in range(BINS)]
    found = rows.groupBy("reject").agg(*[F.percentile_approx(n, quantiles, 2000).alias(n) for n in names]).collect()
    if len(found) < 2:
        return {}
    values = {n: sorted({float(v) for r in found for v in r[n]}) for n in names}
    return {n: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] or v for n, v in values.items()}


def _cuts_below(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda cut: value > cut))


def _grown(rows: DataFrame, names: list[str], cuts: dict[str, list[float]]) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MOST_CONDITIONS:
        # number of cuts below the value: one small histogram for each statistic
        place = [F.struct(F.lit(n).alias("name"), _cuts_below(F.col(n), cuts[n]).alias("bin")) for n in names]
        counted = rows.where(_all(rule)).select("reject", F.explode(F.array(*place)).alias("at")).groupBy("at.name", "at.bin")
        found = counted.agg(F.sum("reject").alias("p"), F.count("*").alias("n")).collect()
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in found:
            by.setdefault(r["name"], {})[r["bin"]] = (r["p"], r["n"] - r["p"])
        if not by:
            break
        first = next(iter(by.values()))
        p0, n0 = sum(x[0] for x in first.values()), sum(x[1] for x in first.values())
        if not p0 or not n0:
            break
        best, worth = None, 1e-9
        for name, bins in sorted(by.items()):
            p_low = n_low = 0
            for i, cut in enumerate(cuts[name]):  # bin <= i: value <= cut
                p_low += bins.get(i, (0, 0))[0]
                n_low += bins.get(i, (0, 0))[1]
                for above, p, neg in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                    gain = p * (log2(p / (p + neg)) - log2(p0 / (p0 + n0))) if p else 0.0
                    if gain > worth:
                        best, worth = Condition(name, above, cut), gain
        if best is None:
            break
        rule.append(best)
    return rule


def _pruned(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The prefix of the rule with the best worth on these rows, if precise enough."""
    if not rule:
        return []
    heads = [rule[: i + 1] for i in range(len(rule))]
    sums = []
    for i, head in enumerate(heads):
        sums += [F.sum(F.when(_all(head), F.col("reject"))).alias(f"p{i}"), F.sum(F.when(_all(head), 1)).alias(f"n{i}")]
    got = rows.agg(*sums).first()
    best: tuple[float, int] | None = None
    for i in range(len(heads)):
        p, n = got[f"p{i}"] or 0, got[f"n{i}"] or 0
        if p >= LEAST and p >= PRECISION * n:
            worth = (2 * p - n) / n
            if best is None or worth > best[0] or worth == best[0] and p > (got[f"p{best[1]}"] or 0):
                best = (worth, i)
    return heads[best[1]] if best else []


def verdict(rules: list[list[Condition]]) -> Column:
    """One ordered conditional expression: kept or not."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(_all(rule), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = learn(docs, labels)
    return statistics(docs).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})
