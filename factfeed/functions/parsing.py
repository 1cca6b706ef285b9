"""Reading labels out of model text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONTEXT_PHRASES, GRADES, REFUSAL_PHRASES
from .rows import bind
from .text import strip

# fixed values: line formats of an extraction text
MARKER = r">> Sentence \d+:"
SENTENCE_LINE = r"^>> Sentence \d+:[^\n]"
STATEMENT_LINE = r"^[*-][^\n]"

OK, EMPTY, MALFORMED = "ok", "empty", "malformed"
PAIRS_TYPE = "array<struct<sentence:string,statement:string>>"


def contains_any(col: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(p)) for p in phrases])


def parse_verdict(text: Column) -> Column:
    """First of Correct, Vague, Wrong found in any case; null if unreadable.

    "Incorrect" holds "correct" and therefore reads as Correct.
    """
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit("correct")), "Correct")
        .when(F.contains(low, F.lit("vague")), "Vague")
        .when(F.contains(low, F.lit("wrong")), "Wrong")
        .when(contains_any(text, CONTEXT_PHRASES), "Vague")
    )


def parse_grade(text: Column) -> Column:
    """Lowest digit from 1 to 5 in the text; null if there is none."""
    hits = [F.when(F.contains(text, F.lit(g)), g) for g in reversed(GRADES)]
    return F.coalesce(*hits)


def is_refusal(sentence: Column, ignore_case: bool = False) -> Column:
    probe = F.lower(sentence) if ignore_case else sentence
    return contains_any(probe, REFUSAL_PHRASES) | F.endswith(sentence, F.lit("?"))


def _line_kinds(lines: Column) -> Column:
    """One letter per line.

    e empty, h sentence line, m marker further right, x statement line that
    also holds a marker, b statement line, o anything else. A marker only
    counts when a line break follows it, so never on the last line.
    """

    def kind(line: Column, i: Column) -> Column:
        closed = i < F.size(lines) - 1
        marker = closed & F.regexp_like(line, F.lit(MARKER + r"[^\n]"))
        bullet = F.regexp_like(line, F.lit(STATEMENT_LINE))
        return (
            F.when(line == "", "e")
            .when(closed & F.regexp_like(line, F.lit(SENTENCE_LINE)), "h")
            .when(bullet & marker, "x")
            .when(bullet, "b")
            .when(marker, "m")
            .otherwise("o")
        )

    return F.transform(lines, kind)


def _scan_runs(kinds: Column) -> Column:
    """Count the runs of sentence and statement lines; bounds of the first."""

    def step(s: Column, k: Column) -> Column:
        stays = s["open"] & k.isin("h", "b", "x")
        starts = ~stays & k.isin("h", "m", "x")
        first = (stays & (s["runs"] == 1)) | (starts & (s["runs"] == 0))
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(k == "e", s["open"]).otherwise(stays | starts).alias("open"),
            (s["runs"] + starts.cast("int")).alias("runs"),
            F.when(starts & (s["runs"] == 0), s["at"]).otherwise(s["start"]).alias("start"),
            F.when(first, s["at"] + 1).otherwise(s["stop"]).alias("stop"),
        )

    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(False).alias("open"),
        F.lit(0).alias("runs"),
        F.lit(0).alias("start"),
        F.lit(0).alias("stop"),
    )
    return F.aggregate(kinds, start, step)


def with_extraction(df: DataFrame, text: str = "text") -> DataFrame:
    """Add status and pairs (sentence, statement) read from extraction texts.

    Everything happens inside the row: a text is one model answer, so its
    length is bounded by the answer limit of the model.
    """
    df = bind(df, "_lines", F.split(F.col(text), "\n"))
    df = bind(df, "_run", _scan_runs(_line_kinds(F.col("_lines"))))
    lines, run = F.col("_lines"), F.col("_run")

    kept = F.filter(
        F.slice(lines, run["start"] + 1, run["stop"] - run["start"]), lambda x: x != ""
    )
    kept = F.transform(
        kept,
        lambda x, i: F.when(i == 0, F.regexp_extract(x, MARKER + r"[^\n]+", 0)).otherwise(x),
    )
    # one block per sentence line: the line itself, then its statement lines
    blocks = F.split(F.array_join(kept, "\n"), r"\n(?=>> Sentence )")

    def block(b: Column) -> Column:
        rows = F.split(b, "\n")
        names = F.filter(
            F.transform(F.split(F.get(rows, F.lit(0)), MARKER), strip), lambda x: x != ""
        )
        statements = F.transform(
            F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))),
            lambda x: strip(F.substr(x, F.lit(2))),
        )
        return F.struct(names.alias("names"), statements.alias("statements"))

    df = bind(df, "_blocks", F.when(run["runs"] == 1, F.transform(blocks, block)))
    parsed = F.col("_blocks")
    good = F.forall(parsed, lambda b: F.size(b["names"]) == 1)
    low = F.lower(F.col(text))
    none = F.contains(low, F.lit("no")) & (
        F.contains(low, F.lit("statement")) | F.contains(low, F.lit("sentence"))
    )
    status = (
        F.when((run["runs"] == 1) & good, OK)
        .when((run["runs"] == 0) & none, EMPTY)
        .otherwise(MALFORMED)
    )
    pairs = F.flatten(
        F.transform(
            parsed,
            lambda b: F.transform(
                b["statements"],
                lambda s: F.struct(F.get(b["names"], F.lit(0)).alias("sentence"), s.alias("statement")),
            ),
        )
    )
    read = F.when(status == OK, pairs).when(status == EMPTY, F.array().cast(PAIRS_TYPE))
    df = bind(df, "_read", F.struct(status.alias("status"), read.cast(PAIRS_TYPE).alias("pairs")))
    return (
        df.withColumn("status", F.col("_read.status"))
        .withColumn("pairs", F.col("_read.pairs"))
        .drop("_lines", "_run", "_blocks", "_read")
    )
