"""Question sets of several sources with one shared test split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SourceSpec
from ..operators.ordering import first_n, train_test_split
from ..operators.questions import chat_prompt, decontaminate
from ..session import materialize
from ..sources.adapters import load_questions
from ..sources.jsonl import write_jsonl


@dataclass(frozen=True)
class Source:
    rows: DataFrame
    docs: DataFrame | None
    spec: SourceSpec


def head_size(spec: SourceSpec) -> int | None:
    if spec.n_questions and spec.test_size:
        return spec.n_questions + spec.test_size
    return spec.n_questions


def select_questions(loaded: DataFrame, spec: SourceSpec) -> DataFrame:
    """First n questions, prompt column, and the chosen side of the split."""
    n = head_size(spec)
    df = first_n(loaded, n, "qid") if n else loaded
    if spec.chat_template:
        df = df.withColumn("prompt", chat_prompt(spec.chat_template, F.col("question")))
    if spec.test_size and spec.split:
        df = train_test_split(df, spec.test_size, spec.seed, spec.split)
    return df


def training_set(loaded: DataFrame, test: DataFrame, cap: int = 10_000) -> DataFrame:
    """Questions that are no test questions, the first `cap` of them.

    The ids that pass are written before the cut is looked for, so that the join
    with the test questions runs once.
    """
    passed = materialize(decontaminate(loaded.select("qid", "question"), test).select("qid"), "train-ids")
    picked = first_n(passed, cap, "qid")
    return loaded.join(picked, "qid", "left_semi").select(*loaded.columns)


def build_question_sets(
    sources: dict[str, Source], train_source: str, cap: int = 10_000
) -> dict[str, DataFrame]:
    """Named question tables plus "<train_source>_train".

    The loaded train source and its test split are written once and read again,
    instead of running the document join for every use.
    """
    out: dict[str, DataFrame] = {}
    for name, source in sources.items():
        loaded = load_questions(source.rows, source.docs, source.spec)
        if name != train_source:
            out[name] = select_questions(loaded, source.spec)
            continue
        loaded = materialize(loaded, f"{name}-loaded")
        out[name] = materialize(select_questions(loaded, source.spec), f"{name}-test")
        out[f"{name}_train"] = training_set(loaded, out[name], cap)
    return out


def write_question_sets(sets: dict[str, DataFrame], folder: str) -> dict[str, str]:
    return {name: write_jsonl(df, f"{folder}/{name}.jsonl") for name, df in sets.items()}
