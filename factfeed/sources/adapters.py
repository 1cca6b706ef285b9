"""Normalizing the kinds of question sources to one record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SourceSpec
from ..operators.questions import (
    answer_fact,
    attach_documents,
    first_per_title,
    gold_paragraphs,
    keep_questions,
    keep_resolved,
    span_materials,
    supporting_titles,
    unescape_titles,
)
from ..session import materialize

RECORD = ("qid", "question", "titles", "materials", "extra_materials")


def _record(df: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("array<string>")
    for name in RECORD:
        if name not in df.columns:
            df = df.withColumn(name, nothing)
    return df.select(*RECORD)


def _with_store(df: DataFrame, docs: DataFrame | None) -> DataFrame:
    return df if docs is None else keep_resolved(attach_documents(df, docs))


def from_qa_context(df: DataFrame, docs: DataFrame | None, spec: SourceSpec) -> DataFrame:
    """Questions with labeled paragraphs: (qid, question, answer, context, supporting_facts)."""
    df = keep_questions(df, spec.question_end, spec.min_words)
    df = df.withColumn("titles", supporting_titles(F.col("supporting_facts.title")))
    fact = answer_fact(F.col("question"), F.col("answer"))
    df = df.withColumn("materials", F.array_append(gold_paragraphs(F.col("context"), F.col("titles")), fact))
    if docs is None:
        return _record(df)
    # written before the texts are looked up: the paragraphs nobody asks for go no further
    return _record(_with_store(materialize(df.select("qid", "question", "titles", "materials"), "asked"), docs))


def from_qa_span(df: DataFrame, docs: DataFrame | None, spec: SourceSpec) -> DataFrame:
    """Questions on one passage: (qid, title, context, question, answers)."""
    df = keep_questions(df, spec.question_end, spec.min_words)
    df = unescape_titles(first_per_title(df, "qid"), "title")
    df = _with_store(df, docs)
    return _record(
        df.withColumn(
            "materials", span_materials(F.col("context"), F.col("question"), F.col("answers.text"))
        )
    )


def from_topics(df: DataFrame, docs: DataFrame | None, spec: SourceSpec) -> DataFrame:
    """Prompts about one topic: (qid, input, topic)."""
    df = df.withColumnRenamed("input", "question")
    return _record(_with_store(unescape_titles(df, "topic"), docs))


def from_records(df: DataFrame, docs: DataFrame | None, spec: SourceSpec) -> DataFrame:
    return df


ADAPTERS = {
    "qa_context": from_qa_context,
    "qa_span": from_qa_span,
    "topic": from_topics,
    "generic": from_records,
}


def load_questions(df: DataFrame, docs: DataFrame | None, spec: SourceSpec) -> DataFrame:
    """Choose the adapter by the kind of source."""
    if spec.kind not in ADAPTERS:
        raise ValueError(f"unknown source kind {spec.kind!r}")
    return ADAPTERS[spec.kind](df, docs, spec)
