"""Readers, writers, document store, source adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from factfeed.config import SourceSpec
from factfeed.operators.annotation import nest_labels
from factfeed.session import fresh_path, materialize
from factfeed.sources.adapters import load_questions
from factfeed.sources.docstore import lookup_titles
from factfeed.sources.jsonl import count_records, read_jsonl, write_counted, write_jsonl

from . import fixtures as fx
from .ctes import DOC_TITLE, NL, escape, query
from .registry import check

ANSWERS = "answer_id long, question string, answer string"


@check("jsonl_read", query("SELECT answer_id, question, answer FROM answers", "answers"))
def jsonl_read(spark, sf):
    path = write_jsonl(fx.answers(spark, sf).select("answer_id", "question", "answer"), fresh_path(spark, "answers"))
    return read_jsonl(spark, path, ANSWERS)


@check(
    "jsonl_write_nested",
    query("SELECT answer_id, sentence, statement, verify, assess FROM labels_h", "labels_h"),
)
def jsonl_write_nested(spark, sf):
    """Nested label maps written as JSON and read back in long form."""
    nested = nest_labels(fx.answers(spark, sf).select("answer_id"), fx.labels(spark, sf))
    path = write_jsonl(nested, fresh_path(spark, "labels"))
    back = read_jsonl(spark, path, "answer_id long, labels map<string,map<string,array<string>>>")
    return (
        back.select("answer_id", F.explode("labels").alias("sentence", "_m"))
        .select("answer_id", "sentence", F.explode("_m").alias("statement", "_l"))
        .select("answer_id", "sentence", "statement", F.get("_l", F.lit(0)).alias("verify"), F.get("_l", F.lit(1)).alias("assess"))
    )


@check("jsonl_rewrite", query("SELECT answer_id, question, answer FROM answers WHERE answer_id % 2 = 1", "answers"))
def jsonl_rewrite(spark, sf):
    """A second write replaces the first; only its rows are read back."""
    answers = fx.answers(spark, sf).select("answer_id", "question", "answer")
    path = write_jsonl(answers, fresh_path(spark, "twice"))
    write_jsonl(answers.where("answer_id % 2 = 1"), path, mode="overwrite")
    return read_jsonl(spark, path, ANSWERS)


@check("record_count", query("SELECT count(*) AS n FROM answers", "answers"))
def record_count(spark, sf):
    return count_records(spark, write_jsonl(fx.answers(spark, sf), fresh_path(spark, "count")))


@check(
    "record_count_on_write",
    query("SELECT conv_id, count(*) AS n, (SELECT count(*) FROM answers) AS written FROM (SELECT answer_id // 1000 AS conv_id FROM answers) GROUP BY ALL", "answers"),
)
def record_count_on_write(spark, sf):
    """Rows per conversation of the written table beside the count of the writing job."""
    path, n = write_counted(fx.answers(spark, sf).select("answer_id", "question", "answer"), fresh_path(spark, "counted"))
    back = read_jsonl(spark, path, ANSWERS).groupBy(F.expr("answer_id DIV 1000").alias("conv_id"))
    return back.agg(F.count(F.lit(1)).alias("n")).withColumn("written", F.lit(n).cast("long"))


@check(
    "document_lookup",
    query(
        f"""SELECT d.title, len(string_split(any_value(text), '####SPECIAL####SEPARATOR####'))::INTEGER AS n_paragraphs,
  replace(any_value(text), '####SPECIAL####SEPARATOR####', {NL}) AS body
FROM docs d WHERE d.title IN (SELECT {escape(DOC_TITLE)} FROM documents)
GROUP BY d.title HAVING count(*) = 1""",
        "docs",
    ),
)
def document_lookup(spark, sf):
    titles = fx.topics(spark, sf).select(F.col("topic").alias("title"))
    return lookup_titles(fx.docs(spark, sf), titles).select(
        "title", F.size("paragraphs").alias("n_paragraphs"), F.array_join("paragraphs", "\n").alias("body")
    )


_RECORD = """qid, question, array_to_string(titles, '|') AS titles,
  array_to_string(materials, '|') AS materials, array_to_string(extra_materials, '|') AS extra"""


@check(
    "source_adapters",
    query(
        f"""SELECT 'qa_span' AS kind, {_RECORD} FROM ready_span
UNION ALL SELECT 'topic', {_RECORD} FROM ready_topic
UNION ALL SELECT 'qa_context', {_RECORD} FROM ready_context""",
        "ready_span",
        "ready_topic",
        "ready_context",
    ),
)
def source_adapters(spark, sf):
    """The three kinds of sources, normalized to one record."""
    docs = fx.docs(spark, sf)
    out = None
    for kind, rows in (("qa_context", fx.qa_context), ("topic", fx.topics), ("qa_span", fx.qa_span)):
        part = load_questions(rows(spark, sf), docs, SourceSpec(kind=kind)).select(
            F.lit(kind).alias("kind"),
            "qid",
            "question",
            F.array_join("titles", "|").alias("titles"),
            F.array_join("materials", "|").alias("materials"),
            F.array_join("extra_materials", "|").alias("extra"),
        )
        part = materialize(part, kind)  # the texts of one kind at a time are on their way
        out = part if out is None else out.unionByName(part)
    return out
