"""From answers to labels: prompts, attempts, verdict pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AnnotateConfig
from ..functions.parsing import (
    MALFORMED,
    is_refusal,
    parse_grade,
    parse_verdict,
    with_extraction,
)
from ..functions.text import fill, strip

STATEMENT_KEYS = ["answer_id", "sentence", "statement"]


def last_record_per_question(df: DataFrame, order: str) -> DataFrame:
    """Of records with the same question text the last one counts."""
    w = Window.partitionBy("question").orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def fan_out_answers(df: DataFrame, order: str) -> DataFrame:
    """One row per distinct answer of a question."""
    latest = last_record_per_question(df, order)
    rest = [c for c in latest.columns if c != "answers"]
    return latest.select(*rest, F.posexplode(F.array_distinct("answers")).alias("answer_no", "answer"))


def fill_optional(df: DataFrame) -> DataFrame:
    """titles, else ground; materials, else none; extra_materials, else null."""
    strings = "array<string>"
    null = F.lit(None).cast(strings)
    have = {c: F.col(c) if c in df.columns else null for c in ("titles", "ground", "materials", "extra_materials")}
    return (
        df.withColumn("titles", F.coalesce(have["titles"], have["ground"]))
        .withColumn("materials", F.coalesce(have["materials"], F.array().cast(strings)))
        .withColumn("extra_materials", have["extra_materials"])
        .drop("ground")
    )


def task_id(task: Column) -> Column:
    """Id of one task, the same wherever and whenever it is computed."""
    keys = [F.col("answer_id").cast("string"), F.col("sentence"), F.col("statement")]
    return F.md5(F.concat_ws("\x1f", *keys, task))


def extract_prompts(answers: DataFrame, config: AnnotateConfig) -> DataFrame:
    return answers.withColumn("prompt", fill(config.extract_template, {"response": F.col("answer")}))


def evidence_text(passages: Column) -> Column:
    return F.array_join(F.transform(passages, lambda m: F.concat(F.lit("- "), strip(m))), "\n")


def verify_prompts(tasks: DataFrame, config: AnnotateConfig) -> DataFrame:
    """tasks with statement and passages (the retrieved evidence in order)."""
    return tasks.withColumn(
        "prompt",
        fill(
            config.verify_template,
            {"materials": evidence_text(F.col("passages")), "statement": F.col("statement")},
        ),
    )


def assess_prompts(tasks: DataFrame, config: AnnotateConfig) -> DataFrame:
    return tasks.withColumn(
        "prompt",
        fill(
            config.assess_template,
            {"question": F.col("question"), "response": F.col("answer"), "statement": F.col("statement")},
        ),
    )


def parse_extractions(completions: DataFrame) -> DataFrame:
    """One row per completion with its status and (sentence, statement) pairs."""
    return with_extraction(completions)


def parse_labels(completions: DataFrame) -> DataFrame:
    """Verify and assess completions with their label, null when unreadable."""
    label = F.when(F.col("task") == "verify", parse_verdict(F.col("text"))).otherwise(
        parse_grade(F.col("text"))
    )
    return completions.withColumn("label", label)


def resolve_attempts(
    parsed: DataFrame, keys: Sequence[str], value: str, retry_times: int
) -> DataFrame:
    """Value of the first readable attempt among the allowed ones."""
    return (
        parsed.filter(F.col(value).isNotNull() & (F.col("attempt") < retry_times))
        .groupBy(*keys)
        .agg(F.min_by(value, "attempt").alias(value))
    )


def resolve_extractions(parsed: DataFrame, retry_times: int) -> DataFrame:
    """Pairs of the first well-formed attempt per answer; only parsed pairs
    are shuffled, never the model text."""
    good = parsed.filter(F.col("status") != MALFORMED).select("answer_id", "attempt", "pairs")
    return resolve_attempts(good, ["answer_id"], "pairs", retry_times)


def statements(resolved: DataFrame) -> DataFrame:
    """Distinct (answer, sentence, statement); answers are unique already, so
    repeated statements are dropped inside the row."""
    return resolved.select("answer_id", F.inline(F.array_distinct("pairs")))


def statement_tasks(stmts: DataFrame) -> DataFrame:
    """One verify and one assess task per statement."""
    return stmts.withColumn("task", F.explode(F.array(F.lit("verify"), F.lit("assess")))).withColumn(
        "task_id", task_id(F.col("task"))
    )


def resolve_labels(tasks: DataFrame, completions: DataFrame, config: AnnotateConfig) -> DataFrame:
    """Label of every task, the default where no allowed attempt was readable."""
    found = resolve_attempts(
        parse_labels(completions).select("task_id", "attempt", "label"),
        ["task_id"],
        "label",
        config.retry_times,
    )
    default = F.when(F.col("task") == "verify", config.default_verdict).otherwise(config.default_grade)
    return tasks.join(found, "task_id", "left").withColumn("label", F.coalesce("label", default))


def pair_labels(resolved: DataFrame) -> DataFrame:
    """Verdict and grade of a statement side by side."""
    of = lambda task: F.max(F.when(F.col("task") == task, F.col("label"))).alias(task)
    return resolved.groupBy(*STATEMENT_KEYS).agg(of("verify"), of("assess"))


def nest_labels(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """answer -> sentence -> statement -> [verify, assess] as one map column;
    an answer without labels keeps an empty map."""
    per_sentence = labels.groupBy("answer_id", "sentence").agg(
        F.map_from_entries(F.collect_list(F.struct("statement", F.array("verify", "assess")))).alias("_m")
    )
    per_answer = per_sentence.groupBy("answer_id").agg(
        F.map_from_entries(F.collect_list(F.struct("sentence", "_m"))).alias("labels")
    )
    empty = F.create_map().cast("map<string,map<string,array<string>>>")
    return answers.join(per_answer, "answer_id", "left").withColumn(
        "labels", F.coalesce("labels", empty)
    )


def drop_refusals(labels: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Drop sentences that decline, ask back or end as a question."""
    return labels.filter(~is_refusal(F.col("sentence"), ignore_case))
