"""Answer-quality metrics from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import VERDICTS, RewardConfig
from ..functions.numbers import safe_div, safe_mean
from .annotation import drop_refusals
from .rewards import info_score, info_value


def slug(verdict: str) -> str:
    return verdict.lower().replace(" ", "_")


COUNTS = [f"n_{slug(v)}" for v in VERDICTS] + [f"n_valid_{slug(v)}" for v in VERDICTS] + ["n_helpless", "n_statements"]
SHARES = ["accuracy", "valid_accuracy", "ground", "info", "info_reward"]
METRICS = COUNTS + SHARES
# fixed values: names of the metrics in reports
REPORT_NAMES = (
    {f"n_{slug(v)}": f"#{v}" for v in VERDICTS}
    | {f"n_valid_{slug(v)}": f"#Valid {v}" for v in VERDICTS}
    | {"n_helpless": "#helpless", "n_statements": "#statements"}
    | {"valid_accuracy": "valid accuracy", "refuse": "%refuse"}
)


def with_report_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(REPORT_NAMES)


def answer_metrics(answers: DataFrame, labels: DataFrame, config: RewardConfig = RewardConfig()) -> DataFrame:
    """One row per answer, also for answers without statements.

    Counts are summed per sentence first (the informativeness needs that
    level) and then per answer; both steps combine before they shuffle.
    """
    helpful = F.col("assess") != "1"
    counts = [F.count_if(F.col("verify") == v).alias(f"n_{slug(v)}") for v in VERDICTS]
    counts += [
        F.count_if((F.col("verify") == v) & helpful).alias(f"n_valid_{slug(v)}") for v in VERDICTS
    ]
    per_sentence = (
        drop_refusals(labels)
        .groupBy("answer_id", "sentence")
        .agg(
            *counts,
            F.count_if(F.col("assess") == "1").alias("n_helpless"),
            F.count(F.lit(1)).alias("n_statements"),
            F.sum(F.col("assess").cast("double")).alias("_grades"),
            info_score(config, F.sum(info_value(config, F.col("assess")))).alias("_info"),
        )
    )
    per_answer = per_sentence.groupBy("answer_id").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum("_grades").alias("_grades"),
        F.sum("_info").alias("info_reward"),
    )
    df = answers.select("answer_id").join(per_answer, "answer_id", "left").fillna(0)
    n = F.col("n_statements")
    return (
        df.withColumn("accuracy", safe_div(F.col("n_correct") + F.col("n_hedged_correct"), n))
        .withColumn("valid_accuracy", safe_div(F.col("n_valid_correct") + F.col("n_valid_hedged_correct"), n))
        .withColumn("ground", 1 - safe_div(F.col("n_vague"), n))
        .withColumn("info", safe_mean(F.col("_grades"), n))
        .select("answer_id", *METRICS)
    )


def corpus_metrics(per_answer: DataFrame) -> DataFrame:
    """Means over the answers with statements, and the share of the others."""
    spoken = F.col("n_statements") > 0
    means = [F.coalesce(F.avg(F.when(spoken, F.col(m))), F.lit(1.0)).alias(m) for m in METRICS]
    refuse = (1 - F.avg(spoken.cast("double"))).alias("refuse")
    return per_answer.agg(*means, refuse)
