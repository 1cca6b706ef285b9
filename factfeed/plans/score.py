"""Scoring job: from outputs and labels to scores and metrics."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnnotateConfig, RewardConfig
from ..functions.text import strip
from ..operators.inference import Predict
from ..operators.metrics import answer_metrics
from ..operators.rewards import labels_to_rewards
from .annotate import annotate_with_model, labels_from_completions


class Scored(NamedTuple):
    scores: DataFrame
    labels: DataFrame
    metrics: DataFrame


def strip_texts(answers: DataFrame) -> DataFrame:
    return answers.withColumn("question", strip(F.col("question"))).withColumn(
        "answer", strip(F.col("answer"))
    )


def score_answers(
    outputs: DataFrame, labels: DataFrame, config: RewardConfig = RewardConfig()
) -> Scored:
    return Scored(
        labels_to_rewards(outputs, labels, config),
        labels,
        answer_metrics(outputs, labels, config),
    )


def score_from_completions(
    outputs: DataFrame,
    extractions: DataFrame,
    completions: DataFrame,
    reward: RewardConfig = RewardConfig(),
    annotate: AnnotateConfig = AnnotateConfig(),
) -> Scored:
    return score_answers(outputs, labels_from_completions(extractions, completions, annotate), reward)


def score_with_model(
    outputs: DataFrame,
    answers: DataFrame,
    evidence: DataFrame,
    make_predict: Callable[[], Predict],
    reward: RewardConfig = RewardConfig(),
    annotate: AnnotateConfig = AnnotateConfig(),
    workers: int | None = None,
    sampling: bool = False,
    run: str | None = None,
) -> Scored:
    """The whole job: stripped answers are labeled by the model, then scored."""
    labels = annotate_with_model(strip_texts(answers), evidence, make_predict, annotate, workers, sampling, run)
    return score_answers(outputs, labels, reward)
