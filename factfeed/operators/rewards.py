"""Scores from labels, at token, sentence or answer level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RewardConfig
from ..functions.numbers import lookup
from ..functions.rows import bind
from .alignment import anchor_statements, last_char, locate_sentences, token_at, with_offsets
from .annotation import drop_refusals


def info_value(config: RewardConfig, grade: Column) -> Column:
    return lookup(config.informative_map, grade)


def info_score(config: RewardConfig, total: Column) -> Column:
    """Informativeness of a sentence from the sum over its statements."""
    return F.lit(config.info_weight) * F.log(F.greatest(F.lit(config.epsilon), total) + F.lit(config.mu))


def truth_score(config: RewardConfig, verdict: Column, grade: Column) -> Column:
    return (
        F.lit(config.truth_weight)
        * lookup(config.verification_map, verdict)
        * F.abs(info_value(config, grade))
    )


def sentence_info(labels: DataFrame, config: RewardConfig = RewardConfig()) -> DataFrame:
    return labels.groupBy("answer_id", "sentence").agg(
        info_score(config, F.sum(info_value(config, F.col("assess")))).alias("info")
    )


def statement_truth(labels: DataFrame, config: RewardConfig = RewardConfig()) -> DataFrame:
    return labels.withColumn("truth", truth_score(config, F.col("verify"), F.col("assess")))


def _spine(outputs: DataFrame, special: bool) -> DataFrame:
    """(answer_id, ends, n_tokens): where the tokens of an answer end."""
    return with_offsets(outputs, special).select("answer_id", "ends", "n_tokens")


def place_sentences(outputs: DataFrame, sentences: DataFrame, special: bool) -> DataFrame:
    """Add place to distinct (answer_id, sentence) rows: the only step that sees the
    answer text, once for each sentence however many statements it has."""
    tokens = F.col("tokens")
    if not special:
        tokens = F.filter(tokens, lambda t, i: ~F.get("special", i))
    texts = outputs.select("answer_id", F.array_join(tokens, "").alias("_answer"))
    return locate_sentences(sentences.join(texts, "answer_id"), answer="_answer").drop("_answer")


def _fill_spine(outputs: DataFrame, points: DataFrame, special: bool, default: float = 0.0) -> DataFrame:
    """One score array per output from (answer_id, char, score) points.

    Points are summed per character first; an answer has no more of them than
    characters. Which token holds a character is looked up here, once an answer.
    """
    summed = points.groupBy("answer_id", "char").agg(F.sum("score").alias("score"))
    lists = summed.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("char", "score"))).alias("_points"))
    rows = _spine(outputs, special).join(lists, "answer_id", "left")
    at_tokens = F.transform(
        "_points", lambda p: F.struct(token_at(F.col("ends"), F.col("n_tokens"), p["char"]).alias("tok"), p["score"].alias("score"))
    )
    rows = bind(rows, "_at", F.coalesce(at_tokens, F.array().cast("array<struct<tok:int,score:double>>")))

    def score(i: Column) -> Column:
        own = F.filter("_at", lambda p: p["tok"] == i)
        total = F.aggregate(own, F.lit(0.0), lambda acc, p: acc + p["score"])
        return F.when(F.size(own) > 0, total).otherwise(F.lit(float(default)))

    n = F.col("n_tokens")
    filled = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), score)).otherwise(F.array().cast("array<double>"))
    return bind(rows, "scores", filled).select("answer_id", "scores")


def token_points(outputs: DataFrame, labels: DataFrame, config: RewardConfig = RewardConfig()) -> DataFrame:
    """(answer_id, char, score): info at the last placed character of each sentence,
    truth at the last aligned character of each statement.

    The statements of a sentence, which are those of one model text, wait in an array
    until the sentence is placed, so that the labels are read once.
    """
    truth = truth_score(config, F.col("verify"), F.col("assess"))
    grouped = labels.groupBy("answer_id", "sentence").agg(
        F.collect_list(F.struct("statement", truth.alias("truth"))).alias("_claims"),
        info_score(config, F.sum(info_value(config, F.col("assess")))).alias("_info"),
    )
    placed = place_sentences(outputs, grouped, special=True)
    rows = placed.select("answer_id", "sentence", "place", "_info", F.posexplode("_claims").alias("_no", "_claim"))
    rows = anchor_statements(rows.select("*", "_claim.statement", "_claim.truth").drop("_claim"))
    points = F.array(
        F.struct(F.col("anchor").alias("char"), F.col("truth").alias("score")),
        F.struct(F.when(F.col("_no") == 0, last_char(F.col("place"))).alias("char"), F.col("_info").alias("score")),
    )
    return rows.select("answer_id", F.inline(points)).where("char IS NOT NULL")


def token_rewards(outputs: DataFrame, labels: DataFrame, config: RewardConfig = RewardConfig()) -> DataFrame:
    return _fill_spine(outputs, token_points(outputs, labels, config), special=True)


def sentence_totals(labels: DataFrame, config: RewardConfig = RewardConfig()) -> DataFrame:
    """(answer_id, sentence, score): truth of its statements plus its info."""
    return labels.groupBy("answer_id", "sentence").agg(
        (
            F.sum(truth_score(config, F.col("verify"), F.col("assess")))
            + info_score(config, F.sum(info_value(config, F.col("assess"))))
        ).alias("score")
    )


def sentence_points(outputs: DataFrame, labels: DataFrame, config: RewardConfig = RewardConfig()) -> DataFrame:
    """(answer_id, char, score): a sentence's score at its last placed character."""
    placed = place_sentences(outputs, sentence_totals(labels, config), special=False)
    return placed.select("answer_id", last_char(F.col("place")).alias("char"), "score")


def sentence_rewards(outputs: DataFrame, labels: DataFrame, config: RewardConfig = RewardConfig()) -> DataFrame:
    return _fill_spine(outputs, sentence_points(outputs, labels, config), special=False)


def answer_rewards(outputs: DataFrame, labels: DataFrame, config: RewardConfig = RewardConfig()) -> DataFrame:
    """The whole score on the last token, the default on all others."""
    totals = sentence_totals(labels, config).groupBy("answer_id").agg(F.sum("score").alias("_total"))
    n = F.size("tokens")
    scores = F.array_append(
        F.array_repeat(F.lit(float(config.default_for_none)), n - 1), F.coalesce("_total", F.lit(0.0))
    )
    return (
        outputs.join(totals, "answer_id", "left")
        .withColumn("scores", F.when(n > 0, scores).otherwise(F.array().cast("array<double>")))
        .select("answer_id", "scores")
    )


BY_GRANULARITY = {"token": token_rewards, "sentence": sentence_rewards, "answer": answer_rewards}


def labels_to_rewards(outputs: DataFrame, labels: DataFrame, config: RewardConfig = RewardConfig()) -> DataFrame:
    """Drop the refusals, then score at the configured granularity."""
    if config.granularity not in BY_GRANULARITY:
        raise ValueError(f"unknown granularity {config.granularity!r}")
    return BY_GRANULARITY[config.granularity](outputs, drop_refusals(labels), config)


def reward_rows(rewards: DataFrame) -> DataFrame:
    """Long form (answer_id, tok_no, score)."""
    return rewards.select("answer_id", F.posexplode("scores").alias("tok_no", "score"))
