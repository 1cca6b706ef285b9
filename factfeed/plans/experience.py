"""Experience table: KL, shaped reward, advantages, per-sequence summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExperienceConfig
from ..session import materialize
from ..operators.experience import (
    cumulative_returns,
    gae,
    micro_batches,
    normalize_advantages,
    normalize_packed,
    packed_experience,
    padded_samples,
    padded_tokens,
    sequence_kl,
    sequence_summary,
    with_kl_and_reward,
)


def token_experience(rollouts: DataFrame, config: ExperienceConfig = ExperienceConfig()) -> DataFrame:
    """Per token: kl, shaped reward, normalized advantage and return."""
    df = with_kl_and_reward(rollouts, config)
    if config.estimator == "gae":
        df = gae(df, config.gamma, config.lambd, chunk=config.chunk)
    elif config.estimator == "reinforce":
        df = cumulative_returns(df, config.gamma, chunk=config.chunk)
    else:
        raise ValueError(f"unknown advantage estimator {config.estimator!r}")
    # the normalization reads the advantages twice: for the mean and the rows
    return normalize_advantages(materialize(df, "advantages"), config.eps)


def sequence_info(rollouts: DataFrame, config: ExperienceConfig = ExperienceConfig()) -> DataFrame:
    """Per sequence: mean KL, reward and return sums, lengths."""
    df = with_kl_and_reward(rollouts, config)
    return sequence_summary(df).join(sequence_kl(df), "seq_id")


def padded_job(
    sequences: DataFrame, pad: int, eos: int, config: ExperienceConfig = ExperienceConfig()
) -> tuple[DataFrame, DataFrame]:
    """Micro-batches, padding, end tokens, masks, KL, rewards and advantages in one:
    token rows and one row per sequence.

    sequences has (seq_id, prompt_ids, output_ids, rewards, logp, ref_logp, value).
    """
    laid = padded_samples(micro_batches(sequences, config.batch_size), pad, eos)
    # both results read the layout
    rows = materialize(padded_tokens(laid), "padded-tokens")
    shaped = with_kl_and_reward(rows, config)
    totals = shaped.groupBy("seq_id").agg(
        F.sum("reward").alias("reward"),
        F.sum("shaped").alias("return"),
        F.max("response_length").cast("long").alias("response_length"),
        F.max("total_length").cast("long").alias("total_length"),
        F.count(F.lit(1)).alias("num_actions"),
        F.try_divide(F.sum(F.col("kl") * F.col("mask")), F.sum("mask")).alias("kl"),
    )
    return token_experience(rows, config), totals


def packed_job(sequences: DataFrame, config: ExperienceConfig = ExperienceConfig()) -> DataFrame:
    """The same from packed micro-batches: one row per batch, advantages normalized
    over all actions."""
    if config.estimator not in ("gae", "reinforce"):
        raise ValueError(f"unknown advantage estimator {config.estimator!r}")
    packed = packed_experience(micro_batches(sequences, config.batch_size), config)
    return normalize_packed(materialize(packed, "packed-experience"), config.eps)
