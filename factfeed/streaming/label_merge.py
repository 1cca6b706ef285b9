"""Verdicts and grades that arrive in any order, paired as both are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotation import pair_labels

ARRIVAL = "answer_id long, sentence string, statement string, task string, label string, done_at timestamp"
KEYS = ("answer_id", "sentence", "statement")


def read_arrivals(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(ARRIVAL)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def pair_stream(arrivals: DataFrame, wait: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Stream-stream join of the two label kinds on the statement.

    `wait` bounds how far apart the two labels of a statement may finish and
    `late` how late a row may come; both bound the join state. Pairs beyond
    them are found by `missed_pairs`.
    """

    def side(task: str, prefix: str) -> DataFrame:
        rows = arrivals.filter(F.col("task") == task).withWatermark("done_at", late)
        names = [F.col(k).alias(f"{prefix}_{k}") for k in KEYS]
        return rows.select(*names, F.col("label").alias(task), F.col("done_at").alias(f"{prefix}_at"))

    left, right = side("verify", "v"), side("assess", "a")
    same = F.expr(" AND ".join(f"v_{k} = a_{k}" for k in KEYS))
    near = F.expr(f"a_at BETWEEN v_at - INTERVAL {wait} AND v_at + INTERVAL {wait}")
    return left.join(right, same & near).select(
        *[F.col(f"v_{k}").alias(k) for k in KEYS],
        "verify",
        "assess",
        F.greatest("v_at", "a_at").alias("paired_at"),
    )


def write_pairs(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the pairs found so far and stop when the input is used up."""
    return (
        pairs.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def missed_pairs(arrivals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs that the stream's time bounds left out, once all labels are there.

    Both arguments are tables: all arrivals as written, and the pairs found so far.
    A statement that has one label only comes out with null for the other.
    """
    every = pair_labels(arrivals.select(*KEYS, "task", "label"))
    same = [every[k].eqNullSafe(pairs[k]) for k in KEYS]
    return every.join(pairs.select(*KEYS), same, "left_anti")
