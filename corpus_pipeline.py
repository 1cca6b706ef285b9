"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table; `run` writes it to the
shared folder and reads it again as the next stage's documents. All but the last
stage return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfeed.llm import decontamination, lsh_forest, packing, passages, quality_rules
from factfeed.llm.common import table
from factfeed.session import materialize, ship, small_or_none, tune

ship()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep.

    The input's columns travel in one struct, so that none meets a statistic's name.
    """
    tune(spark)
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    judged = quality_rules.statistics(docs.select(whole, "text")).where(quality_rules.verdict(rules))
    return judged.select("whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows that repeat an id and its text are one document; rows that share an id but
    not a text stay or go together, none for the other's sake. A row without an id is
    in no group.
    """
    tune(spark)
    found = lsh_forest.near_duplicates(docs.select("doc_id", "text"))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi").union(docs.where("doc_id is null"))
    repeated = small_or_none(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated is None:
        return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
    once = stay.join(repeated, "doc_id", "left_anti")
    again = stay.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has as well."""
    tune(spark)
    found = materialize(passages.shared_passages(docs.select("doc_id", "text")), "passages")
    left = passages.without_repeats(docs, found)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window, each judged by its own text."""
    tune(spark)
    return decontamination.without_hits(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences."""
    tune(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("shared passages", repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# learned rules, fuzzy passages and a tokenizer: beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
