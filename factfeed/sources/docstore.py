"""Document store: a table of (title, text), paragraphs split by a sentinel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PARAGRAPH_SENTINEL


def read_docstore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("title", "text")


def unique_documents(docs: DataFrame) -> DataFrame:
    """Documents whose title occurs once; only titles are counted.

    Repeated titles are few, so the anti join moves the texts only when the
    optimizer finds the repeated ones too many to broadcast.
    """
    repeated = docs.groupBy("title").count().filter("count > 1").select("title")
    return docs.filter(F.col("title").isNotNull()).join(repeated, "title", "left_anti")


def lookup_titles(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """Paragraphs of the documents with the given titles, as a join."""
    wanted = titles.select("title").distinct()
    return (
        unique_documents(docs)
        .join(wanted, "title", "left_semi")
        .select("title", F.split("text", PARAGRAPH_SENTINEL).alias("paragraphs"))
    )
