"""JSON-lines tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION_SCHEMA = T.StructType(
    [
        T.StructField("qid", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("titles", T.ArrayType(T.StringType())),
        T.StructField("materials", T.ArrayType(T.StringType())),
        T.StructField("extra_materials", T.ArrayType(T.StringType())),
        T.StructField("prompt", T.StringType()),
    ]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read JSON lines with a declared schema; absent keys become null."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def target_path(path: str, default_name: str = "qa.jsonl") -> str:
    """A target that ends in a slash is a folder and gets the default file name.

    What is on the file system does not matter: an earlier output is a folder too.
    """
    return f"{path}{default_name}" if path.endswith("/") else path


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write one JSON object per row and return where they went."""
    path = target_path(path)
    df.write.mode(mode).json(path)
    return path


def write_counted(df: DataFrame, path: str, mode: str = "errorifexists") -> tuple[str, int]:
    """Write like `write_jsonl` and return the number of records as well, counted
    by the writing job itself."""
    written = Observation()
    path = write_jsonl(df.observe(written, F.count(F.lit(1)).alias("n")), path, mode)
    return path, written.get["n"]


def count_records(spark: SparkSession, path: str) -> DataFrame:
    """Number of lines of a written table, as a one-row table."""
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n"))
