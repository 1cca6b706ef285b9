"""Tables, folds and Arrow plumbing shared by the operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """Remainder of the CRC-32 of the key's text; a missing key counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def map_batches(df: DataFrame, make, schema: str | StructType) -> DataFrame:
    """mapInArrow with a function that is set up once per task.

    `make()` runs in the task and returns batch -> columns (in the order of
    `schema`) or None; it may also return a pair (step, finish) where finish()
    gives the last columns once the input has ended.
    """
    names = schema.names if isinstance(schema, StructType) else [f.split(":")[0].split()[0] for f in schema.split(", ")]

    def run(batches):
        made = make()
        step, finish = made if isinstance(made, tuple) else (made, None)
        for batch in batches:
            if batch.num_rows:
                for columns in _several(step(batch)):
                    yield pa.RecordBatch.from_arrays(columns, names)
        if finish is not None:
            for columns in _several(finish()):
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def _several(result):
    """The column lists of a result: None, one list of columns, or many."""
    if result is None:
        return []
    if isinstance(result, list) and result and isinstance(result[0], pa.Array):
        return [result]
    return result


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]
