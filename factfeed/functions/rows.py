"""Row-level evaluation control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is evaluated exactly once per row.

    A plain withColumn may be copied by the optimizer into every later
    expression and pushed-down filter that mentions it; folds that build on
    each other would then run many times over. The one-element explode keeps
    the value where it is.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))
