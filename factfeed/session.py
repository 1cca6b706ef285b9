"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Run-time settings the plans are written for. All are ordinary SQL options:
# results do not depend on them, only the number of exchanges does.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a join on (block, term) may reuse a partitioning by block alone
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # folds cost far more than their bytes suggest: keep small partitions apart
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # hash instead of sort where every partition of a side is known to be small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    # a written stage needs no shuffle files of the stages before it
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
CODEC = "zstd"  # of written stages: about half the bytes of the default


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship(*packages: str) -> None:
    """Send functions of these packages to the workers by value, so that the
    packages need not be installed there."""
    for name in ("factfeed", *packages):
        cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local session without the setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="factfeed-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, row_group: int | None = None) -> str:
    path = fresh_path(df.sparkSession, name)
    out = df.write.option("parquet.block.size", row_group) if row_group else df.write
    out.option("compression", CODEC).parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a costly stage once and go on from the written table."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


BROADCAST_ROWS = 100_000


def small_or_none(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """Check the size of a narrow table before a join.

    None when it is empty, marked for broadcast when it has at most `limit`
    rows, and unmarked (an ordinary shuffle join) beyond that.
    """
    n = df.limit(limit + 1).count()
    if n == 0:
        return None
    return F.broadcast(df) if n <= limit else df
