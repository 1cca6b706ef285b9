"""Exact duplicates by sorting contents, in DataFrame functions only.

Texts are compared after folding A-Z; null counts as the empty text. Splitters that
Spark samples cut the normalised texts into ranges (`repartitionByRange`), every range
is sorted by an external sort, which puts equal texts next to each other, and a window
walks over the sorted rows: each text is compared with its neighbour's in full.

The sampled keys are a text's first `HEAD` characters and a hash of all of it, so the
driver sees no long text, and texts with a common head are still dealt apart. A text
whose copies outweigh a fraction of a range (they are counted by hash first, before any
text moves) is dealt in several runs, each with its own part of the range key. The first
row of such a run then stands for it: those rows are compared in full once more, and
give every run the group's row that stays and its size. There are fewer than `MOST_HOT`
such texts, because each outweighs 1 / MOST_HOT of the table.

Of equal texts the row with the largest doc_id stays. A null doc_id is less than all
others. Of rows that repeat that doc_id exactly one stays. Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfeed.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAD = 32  # characters of a text that its range key begins with
RANGE_BYTES = 64 << 20  # of normalised text in a range
MOST_HOT = 100_000
ROW = 64  # bytes a row weighs besides its text


def folded(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null as the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # texts of one byte a character have no other letters to fold
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_duplicates(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    spark = docs.sparkSession
    norm = docs.select(F.col("doc_id").cast("long"), folded(F.col("text")).alias("norm"))
    keyed = norm.withColumn("h", F.xxhash64("norm"))
    weight = (F.octet_length("norm") + ROW).cast("long")
    total = docs.agg(F.sum((F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + ROW).cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    limit = max(total // (4 * ranges), total // MOST_HOT, 1)
    counted = keyed.groupBy("h").agg(F.sum(weight).alias("weight"), F.count("*").alias("n")).where((F.col("weight") > limit) & (F.col("n") > 1))
    hot = materialize(counted.select("h", F.ceil(F.col("weight") / limit).cast("int").alias("runs")), "hot-texts")

    # a run is 1, 2 .. of a hot text and 0 of all others
    dealt = keyed.join(F.broadcast(hot), "h", "left").select(
        F.substring("norm", 1, HEAD).alias("head"),
        "h",
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("runs")) + 1, F.lit(0)).cast("int").alias("run"),
        "norm",
        "doc_id",
    )
    key = ["head", "h", "run"]
    last_first = F.desc_nulls_last("doc_id")
    ranged = dealt.repartitionByRange(ranges, *key).sortWithinPartitions(*key, "norm", last_first)
    equal = Window.partitionBy(*key, "norm")
    walk = equal.orderBy(last_first)
    runs = ranged.select(
        "doc_id",
        "run",
        F.row_number().over(walk).alias("place"),
        F.first("doc_id").over(walk).alias("keep_id"),
        F.count("*").over(equal).alias("group_size"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        "norm",
    )
    first = F.col("place") == 1
    runs = materialize(
        runs.select(
            "doc_id", "run", first.alias("first"), "keep_id", "group_size", "text_sha256",
            F.when(first & (F.col("run") > 0), F.col("norm")).alias("whole"),
        ),
        "runs",
    )
    joined = runs.where("whole is not null").groupBy("whole").agg(
        F.max("keep_id").alias("best"), F.sum("group_size").alias("size"), F.first("text_sha256").alias("text_sha256")
    )
    out = runs.drop("whole").join(F.broadcast(joined.drop("whole")), "text_sha256", "left")
    keep = F.when(F.col("size").isNull(), F.col("keep_id")).otherwise(F.col("best"))
    # all rows of one doc_id are in one run, so only one run begins with the best
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", "group_size").alias("group_size"),
        (F.col("first") & F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )
