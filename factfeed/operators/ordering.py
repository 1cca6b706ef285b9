"""Order-dependent work without a global window or an unbounded group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import bind


# Up to this many rows a top-n is cheaper: no task gets more than this from another.
TOP_ROWS = 1_000


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    """First n rows by a unique order column.

    A small n is a top-n over the order column. For a larger one the n-th value is found from counts per bucket of the key and one look into the
    bucket it lies in, so no task sorts n rows; the wide rows are then kept by a
    comparison with it. Rows with a null key are in no bucket and never kept.
    """
    keys = df.select(F.col(order).alias("_key")).filter("_key IS NOT NULL")
    if n <= TOP_ROWS:
        return df.filter(F.col(order) <= keys.orderBy("_key").limit(n).agg(F.max("_key")).scalar())
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = quantile_buckets(keys, "_bucket", "_key", buckets).withColumn("_all", F.lit(0))
    counts = tagged.groupBy("_all", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    edge = _offsets(counts, ["_all"], "_bucket").filter((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    inside = tagged.join(F.broadcast(edge.select("_bucket", "_before")), "_bucket").withColumn("_no", place)
    cut = inside.filter(F.col("_no") + F.col("_before") == n).agg(F.max("_key")).scalar()
    last = keys.agg(F.max("_key")).scalar()
    return df.filter(F.col(order) <= F.coalesce(cut, last))


def seeded_hash(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_test(df: DataFrame, test_size: int, seed: int, key: str = "qid") -> DataFrame:
    """Keys of the test side: the test_size smallest seeded hashes."""
    return (
        df.select(key)
        .orderBy(seeded_hash(seed, F.col(key)), key)
        .limit(test_size)
    )


def train_test_split(
    df: DataFrame, test_size: int, seed: int, side: str, key: str = "qid"
) -> DataFrame:
    """Exact-size, disjoint, repeatable split; returns the chosen side."""
    picked = split_test(df, test_size, seed, key)
    return df.join(picked, key, "left_semi" if side == "test" else "left_anti")


def _offsets(counts: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    """Rows before each bucket; runs over one row per bucket."""
    w = (
        Window.partitionBy(*group)
        .orderBy(bucket)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def number_rows(
    df: DataFrame, out: str, order: Sequence[str], bucket: Column, group: Sequence[str] = ()
) -> DataFrame:
    """Dense 0-based number by `order` (within `group`).

    `bucket` must never decrease along the order. Each bucket is numbered by
    itself and shifted by the size of the buckets before it, so a hot group is
    spread over its buckets and no task sees all rows.
    """
    # without a group, one constant key holds the (bounded) bucket table
    keys = list(group) or ["_all"]
    tagged = df.withColumn("_bucket", bucket)
    if not group:
        tagged = tagged.withColumn("_all", F.lit(0))
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, keys, "_bucket").drop("_n")
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.withColumn("_local", F.row_number().over(w) - 1)
        .join(offsets, keys + ["_bucket"])
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_local", "_before", "_bucket", "_all")
    )


# Sampled keys per bucket, on average. Buckets then differ by a factor of about two.
SAMPLED = 32


def quantile_buckets(df: DataFrame, out: str, key: str, buckets: int) -> DataFrame:
    """Add the bucket of a unique orderable key by quantiles, about equal-sized for
    any spread of the keys.

    The cut points (`buckets` - 1 keys) are a scalar subquery of the plan: no job
    runs while the plan is built. They come from keys chosen by their hash, so they
    are the same whenever and wherever they are computed, as range partitioning with
    its random sample is not; the sample's size is bounded by `buckets`, not by the
    data. A row finds its bucket by binary search, one column a step. A null key
    gets bucket 0.
    """
    if buckets < 2:
        return df.withColumn(out, F.lit(0))
    scale = 1 << 40
    keys = df.select(F.col(key).alias("_k")).filter("_k IS NOT NULL")
    rows = keys.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    share = F.least(F.lit(1.0), F.lit(float(SAMPLED * buckets)) / rows)
    sample = keys.filter(F.pmod(F.xxhash64("_k"), F.lit(scale)) < share * scale)
    found = sample.agg(F.array_sort(F.collect_list("_k")).alias("_ks"), F.count(F.lit(1)).alias("_n"))
    cut = lambda i: F.get("_ks", F.floor(i * F.col("_n") / buckets).cast("int"))
    cuts = found.select(F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), cut)).scalar()
    df = df.withColumn(out, F.lit(0))
    for power in reversed(range((buckets - 1).bit_length())):
        reached = F.get(cuts, F.col(out) + ((1 << power) - 1)) <= F.col(key)
        df = df.withColumn(out, F.when(reached, F.col(out) + (1 << power)).otherwise(F.col(out)))
    return df


def number_by_key(df: DataFrame, out: str, key: str, buckets: int | None = None) -> DataFrame:
    """Dense 0-based number by a unique orderable key."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return number_rows(quantile_buckets(df, "_range", key, n), out, [key], F.col("_range")).drop("_range")


def number_by_hash(df: DataFrame, out: str, key: str, seed: int, digits: int | None = None) -> DataFrame:
    """Dense 0-based number in a seeded shuffled order.

    The leading hex digits of the hash are ordered buckets of equal size, by
    default at least 16 to a shuffle partition.
    """
    if digits is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        digits = 1 + math.ceil(math.log(max(partitions, 2), 16))
    tagged = df.withColumn("_hash", seeded_hash(seed, F.col(key)))
    bucket = F.substring("_hash", 1, digits)
    return number_rows(tagged, out, ["_hash", key], bucket).drop("_hash")


def _later(heads: DataFrame, seq: str, width: int) -> DataFrame:
    """(seq, _chunk, _in): what each chunk receives from all later ones.

    A chunk turns what it receives into _p + _q * received. Blocks of `width` chunks
    are composed to one such map each; a block receives what the maps of the later ones
    give from the sequence's end, and is then gone through with that: lists hold at most
    `width` chunks, or one entry per later block.
    """
    # one exchange, by sequence, for the blocks and for what each of them receives
    block = F.floor(F.col("_chunk") / width)
    maps = heads.filter(F.col(seq).isNotNull() & block.isNotNull()).repartition(seq).select(
        seq, block.alias("_block"), F.struct(F.col("_chunk").alias("c"), "_p", "_q").alias("_m")
    )
    from_end = lambda items: F.reverse(F.array_sort(F.collect_list(items)))
    blocks = maps.groupBy(seq, "_block").agg(from_end("_m").alias("_ms"))
    one = F.struct(F.lit(0.0).alias("p"), F.lit(1.0).alias("q"))
    whole = F.aggregate(
        "_ms", one, lambda acc, m: F.struct((m["_p"] + m["_q"] * acc["p"]).alias("p"), (m["_q"] * acc["q"]).alias("q"))
    )

    later = Window.partitionBy(seq).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    received = F.aggregate(F.collect_list("_w").over(later), F.lit(0.0), lambda x, m: m["p"] + m["q"] * x)
    zero = F.struct(F.col("_start").alias("x"), F.array().cast("array<struct<c:bigint,_in:double>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        row = F.struct(m["c"].alias("c"), acc["x"].alias("_in"))
        return F.struct((m["_p"] + m["_q"] * acc["x"]).alias("x"), F.array_append(acc["out"], row).alias("out"))

    return (
        bind(blocks, "_w", whole)
        .withColumn("_start", received)
        .select(seq, F.inline(F.aggregate("_ms", zero, step)["out"]))
        .withColumnRenamed("c", "_chunk")
    )


def reverse_scan(
    df: DataFrame,
    seq: str,
    pos: str,
    x: Column,
    decay: float,
    out: str,
    value: Column | None = None,
    weight: float = 0.0,
    chunk: int = 256,
) -> DataFrame:
    """Add y[t] = x[t] - v[t] + (weight * v[t+1] + decay * y[t+1]) per sequence;
    without a value column v is 0.

    pos is 0-based and dense. Sequences are cut into chunks of `chunk`
    positions, and the rows are shuffled once, by (sequence, chunk): a long or
    hot sequence is spread over its chunks. What a chunk needs from all later
    ones is the bracket at its end, one number, found from plain sums per chunk
    in two levels (`_later`).
    """
    own = df.columns
    decay_, weight_ = F.lit(float(decay)), F.lit(float(weight))
    rows = df.withColumn("_x", x.cast("double")).withColumn(
        "_v", (value if value is not None else F.lit(0.0)).cast("double")
    )
    rows = rows.withColumn("_chunk", F.floor(F.col(pos) / chunk))

    # the bracket at the first position of a chunk, as a map of the one at its end
    step = F.col(pos) - F.col("_chunk") * chunk
    first = step == 0
    sums = rows.groupBy(seq, "_chunk").agg(
        F.sum(F.pow(decay_, step) * (F.col("_x") - F.col("_v"))).alias("_hx"),
        F.sum(F.when(~first, F.pow(decay_, step - 1) * F.col("_v")).otherwise(0.0)).alias("_hv"),
        F.sum(F.when(first, F.col("_v")).otherwise(0.0)).alias("_first"),
        F.count(F.lit(1)).alias("_len"),
    )
    heads = sums.select(
        seq,
        "_chunk",
        (weight_ * F.col("_first") + decay_ * (F.col("_hx") + weight_ * F.col("_hv"))).alias("_p"),
        F.pow(decay_, F.col("_len")).alias("_q"),
    )
    after = _later(heads, seq, 256)

    # fold every chunk from its end, starting with that number
    names = [c for c in own if c != seq]
    item = F.struct(F.col(pos).alias("_pos"), "_x", "_v", *[F.col(c) for c in names])
    chunks = (
        rows.groupBy(seq, "_chunk")
        .agg(F.reverse(F.array_sort(F.collect_list(item))).alias("_rows"))
        .join(after, [seq, "_chunk"])
    )

    def back(acc: Column, item: Column) -> Column:
        y = item["_x"] - item["_v"] + acc["later"]
        return F.struct(
            (weight_ * item["_v"] + decay_ * y).alias("later"), F.array_append(acc["ys"], y).alias("ys")
        )

    zero = F.struct(F.col("_in").alias("later"), F.array().cast("array<double>").alias("ys"))
    ys = F.aggregate("_rows", zero, back)["ys"]
    chunks = bind(chunks, "_ys", ys)
    return chunks.select(
        seq, F.explode(F.arrays_zip("_rows", "_ys")).alias("_z")
    ).select(*[F.col(seq) if c == seq else F.col(f"_z._rows.{c}") for c in own], F.col("_z._ys").alias(out))
