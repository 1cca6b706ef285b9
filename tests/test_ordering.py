from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factfeed.operators.experience import micro_batches
from factfeed.operators.ordering import (
    first_n,
    number_by_hash,
    number_by_key,
    number_rows,
    quantile_buckets,
    reverse_scan,
    train_test_split,
)


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_dense_numbers_for_clustered_keys(spark, buckets):
    keys = sorted({*range(50), *range(10**9, 10**9 + 200), 5 * 10**12})
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(6)
    got = {r["k"]: r["no"] for r in number_by_key(df, "no", "k", buckets).collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_numbers_within_a_hot_group(spark):
    rows = [(0, i) for i in range(500)] + [(g, i) for g in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "g int, i long").repartition(5)
    got = number_rows(df, "no", ["i"], F.expr("i DIV 64"), ["g"]).collect()
    assert len(got) == len(rows) and all(r["no"] == r["i"] for r in got)


def test_hash_order_is_stable(spark):
    df = spark.range(300).withColumnRenamed("id", "qid")
    one = {r["qid"]: r["no"] for r in number_by_hash(df, "no", "qid", 3).collect()}
    two = {r["qid"]: r["no"] for r in number_by_hash(df.repartition(7), "no", "qid", 3).collect()}
    other = {r["qid"]: r["no"] for r in number_by_hash(df, "no", "qid", 4).collect()}
    assert one == two != other and sorted(one.values()) == list(range(300))


@pytest.mark.parametrize("size", [0, 1, 17, 200, 500])
def test_split_sizes(spark, size):
    df = spark.range(200).withColumnRenamed("id", "qid")
    test = {r["qid"] for r in train_test_split(df, size, 1, "test").collect()}
    train = {r["qid"] for r in train_test_split(df, size, 1, "train").collect()}
    assert len(test) == min(size, 200) and not test & train and test | train == set(range(200))


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_micro_batches_do_not_depend_on_partitions(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(0, 300, 3).withColumnRenamed("id", "seq_id").repartition(5)
        got = sorted((r["seq_id"], r["batch_id"], r["pos"]) for r in micro_batches(df, 8).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == [(3 * i, i // 8, i % 8) for i in range(100)]


@pytest.mark.parametrize("n", [1, 10, 1000])
def test_first_n(spark, n):
    df = spark.range(50).selectExpr("49 - id AS k", "'x' AS wide")
    assert sorted(r["k"] for r in first_n(df, n, "k").collect()) == list(range(min(n, 50)))


@pytest.mark.parametrize("n", [0, 1, 2500, 4999, 5000, 9000])
def test_first_n_of_clustered_and_text_keys(spark, n):
    numbers = [*range(2000), *range(10**12, 10**12 + 3000)]
    df = spark.createDataFrame([(k, f"{k:015d}") for k in numbers], "k long, t string").repartition(7)
    for key in ("k", "t"):
        assert sorted(r["k"] for r in first_n(df, n, key).collect()) == numbers[:n]


def test_first_n_leaves_null_keys_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(None,), (3,), (1,), (2,)], "k long")
    assert sorted(r["k"] for r in first_n(df, 2, "k").collect()) == [1, 2]
    assert sorted(r["k"] for r in first_n(df, 9, "k").collect()) == [1, 2, 3]
    assert first_n(df.limit(0), 2, "k").count() == 0
    assert number_by_key(df.limit(0), "no", "k").count() == 0


def test_building_a_plan_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        numbered = number_by_key(spark.range(5000), "no", "id")
        picked = first_n(spark.range(5000), 2500, "id")
        assert not tracker.getJobIdsForGroup("plan")
        assert numbered.where("no <> id").count() == 0 and picked.count() == 2500
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_buckets_of_clustered_keys_are_even(spark):
    df = spark.range(20000).selectExpr("IF(id < 10000, id, id * 1000003) AS k").repartition(5)
    sizes = [r["count"] for r in quantile_buckets(df, "b", "k", 8).groupBy("b").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 20000 and max(sizes) < 2 * 20000 / 8


@pytest.mark.parametrize("decay", [1.0, 0.97])
def test_scan_over_many_blocks(spark, decay):
    n = 3000  # one position a chunk: twelve blocks of chunks
    df = spark.range(n).selectExpr("0 AS seq", "id AS pos", "CAST(id % 7 - 3 AS double) AS x", "CAST(id % 5 AS double) AS v")
    got = {r["pos"]: r["y"] for r in reverse_scan(df, "seq", "pos", F.col("x"), decay, "y", F.col("v"), 0.5, chunk=1).collect()}
    y = v = 0.0
    for i in reversed(range(n)):
        y, v = (i % 7 - 3) + 0.5 * v - i % 5 + decay * y, i % 5
        assert abs(got[i] - y) < 1e-6 * max(1.0, abs(y))
    assert len(got) == n


def test_no_window_over_the_whole_table(spark):
    df = spark.range(1000).withColumnRenamed("id", "seq_id")
    plan = micro_batches(df, 8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
