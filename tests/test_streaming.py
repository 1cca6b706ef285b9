from __future__ import annotations

import random

from pyspark.sql import functions as F

from factfeed.operators.annotation import STATEMENT_KEYS, pair_labels
from factfeed.session import fresh_path
from factfeed.streaming.label_merge import ARRIVAL, missed_pairs, pair_stream, read_arrivals, write_pairs


def arrivals(spark, n=60, gap=0):
    rows = [
        (i % 7, f"s{i % 5}", f"x{i}", task, label, 1000 + 10 * i + (gap if task == "assess" else 0))
        for i in range(n)
        for task, label in (("verify", "Correct"), ("assess", str(1 + i % 5)))
    ]
    random.Random(4).shuffle(rows)
    schema = ARRIVAL.replace("done_at timestamp", "done_at long")
    return spark.createDataFrame(rows, schema).withColumn("done_at", F.timestamp_seconds("done_at"))


def run(spark, df, files=8, per_batch=1, **kwargs):
    source, out = fresh_path(spark, "arrivals"), fresh_path(spark, "pairs")
    df.repartition(files).write.parquet(source)
    write_pairs(pair_stream(read_arrivals(spark, source, per_batch), **kwargs), out, fresh_path(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).select(*STATEMENT_KEYS, "verify", "assess")


def test_stream_equals_batch_in_any_order(spark):
    df = arrivals(spark)
    want = pair_labels(df.select(*STATEMENT_KEYS, "task", "label"))
    for files, per_batch in ((8, 1), (1, 1), (5, 2)):
        got = run(spark, df, files, per_batch)
        assert got.count() == 60
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_labels_too_far_apart_are_not_paired(spark):
    assert run(spark, arrivals(spark, gap=7200), wait="1 hour", late="3 hours").isEmpty()
    assert run(spark, arrivals(spark, gap=1800), wait="1 hour", late="3 hours").count() == 60


def test_missed_pairs_complete_the_stream(spark):
    far, soon = arrivals(spark, gap=7200), arrivals(spark, n=200, gap=5)
    for df, files in ((far, 8), (soon, 40)):
        found = run(spark, df, files, wait="10 minutes", late="1 second")
        want = pair_labels(df.select(*STATEMENT_KEYS, "task", "label"))
        assert found.count() < want.count()
        got = found.unionByName(missed_pairs(df, found))
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
