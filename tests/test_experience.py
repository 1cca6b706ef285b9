from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from factfeed.operators import experience as ex

ROWS = "seq_id long, tok_no long, shaped double, value double, mask int"


def world(seed=1):
    rng = random.Random(seed)
    return [
        (s, t, float(rng.randint(-3, 3)), rng.random(), int(rng.random() > 0.2))
        for s, n in enumerate([1, 2, 7, 40, 100])
        for t in range(n)
    ]


def by_seq(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: r[1]) for k, v in out.items()}


def brute_gae(rows, gamma, lambd):
    out = {}
    for s, seq in by_seq(rows).items():
        adv, nxt = 0.0, 0.0
        for _, t, r, v, m in reversed(seq):
            adv = r * m + gamma * nxt - v * m + gamma * lambd * adv
            nxt = v * m
            out[s, t] = (adv, adv + v * m)
    return out


@pytest.mark.parametrize("chunk", [256, 8, 1])
@pytest.mark.parametrize(("gamma", "lambd"), [(1.0, 1.0), (0.9, 0.95), (0.5, 0.0), (0.0, 0.9)])
def test_gae_against_loop(spark, chunk, gamma, lambd):
    rows = world()
    got = ex.gae(spark.createDataFrame(rows, ROWS), gamma, lambd, chunk=chunk).collect()
    want = brute_gae(rows, gamma, lambd)
    assert len(got) == len(want)
    for r in got:
        a, g = want[r["seq_id"], r["tok_no"]]
        assert r["advantage"] == pytest.approx(a, abs=1e-9)
        assert r["return"] == pytest.approx(g, abs=1e-9)


def test_gae_without_decay_is_suffix_sum_minus_value(spark):
    rows = [(s, t, r, v, 1) for s, t, r, v, _ in world(2)]
    got = ex.gae(spark.createDataFrame(rows, ROWS), 1.0, 1.0, chunk=16).collect()
    seqs = by_seq(rows)
    for r in got:
        seq = seqs[r["seq_id"]]
        t = r["tok_no"]
        assert r["advantage"] == pytest.approx(sum(x[2] for x in seq[t:]) - seq[t][3], abs=1e-9)


@pytest.mark.parametrize("chunk", [256, 7])
def test_returns_against_loop(spark, chunk):
    rows = world(3)
    got = ex.cumulative_returns(spark.createDataFrame(rows, ROWS), 0.8, chunk=chunk).collect()
    want = {}
    for s, seq in by_seq(rows).items():
        g = 0.0
        for _, t, r, _, m in reversed(seq):
            g = r * m + 0.8 * g
            want[s, t] = g
    assert {(r["seq_id"], r["tok_no"]) for r in got} == set(want)
    for r in got:
        assert r["return"] == pytest.approx(want[r["seq_id"], r["tok_no"]], abs=1e-9) == r["advantage"]


BATCH = "batch_id long, pos int, prompt_ids array<int>, output_ids array<int>, rewards array<double>"
PAD, EOS = 0, 9


def batch(spark):
    rows = [
        (0, 0, [1], [5, 9], [1.0, 2.0]),  # ends properly, shorter than the batch
        (0, 1, [1, 2, 3], [5, 6, 7, 8], [1.0, 1.0, 1.0, 1.0]),  # fills the width without the end token
        (0, 2, [1, 2], [5], [3.0]),  # short, without the end token
        (1, 0, [4], [9], [0.0]),
    ]
    return spark.createDataFrame(rows, BATCH)


def test_padded(spark):
    got = {(r["batch_id"], r["pos"]): r for r in ex.padded_samples(batch(spark), PAD, EOS).collect()}
    assert got[0, 0]["sequence"] == [0, 0, 1, 5, 9, 0, 0] and got[0, 0]["rewards"] == [1.0, 2.0, 0.0, 0.0]
    assert got[0, 1]["sequence"] == [1, 2, 3, 5, 6, 7, 9] and got[0, 1]["rewards"] == [1.0, 1.0, 1.0, 0.0]
    assert got[0, 2]["sequence"] == [0, 1, 2, 5, 9, 0, 0] and got[0, 2]["rewards"] == [3.0, -1.0, 0.0, 0.0]
    assert got[1, 0]["sequence"] == [4, 9] and got[1, 0]["rewards"] == [0.0]


def test_packed(spark):
    rows = batch(spark).unionByName(spark.createDataFrame([(1, 1, [3], [], [])], BATCH))
    got = {r["batch_id"]: r for r in ex.packed_samples(rows).collect()}
    assert got[0]["sequence"] == [1, 5, 9, 1, 2, 3, 5, 6, 7, 8, 1, 2, 5]
    assert got[0]["segments"] == [1] * 3 + [2] * 7 + [3] * 3
    assert got[0]["seq_lens"] == [3, 7, 3] and got[0]["num_actions"] == [2, 4, 1]
    assert got[0]["rewards"] == [1.0, 2.0, 1.0, 1.0, 1.0, 1.0, 3.0]
    assert got[1]["num_actions"] == [1, 1] and got[1]["seq_lens"] == [2, 1]


def test_kl_and_reward(spark):
    df = spark.createDataFrame([(-1.0, -3.0, 1, 5.0), (-1.0, -3.0, 0, -5.0)], "a double, b double, m int, r double")
    kl = ex.approx_kl(F.col("a"), F.col("b"), F.col("m"))
    k3 = ex.approx_kl(F.col("a"), F.col("b"), F.col("m"), k3=True)
    got = df.select(
        kl.alias("kl"),
        k3.alias("k3"),
        ex.shaped_reward(F.col("r"), kl, 0.1, (-2, 2)).alias("s"),
        ex.shaped_reward(F.col("r"), kl, -0.1).alias("t"),
    ).collect()
    assert [r["kl"] for r in got] == [2.0, 0.0]
    assert [r["k3"] for r in got] == pytest.approx([math.exp(2) - 3, 0.0])
    assert [r["s"] for r in got] == pytest.approx([1.8, -2.0])
    assert [r["t"] for r in got] == [5.0, -5.0]


def test_normalized(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 1), (100.0, 0)], "advantage double, mask int")
    got = [r["advantage"] for r in ex.normalize_advantages(df).collect()]
    assert got == pytest.approx([-1.0, 1.0, 98.0], abs=1e-6)


def test_prompt_batches(spark):
    rows = [(i, f"q{i}", [str(i)], ["m"], None) for i in range(23)]
    df = spark.createDataFrame(
        rows, "qid long, question string, titles array<string>, materials array<string>, extra_materials array<string>"
    )
    got = ex.prompt_batches(df, 20, 8, seed=1).orderBy("batch_id").collect()
    assert [len(r["qid"]) for r in got] == [8, 8, 4]
    flat = [q for r in got for q in r["qid"]]
    assert sorted(flat) == list(range(20)) and flat != sorted(flat)
    assert all(r["question"] == [f"q{q}" for q in r["qid"]] for r in got)
    again = ex.prompt_batches(df.repartition(5), 20, 8, seed=1).orderBy("batch_id").collect()
    assert [r["qid"] for r in again] == [r["qid"] for r in got]
