"""Padded and packed experience against loops over single sequences."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from factfeed.config import ExperienceConfig
from factfeed.operators import experience as ex
from factfeed.plans.experience import packed_job, padded_job

PAD, EOS = 0, 9
SCHEMA = "seq_id long, prompt_ids array<int>, output_ids array<int>, rewards array<double>, logp array<double>, ref_logp array<double>, value array<double>"


def made(n=11, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randint(1, 7)
        out = [rng.randint(1, 9) for _ in range(size)]
        draw = lambda lo, hi: [round(rng.uniform(lo, hi), 3) for _ in range(size)]  # noqa: B023, E731
        rows.append((i, [rng.randint(1, 8) for _ in range(rng.randint(1, 5))], out, draw(-3, 3), draw(-2, 0), draw(-2, 0), draw(-1, 1)))
    return rows


def recurrence(reward, value, gamma, lambd, estimator):
    n, adv, run = len(reward), [0.0] * len(reward), 0.0
    for t in reversed(range(n)):
        if estimator == "gae":
            after = value[t + 1] if t + 1 < n else 0.0
            run = reward[t] + gamma * after - value[t] + gamma * lambd * run
        else:
            run = reward[t] + gamma * run
        adv[t] = run
    returns = [a + v for a, v in zip(adv, value, strict=True)] if estimator == "gae" else adv
    return adv, returns


def shaped(rewards, logp, ref, mask, c):
    out = []
    for r, a, b, m in zip(rewards, logp, ref, mask, strict=True):
        x = (a - b) * m
        out.append((min(max(r, c.clip[0]), c.clip[1]) - c.kl_coef * (math.exp(x) - 1 - x), math.exp(x) - 1 - x))
    return out


def normal(values, masks, eps):
    own = [v for v, m in zip(values, masks, strict=True) if m]
    mean = sum(own) / len(own)
    var = sum((v - mean) ** 2 for v in own) / len(own)
    return [(v - mean) / math.sqrt(var + eps) for v in values]


@pytest.mark.parametrize("estimator", ["gae", "reinforce"])
def test_packed_job_scans_each_sequence_alone(spark, estimator):
    c = ExperienceConfig(batch_size=3, clip=(-1.0, 1.0), gamma=0.8, lambd=0.9, estimator=estimator)
    rows = made()
    df = spark.createDataFrame([*rows, (50, [1, 2], [], [], [], [], [])], SCHEMA)
    job = packed_job(df, c)
    got = {(r.seq_id, r.tok_no): r for r in ex.packed_tokens(job).collect()}
    keys, adv, ret = [], [], []
    for i, _, out, reward, logp, ref, value in rows:
        s = shaped(reward, logp, ref, [1] * len(out), c)
        a, g = recurrence([x for x, _ in s], value, c.gamma, c.lambd, estimator)
        keys += [(i, t, *s[t]) for t in range(len(out))]
        adv += a
        ret += g
    assert len(got) == len(keys)
    for (i, t, reward, kl), a, g in zip(keys, normal(adv, [1] * len(adv), c.eps), ret, strict=True):
        r = got[i, t]
        assert [r.shaped, r.kl, r.advantage, r["return"]] == pytest.approx([reward, kl, a, g], abs=1e-6)
    assert job.count() == 4 and all(len(r["kl"]) == len(r["return"]) for r in job.collect())
    info = {r.seq_id: r for r in job.select(F.inline("info")).collect()}
    assert (info[50].response_length, info[50].total_length, info[50].kl, info[50].reward) == (1, 2, None, 0.0)
    assert info[3].total_length == len(rows[3][1]) + len(rows[3][2])


def test_padded_job_against_loops(spark):
    c = ExperienceConfig(batch_size=4, clip=(-1.0, 1.0), gamma=0.8, lambd=0.9)
    rows = made()
    tokens, totals = padded_job(spark.createDataFrame(rows, SCHEMA), PAD, EOS, c)
    got = {(r.seq_id, r.tok_no): r for r in tokens.collect()}
    info = {r.seq_id: r for r in totals.collect()}
    keys, adv, masks = [], [], []
    for at in range(0, len(rows), 4):
        batch = rows[at : at + 4]
        width = max(len(r[2]) for r in batch)
        for i, prompt, out, reward, logp, ref, value in batch:
            n, fill = len(out), lambda xs, width=width: [*xs, *[0] * (width - len(xs))]
            out, reward = fill(out), [float(x) for x in fill(reward)]
            if out[n - 1] != EOS:
                slot = min(n, width - 1)
                out[slot] = EOS
                reward[slot] -= 1
            mask = [int(t == 0 or out[t - 1] not in (PAD, EOS)) for t in range(width)]
            s = shaped(reward, fill(logp), fill(ref), mask, c)
            a, _ = recurrence([x * m for (x, _), m in zip(s, mask, strict=True)], [v * m for v, m in zip(fill(value), mask, strict=True)], c.gamma, c.lambd, "gae")
            keys += [(i, t) for t in range(width)]
            adv += a
            masks += mask
            assert info[i].response_length == sum(mask) and info[i].reward == pytest.approx(sum(reward))
            real = [k for k, x in enumerate(prompt + out) if x not in (PAD, EOS)]
            assert info[i].total_length == min(real[-1] + 1, len(prompt + out) - 1) - real[0] + 1
    want = normal(adv, masks, c.eps)
    assert {k: pytest.approx(v, abs=1e-6) for k, v in zip(keys, want, strict=True)} == {k: r.advantage for k, r in got.items()}


def test_masks_by_hand(spark):
    rows = [
        (0, 0, [5], [6, EOS, 7, 8], [0.0] * 4),  # an end token in the middle
        (0, 1, [5, 5], [6], [0.0]),
        (0, 2, [PAD], [PAD, PAD], [0.0] * 2),
    ]
    df = spark.createDataFrame(rows, "batch_id long, pos int, prompt_ids array<int>, output_ids array<int>, rewards array<double>")
    got = {r.pos: r for r in ex.padded_samples(df, PAD, EOS).collect()}
    assert got[0].sequence == [PAD, 5, 6, EOS, 7, EOS] and got[0].attention_mask == [0, 1, 1, 1, 1, 1]
    assert got[0].action_mask == [1, 1, 0, 1] and got[0].rewards == [0, 0, 0, -1]
    assert got[1].sequence == [5, 5, 6, EOS, PAD, PAD] and got[1].attention_mask == [1, 1, 1, 1, 0, 0]
    assert got[1].action_mask == [1, 1, 0, 0] and (got[1].total_length, got[1].response_length) == (4, 2)
    assert got[2].total_length == 0 and got[2].action_mask[0] == 1
