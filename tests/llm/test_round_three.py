"""Content sort, resampling and the filter audit against brute force and SQL."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from factfeed.llm import content_sort, filter_audit, oracles, queries, resampling
from tools.compare import connect, rows_of

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
SPACED = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counted(rows):
    return Counter(tuple(r) for r in rows)


def wanted_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWER)].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out[(i, keep, len(ids), kept, sha(text))] += 1
    return out


@pytest.mark.parametrize("range_bytes", [64 << 20, 2_000])
def test_content_sort_on_odd_rows(odd, odd_rows, empty, range_bytes):
    got = content_sort.exact_duplicates(odd, range_bytes)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert counted(got.collect()) == wanted_groups([r[:2] for r in odd_rows])
    assert content_sort.exact_duplicates(empty).count() == 0


def test_content_sort_deals_a_hot_text_in_runs(spark, monkeypatch):
    """A third of all rows is one text, another part differs in its last letter only."""
    rng = random.Random(3)
    head = "h" * 100
    texts = [head + "A"] * 400 + [head + "a"] * 100 + [head + "b"] * 60 + [head + str(i) for i in range(400)] + [None, ""] * 50
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, head + "a")] * 3 + [(499, head + "a")] * 2
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    written = {}
    keep = content_sort.materialize
    monkeypatch.setattr(content_sort, "materialize", lambda d, name: written.setdefault(name, keep(d, name)))
    got = content_sort.exact_duplicates(df, 1_000)
    assert counted(got.collect()) == wanted_groups(rows)
    assert written["hot-texts"].agg(F.max("runs")).first()[0] > 10
    assert written["runs"].where("run > 0").groupBy("run").count().count() > 10


def test_content_sort_shuffles_texts_once_and_stays_native(odd):
    plan = content_sort.exact_duplicates(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def wanted_draw(rows, target, percent, seed, least, buckets=10_000):
    def features(text):
        w = PLAIN.findall((text or "").translate(LOWER))
        return len(w), [crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    source = Counter(b for _, t in rows for b in features(t)[1])
    aim = Counter(b for t in target for b in features(t)[1])
    s_all, t_all = sum(source.values()), sum(aim.values())
    scored = []
    for i, text in rows:
        n, found = features(text)
        gains = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((n >= least, i, len(found), weight, score))
    order = sorted((r for r in scored if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    drawn = percent * len(order) // 100
    return [(*r[1:], k if k <= drawn else None) for k, r in enumerate(order, 1)] + [(*r[1:], None) for r in scored if not r[0]]


@pytest.mark.parametrize(("segments", "percent"), [(None, 25), (1, 100), (13, 60)])
def test_resampling_against_brute_force(spark, odd, odd_rows, empty, monkeypatch, segments, percent):
    monkeypatch.setattr(resampling, "RUN_ROWS", 7)
    target = [odd_rows[9][1], None, "", odd_rows[4][1]]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(odd, aim, percent=percent, segments=segments)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert counted(got.collect()) == counted(wanted_draw([r[:2] for r in odd_rows], target, percent, 7, 20))


def test_resampling_of_empty_tables(odd, odd_rows, empty):
    aim = empty.select("doc_id", "text")
    assert resampling.resample(empty, odd).count() == 0
    want = wanted_draw([r[:2] for r in odd_rows], [], 25, 7, 20)
    assert counted(resampling.resample(odd, aim).collect()) == counted(want)


def test_segments_hold_even_shares_of_ties(spark):
    """Equal scores and ids are cut where a splitter falls; ranks stay exact."""
    n = 6_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("w " * 25).alias("text")
    )
    gains = np.zeros(10_000, np.int64)
    runs = resampling.materialize(resampling.sorted_runs(df.repartition(6), gains, 7, 20, 20), "runs")
    numbered, sizes = resampling.ranked_by_key(runs, 8)
    assert sum(sizes) == n and max(sizes) < 2 * n / 8
    rows = [(r.segment, r.place, r.score, r.doc_id) for r in numbered.collect()]
    order = [(-s, d) for _, _, s, d in sorted(rows)]
    assert order == sorted(order)


def wanted_audit(rows, good, toxic):
    first, masks = {}, []
    for i, text, lang in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, lang in rows:
        t = text or ""
        w = SPACED.findall(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        masks.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                fails = [m for m in own if letter in m[1]]
                redundant = len(fails) - len(gone)
                left = [m for m in left if letter not in m[1]]
                alone = sum(m[1] == {letter} for m in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(m[2] for m in gone), sum(m[3] for m in gone)]
        share = Counter()
        for (p, order, step), v in out.items():
            if p == part:
                share[order[step - 1]] += v[1]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_against_every_order(spark, odd, odd_rows, empty):
    marks = [(4, 1, 0), (5, 1, 1), (5, 0, 0), (8, None, 1), (6, 1, None), (None, 1, 1), (20, 1, 0), (20, 1, 0), (999, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    good, toxic = {4, 5, 6, 20}, {5, 8}
    rows = [(*r[:3],) for r in odd_rows] + [(100, odd_rows[4][1], None), (101, odd_rows[4][1], "en"), (102, "AB#" * 200, "")]
    extra = spark.createDataFrame([r for r in rows[-3:]], "doc_id long, text string, lang string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    got = filter_audit.audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == wanted_audit(rows, good, toxic)
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(odd, labels.limit(0)).agg(F.max("good_lost")).first()[0] == 0


def test_intervals_are_the_orders_that_remove_a_mask():
    orders = list(itertools.permutations(range(5)))
    for mask in range(32):
        covered = {(rank, step) for step, lo, hi in filter_audit.removal_intervals(mask) for rank in range(lo, hi)}
        want = {(r, min(s for s in range(5) if mask >> o[s] & 1)) for r, o in enumerate(orders) if mask}
        assert covered == want


@pytest.mark.parametrize("name", ["op11_content_sort", "op12_resampling", "op13_filter_audit"])
def test_query_equals_its_sql(spark, sf, name):
    con = connect(sf)
    df = queries.QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(oracles.ORACLES[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
