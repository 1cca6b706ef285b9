"""Operators on workers that do not have the packages; data that the stages keep."""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factfeed.llm import decontamination, noisy_channel, passages

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {root!r})
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as entry
for name in {names!r}:
    assert entry.queries()[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_workers_need_no_package(tmp_path, sf):
    """The driver finds the packages by sys.path alone, which workers do not share."""
    names = ["op1_packing", "op5_toxicity", "op9_language", "op10_interpolation", "op12_resampling", "op13_filter_audit"]
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(SCRIPT.format(root=str(ROOT), names=names, sf=sf)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def prose(i, n=80):
    return " ".join(f"w{(i * 7919 + j * j * 31 + j) % 100003}" for j in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    """Ids null and repeated, columns named like statistics, with blanks and dots."""
    shared = prose(999, 60)
    rows = [(i, prose(i) + (" " + shared if i in (3, 4) else ""), -7, i, "a", "b", i, i) for i in range(12)]
    rows += [(None, prose(100), -7, 100, "a", "b", 1, 1), (None, prose(101) + " " + prose(5000, 12), -7, 101, "a", "b", 1, 1)]
    rows += [(5, prose(200), -7, 200, "x", "y", 2, 2), (6, prose(6), -7, 6, "a", "b", 6, 6)]
    names = "doc_id long, text string, n_words int, _id int, `my col` string, `a.b` string, _spans int, _q_text int"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, prose(5000, 12))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_keep_every_column_as_it_is(spark, clashing, folder):
    rows = Counter_of(clashing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, clashing, folder)
        assert left.columns == clashing.columns, name
        got = Counter_of(left)
        if name == "shared passages":  # texts change there, nothing else
            assert {r[2:] for r in got} <= {r[2:] for r in rows}
        else:
            assert not got - rows, name
        ids = {r[3] for r in got}
        gone = {"decontamination": {101}}.get(name, set())
        assert ids == {r[3] for r in rows} - gone, name
        # of two equal rows the near-duplicate stage keeps one
        assert sum(got.values()) == sum(rows.values()) - len(gone) - (name == "near-duplicates")
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, folder).count() > 0


def Counter_of(df):
    from collections import Counter

    return Counter(tuple(r) for r in df.collect())


def test_rows_without_hits(spark, clashing):
    items = spark.createDataFrame([(1, prose(5000, 12)), (2, None)], "item_id long, text string")
    left = decontamination.without_hits(clashing, items)
    assert left.columns == clashing.columns and left.where("_id = 101").count() == 0
    assert left.count() == clashing.count() - 1
    assert decontamination.without_hits(clashing, items.limit(0)).count() == clashing.count()
    assert decontamination.without_hits(clashing.limit(0), items).count() == 0


def test_fewest_rows_cover_the_same_words():
    import random

    rng = random.Random(3)
    for _ in range(300):
        rows = []
        for doc in range(3):
            spans = [(rng.randint(0, 60), rng.randint(1, 15)) for _ in range(rng.randint(1, 12))]
            rows += [(doc, 0, a, n) for a, n in spans]
        rows.sort(key=lambda r: (r[0], r[2], -r[3]))
        cover = passages.Cover()
        got = [x for r in rows for x in cover.take(r)] + cover.end()
        for doc in range(3):
            words = lambda rs, doc=doc: {w for d, _, a, n in rs if d == doc for w in range(a, a + n)}
            assert words(got) == words(rows)
            held = [r for r in got if r[0] == doc]
            # no word is in more than two of them, so there are at most twice as many as needed
            assert all(sum(a <= w < a + n for _, _, a, n in held) <= 2 for w in words(held))


def test_a_word_pair_repeated_gives_few_rows(spark):
    rng = [prose(i, 40) for i in range(6)]
    texts = [(i, f"{rng[i]} {'ab cd ' * (150 + i)} {rng[5 - i]}") for i in range(6)]
    found = passages.shared_passages(spark.createDataFrame(texts, "doc_id long, text string"))
    per = found.groupBy("doc_id").count().collect()
    assert {r.doc_id for r in per} == {1, 2, 3, 4, 5} and max(r["count"] for r in per) <= 10


def test_rows_of_a_document_do_not_grow_with_its_partners(spark):
    """Near copies whose ends differ: few rows a document, however many partners."""
    base = prose(1, 300).split()
    texts = []
    for i in range(200):
        own = list(base)
        for j in range(6):
            own[(i * 37 + j * 53) % 300] = f"x{i}_{j}"
        texts.append((i, " ".join(own[i % 7 : 300 - i % 5])))
    found = passages.shared_passages(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    per = found.groupBy("doc_id").count()
    assert per.agg(F.max("count")).first()[0] <= 300 // passages.MIN_WORDS and per.count() == 199
    long = found.withColumn("end", F.col("start_word") + F.col("n_words")).groupBy("doc_id").agg(F.min("start_word").alias("a"), F.max("end").alias("b"))
    assert long.where("b - a < 270").count() == 0


def brute_path(reader, raw):
    """All paths through the lattice."""
    best = None
    paths = [(0.0, "", 0, 0)]
    for ways in [*reader._lattice(raw), [("\0", 0.0)]]:
        new = []
        for cost, text, a, b in paths:
            for emitted, price in ways:
                x, y, total = a, b, cost + price
                for c in emitted:
                    z = 0 if c == "\0" else reader.code.get(c, reader.other)
                    total -= reader.trigrams[x][y][z]
                    x, y = y, z
                new.append((total, text + emitted, x, y))
        paths = new
    best = min(p[0] for p in paths)
    return best, {p[1].rstrip("\0") for p in paths if p[0] <= best + 1e-6}


def test_viterbi_against_all_paths():
    import random

    import numpy as np

    rng = random.Random(8)
    np_rng = np.random.default_rng(8)
    reader = noisy_channel.Reader("abcdefghilmnopst", np.log(np_rng.dirichlet(np.ones(64), 64 * 64)).astype(np.float32).ravel())
    for _ in range(150):
        raw = "".join(rng.choice("abeil01345$*!|@s") for _ in range(rng.randint(2, 6)))
        assert reader._viterbi(raw) in brute_path(reader, raw)[1], raw
    assert reader._viterbi("a" + "*#" * 40 + "b")  # many states, none is cut
