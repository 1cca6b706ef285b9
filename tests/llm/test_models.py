"""The models of op4, op5 and op9 against plain loops."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factfeed.llm import language, noisy_channel, quality_rules
from factfeed.llm.noisy_channel import ALPHABET


def _cost(reader, emitted):
    x, y, total = 0, 0, 0.0
    for c in "".join(emitted) + "\0":
        z = 0 if c == "\0" else reader.code.get(c, reader.other)
        total -= reader.trigrams[x][y][z]
        x, y = y, z
    return total


def test_viterbi_against_all_paths():
    rng = random.Random(3)
    letters = "abegilost"
    raws = ["".join(rng.choice(["s", "t", "e", "3", "1", "@", "$", "*", "!", "oo", "lll", "7"]) for _ in range(rng.randint(2, 6))) for _ in range(150)]
    raws += ["b e s t", "l-i-e-s", "g.o.a.t", "t * e * s"]
    for n, raw in enumerate(raws):
        rows = np.random.default_rng(n).dirichlet(np.full(ALPHABET, 0.2), ALPHABET * ALPHABET) + 1e-6
        reader = noisy_channel.Reader(letters, np.log(rows).ravel())
        paths = itertools.product(*reader._lattice(raw))
        costs = defaultdict(lambda: math.inf)  # by restored text
        for path in paths:
            text = "".join(e for e, _ in path)
            costs[text] = min(costs[text], _cost(reader, [e for e, _ in path]) + sum(p for _, p in path))
        assert costs[reader._viterbi(raw)] == pytest.approx(min(costs.values())), raw


def test_character_model_counts_all_training_texts(spark, odd, odd_rows):
    known = noisy_channel._letters()
    codes = np.full(0x110000, ALPHABET - 1, np.int64)
    for i, c in enumerate("abcdefgh"):
        codes[ord(c)] = i + 1
    texts = [r[1] or "" for r in odd_rows] + ["aaa b", "aab  b1c d_e", "²x É", "xyyyz", "1 2"]
    for value in [*texts, "  ".join(texts)]:
        runs = [w for w in noisy_channel.WORD.findall(value.lower()) if not re.search(r"(.)\1\1", w)]
        want = [codes[ord(c)] if c != " " else 0 for c in "  " + "".join(r + "  " for r in runs)]
        got = noisy_channel.trigram_line(noisy_channel._joined([value]), known, codes)
        assert got.tolist() == want
    # one labelled row; the letters come from every text
    docs = spark.createDataFrame([(1, "abc abd"), (2, "xyz xyz"), (2, "xyz xyz"), (None, "qqr"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert noisy_channel.fit(docs, labels).letters == "abcdqrxyz"


def test_only_near_copies_count_once(spark):
    """Documents that share a passage are all kept, copies of a document are not."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(15)]
    rows, want = [], set()
    for i in range(40):
        own = [f"o{i}x{j}" for j in range(60)]
        rows.append((i, " ".join(own[:30] + passage + own[30:])))
        want.add(rows[-1][1])
    rows += [(100 + i, rows[i][1]) for i in range(10)]  # exact copies
    for i in range(10):  # one word changed at the end
        rows.append((200 + i, rows[i][1].rsplit(" ", 1)[0] + f" n{i}"))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    got = [r.text for r in noisy_channel._sample(docs, labels).collect()]
    assert set(want) <= set(got) and len(got) == len(set(got)) <= len(want) + 5


def test_scores_against_plain_evidence(spark, odd, odd_rows):
    """Repeated rows and very long texts are scored like any other."""
    words = Counter(w for r in odd_rows for w in re.findall("[a-h]+", (r[1] or "").lower()))
    entries = {w: 0.1 + 0.8 * (i % 7) / 7 for i, w in enumerate(sorted(words)[::5])} | {"=abc": 0.5, "abcd": 0.9}
    model = noisy_channel.Model("", np.empty(0), entries)
    got = Counter((r.doc_id, round(r.score, 9)) for r in noisy_channel.score(odd, model).collect())
    want = Counter()
    for r in odd_rows:
        rest = 1 - noisy_channel.FLOOR
        for w in set(noisy_channel.WORD.findall((r[1] or "").lower())):
            rest *= 1 - max([entries.get(f, 0) for f in [f"={w}", *[w[:n] for n in range(4, min(len(w), 7) + 1)]]])
        want[r[0], round(1 - rest, 9)] += 1
    assert got == want


def _grams(text, bits, longest):
    chars = [ord(c) if c.isalpha() else language.BLANK for c in (text or "").lower()]
    for n in range(1, longest + 1):
        for i in range(len(chars) - n + 1):
            h = 2166136261 + n
            for c in chars[i : i + n]:
                h = (h ^ c) * 16777619 % 2**32
            yield n, ((h ^ h >> 15) & (1 << bits) - 1) + ((n - 1) << bits)


def test_language_against_naive_bayes_in_loops(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcde ." if i % 3 else "cdefg 1") for _ in range(rng.randint(0, 60))), "xyz"[i % 3]) for i in range(60)]
    rows += [(60, None, "x"), (61, "abc", None), (62, "12 34", "y"), (62, "12 34", "y"), (None, "fed", "z"), (63, "Ab" * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    bits, longest, smooth = 8, 3, 0.5
    model = language.train(docs, F.col("lang"), bits, longest, smooth)
    counts, n_docs = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        if lang:
            n_docs[lang] += 1
            counts[lang].update(b for _, b in _grams(text, bits, longest))
    whole = {(g, n): sum(c for b, c in counts[g].items() if b >> bits == n - 1) + smooth * (1 << bits) for g in n_docs for n in range(1, longest + 1)}
    got = defaultdict(list)
    for r in language.predict(docs, model).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert set(got[i]) == {("und", 0.0)}
            continue
        logs = {g: math.log((n_docs[g] + 1) / (sum(n_docs.values()) + len(n_docs))) for g in sorted(n_docs)}
        for n, b in _grams(text, bits, longest):
            for g in logs:
                logs[g] += math.log((counts[g][b] + smooth) / whole[g, n])
        best = max(logs, key=logs.get)
        share = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert got[i][0][0] == best and got[i][0][1] == pytest.approx(share, rel=1e-3), i


def test_language_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "abc", "q"), (2, "abc", "p"), (3, "abc", None)], "doc_id long, text string, lang string")
    got = language.predict(docs, language.train(docs, F.col("lang"))).collect()
    assert {(r.lang_pred, round(r.score, 6)) for r in got} == {("p", 0.5)}


def test_kept_is_what_the_rules_say(spark):
    """The learned rules applied in plain Python, and the first threshold against all thresholds."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [f"w{i}x{j}" + ("%$" if bad and rng.random() < 0.5 else "") for j in range(rng.randint(8, 60))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad) if i % 50 else None))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality_rules.learn(docs, labels)
    assert rules
    stats = {r.doc_id: r for r in quality_rules.statistics(docs).collect()}
    for r in quality_rules.judge(docs, labels).collect():
        s = stats[r.doc_id]
        failed = s.n_words < 10 or 100 * s.n_repeat_words > 20 * s.n_words
        rejected = any(all((s[c.name] > c.threshold) == c.above for c in rule) for rule in rules)
        assert (r.base_failed, r.kept) == (failed, not failed and not rejected)
    names = [*quality_rules.SHARES, "n_words"]
    table = quality_rules.statistics(docs).where("n_words >= 10").join(labels.where("quality is not null"), "doc_id")
    table = table.select((1 - F.col("quality")).cast("int").alias("reject"), *names).cache()
    cuts = quality_rules._cuts(table, names)
    first = quality_rules._grown(table, names, cuts)[0]
    held = table.collect()

    def gain(name, above, cut):
        inside = [r.reject for r in held if (r[name] > cut) == above]
        p, p0 = sum(inside), sum(r.reject for r in held)
        return p * (math.log2(p / len(inside)) - math.log2(p0 / len(held))) if p else 0.0

    best = max(gain(n, a, c) for n in names for a in (False, True) for c in cuts[n])
    assert gain(*first) == pytest.approx(best)
