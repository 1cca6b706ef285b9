"""Operators against brute force, on rows with nulls, ties, copies and odd texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factfeed.llm import (
    components,
    decontamination,
    interpolation,
    language,
    lsh_forest,
    main_text,
    noisy_channel,
    packing,
    passages,
    quality_rules,
    queries,
    token_counts,
)

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def test_packing_covers_every_token_once(odd, odd_rows, empty):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(
        (r[0], np.array(lib.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in odd_rows
    )
    rows = packing.pack(odd.coalesce(1), block_tokens=30_000).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two
    got, parts = Counter(), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
    for doc, pieces in parts.items():
        pieces.sort(key=lambda p: p.start)
        now = b""
        for p in [p for p in pieces if sum(x.start == p.start for x in pieces) == 1] if doc != 6 else []:
            now += p.ids
        if doc != 6:  # the repeated row has two pieces from each start
            got[(doc, now)] += 1
    assert got == Counter({k: n for k, n in want.items() if k[0] != 6})
    assert sum(p.length for p in parts[6]) == 2 * parts[6][0].doc_tokens
    assert packing.pack(empty).count() == 0


def test_least_squares_finds_an_exact_mix():
    a = packing.combinations(8, 3)
    x = np.zeros(len(a))
    x[[0, 3]] = 5, 2
    assert np.abs(packing.nnls(a, x @ a, 3000) @ a - x @ a).max() < 0.05


def test_token_counts_as_the_library(odd, odd_rows, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(lib.encode(r[1] or ""))) for r in odd_rows)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd).collect())
    assert got == want
    assert token_counts.count_tokens(empty).count() == 0


def test_decontamination_against_word_windows(spark, odd, odd_rows, empty):
    rng_text = odd_rows[20][1]
    items = [(1, " ".join(rng_text.split()[3:17])), (2, "ONE"), (3, None), (4, ""), (5, rng_text.upper()), (5, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def norm(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))

    got = {(r.doc_id, r.n_words): r for r in decontamination.report(decontamination.scan(odd, bench)).collect()}
    for r in odd_rows:
        w, hit, ids = norm(r[1]), set(), set()
        for item, t in items:
            iw = norm(t)
            for i in range(max(len(iw) - 10, 0) + 1 if iw else 0):
                p = iw[i : i + 10]
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit.update(range(j, j + len(p)))
                        ids.add(item)
        found = got[(r[0], len(w))]
        assert (found.n_hit, found.n_items, found.contaminated) == (len(hit), len(ids), bool(hit)), r[0]
    assert decontamination.scan(empty, bench).count() == 0
    assert decontamination.scan(odd, bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_original_spans_point_into_the_text():
    text = "Say: The CAT -- sat, on it."
    assert [text[a:b] for a, b in decontamination.original_spans(text, [1, 3, 5, 5])] == ["The CAT -- sat", "it"]


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def test_near_duplicates_against_all_pairs(odd, odd_rows, empty):
    rows = [r for r in odd_rows if r[0] is not None]
    sets = {r[0]: shingles(r[1]) for r in rows}
    name = {k: k for k in sets}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    got = lsh_forest.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id))
    assert lsh_forest.near_duplicates(empty).count() == 0


def test_links_in_a_crowded_region(spark, monkeypatch):
    """Every text is like all others, but linked with one: neighbours alone miss links."""
    monkeypatch.setattr(lsh_forest, "BLOCK", 80)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]

    def changed(text, at, n):
        return text[:at] + [f"x{rng.integers(1 << 40)}" for _ in range(n)] + text[at + n :]

    rows = []
    for i in range(250):
        text = changed(base, int(rng.integers(0, 270)), 20)
        rows += [(i, text), (1000 + i, changed(text, int(rng.integers(0, 270)), 19))]
    sets = {i: {tuple(t[a : a + 5]) for a in range(296)} for i, t in rows}
    ids = sorted(sets)
    name = {i: i for i in ids}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                name[max(root(i), root(j))] = min(root(i), root(j))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs).collect()}
    assert len(set(got.values())) > 100
    assert got == {i: root(i) for i in ids}


def test_components_of_random_edges(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (230, 2))]
    edges += edges[:40] + [(b, a) for a, b in edges[:20]] + [(7, 7)]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    got = components.components(df).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    assert components.components(df.limit(0)).isEmpty()


def test_components_of_a_long_chain_and_a_star(spark):
    n = 300
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1, n).select(F.lit(1000).cast("long").alias("a"), (F.col("id") + 1000).alias("b"))
    got = components.components(chain.union(star).repartition(7)).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(n)}}


def test_shared_passages_are_found_and_cut(odd, odd_rows, empty):
    found = passages.shared_passages(odd).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    # every holder but the first points to an earlier one
    assert {d for d, _ in pairs} == {5, 6, 7, 9} and (9, 8) in pairs
    assert all(4 <= c < d for d, c in pairs) and {c for d, c in pairs if d < 8} <= {4, 5, 6}
    row = next(r for r in found if r.doc_id == 9)
    assert (row.start_word, row.n_words, row.other_start, row.similarity) == (0, 80, 200, 1.0)
    left = passages.without_repeats(odd, passages.shared_passages(odd))
    assert left.columns == odd.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[9] == odd_rows[9][1].split("\n")[1] and 5 not in texts
    assert texts[0] is None and texts[20] == odd_rows[20][1]
    assert passages.shared_passages(empty).count() == 0


def test_chaining_against_all_predecessors():
    rng = np.random.default_rng(3)
    for _ in range(50):
        at = rng.integers(0, 60, (12, 2))
        runs = sorted({(int(i), int(i) + 5, int(j), int(j) + 5) for i, j in at})
        best = [5.0] * len(runs)
        for x, (i0, _, j0, _) in enumerate(runs):
            for y, (_, i1, _, j1) in enumerate(runs):
                if i1 <= i0 and j1 <= j0:
                    best[x] = max(best[x], best[y] + 5 - passages.GAP_COST * (i0 - i1 + j0 - j1))
        assert math.isclose(max(passages.chain_runs(runs))[0], max(best))


def test_a_fuzzy_passage_is_aligned(spark):
    a = [f"w{i}" for i in range(120)]
    b = [w if i % 13 else "other" for i, w in enumerate(a)]
    docs = spark.createDataFrame([(1, " ".join(["p"] * 3 + a)), (2, " ".join(b + ["q"] * 5))], "doc_id long, text string")
    (row,) = passages.shared_passages(docs).collect()
    assert (row.doc_id, row.other_id) == (2, 1) and row.n_words > 110 and 0.9 < row.similarity < 1


@pytest.mark.parametrize(
    ("parts", "gap_a", "gap_b"), [((60, 60), 40, 40), ((100, 60), 100, 40), ((100, 100), 100, 100), ((300, 300), 200, 200), ((300, 300), 0, 200)]
)
def test_passages_with_a_gap_between_them(spark, parts, gap_a, gap_b):
    """Two exact passages, other words between them: both are reported, and no span below 0.8."""

    def text(side, gap):
        own = [[f"{side}{part}x{i}" for i in range(n)] for part, n in enumerate((30, gap, 30))]
        return own[0] + [f"p{i}" for i in range(parts[0])] + own[1] + [f"q{i}" for i in range(parts[1])] + own[2]

    a, b = text("a", gap_a), text("b", gap_b)
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    got = sorted((r.start_word, r.n_words, r.other_start, r.similarity) for r in passages.shared_passages(docs).collect())
    assert got == [(30, parts[0], 30, 1.0), (30 + parts[0] + gap_b, parts[1], 30 + parts[0] + gap_a, 1.0)]


def test_passing_spans_against_all_spans():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n, gaps = rng.integers(1, 40, 8), rng.integers(0, 30, (8, 2))
        gaps[:, 0] += gaps.sum(axis=1) == 0
        begin = np.cumsum(gaps, axis=0) + np.concatenate([[0], np.cumsum(n)[:-1]])[:, None]
        blocks = np.column_stack([begin, n])
        want = set()
        for p in range(8):
            for q in range(p, 8):
                size = begin[q] + n[q] - begin[p]
                if size.min() >= 50 and n[p : q + 1].sum() >= 0.8 * size.max():
                    want.add((begin[p, 0], begin[q, 0] + n[q]))
        got = {(a, b) for a, b, *_ in passages.passing(blocks, 50, 0.8)}
        assert got <= want and bool(got) == bool(want)
        assert all(any(a < y and x < b for x, y in got) for a, b in want)  # each span that passes meets a row


def test_a_loose_chain_does_not_hide_an_exact_copy(spark):
    """The longer chain to the first document fails; the copy inside its span is reported."""
    one = [f"w{i}" for i in range(200)]
    two = [w if i % 20 < 15 else f"y{i}" for i, w in enumerate(one)]  # 75% the same
    copied = ["l1", "l2"] + two[55:150] + ["r1", "r2"]
    a = [f"a{i}" for i in range(160)]
    b = [f"b{i}" for i in range(60)]
    in_gap = a[:60] + ["g1"] + b + ["g2"] + a[122:]  # the first chain's gap holds 60 words of another document
    rows = [(1, one), (2, two), (3, copied), (4, a), (5, ["h"] * 3 + b + ["t"] * 3), (6, in_gap)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = {(r.doc_id, r.other_id, r.start_word, r.n_words, r.similarity) for r in passages.shared_passages(docs).collect()}
    assert (3, 2, 2, 95, 1.0) in got
    assert {(6, 4, 0, 60, 1.0), (6, 5, 61, 60, 1.0)} <= got


@pytest.mark.parametrize(("partitions", "block"), [(1, 1_000_000), (5, 1_000_000), (3, 200)])
def test_passages_whose_parts_others_hold(spark, monkeypatch, partitions, block):
    """Mosaics: earlier documents hold parts of a passage, two later ones hold all of it."""
    monkeypatch.setattr(passages, "BLOCK_WORDS", block)
    rng = random.Random(11)
    docs = {}
    for n, cuts in enumerate([[(0, 25), (25, 50)], [(0, 49), (1, 50)], [(i, i + 9) for i in range(0, 54, 9)], [(0, 40), (20, 60), (40, 80)]]):
        p = [f"m{n}x{i}" for i in range(max(e for _, e in cuts))]
        for s, e in cuts:
            docs[len(docs)] = p[s:e]
        for _ in range(3):
            docs[len(docs)] = p
    own = {d: [f"d{d}x{i}" for i in range(160)] for d in docs}
    full = {}
    for d, p in docs.items():
        a = rng.randint(10, 80)
        full[d] = own[d][:a] + p + own[d][a : a + 70]
    rows = [(d, " ".join(t)) for d, t in full.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = passages.shared_passages(df).collect()
    said = defaultdict(set)
    for r in got:
        assert r.other_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.8
        said[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    seen = {}
    for d in sorted(full):  # all pairs, by every window of 50 words
        windows = {tuple(full[d][i : i + 50]): i for i in range(len(full[d]) - 49)}
        want = {j for w, i in windows.items() if w in seen for j in range(i, i + 50)}
        assert want <= said[d], d
        for w in windows:
            seen.setdefault(w, d)
    assert sum(map(bool, said.values())) >= 8


PAGE = """<html><head><title>t</title><script>var a="</p><p>";</script></head><body><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies on this site and you may like them a lot indeed.</div>
<article><h1>A &amp; B</h1><p>First  text<br>goes on.<p><b>Second &lt;one&gt;</b></p><div class="comments"><p>Me too, says a reader.</p></div></article>
<aside>More to read here</aside><footer>&copy; us</footer>"""


def test_main_text_of_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", PAGE[: PAGE.index("Second") + 9]), (1, "u", PAGE), (5, "x", "<p" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.extract(pages).collect()}
    assert got[1] == "A & B\n\nFirst text goes on.\n\nSecond <one>"
    assert got[2] == got[3] == got[5] == ""
    assert got[4] == "A & B\n\nFirst text goes on.\n\nSecond &l"
    assert main_text.extract(pages.limit(0)).count() == 0


def test_tree_learns_its_table():
    tree = main_text.grow_tree(main_text.LABELLED)
    right = [main_text.is_main(tree, r[:-1]) == bool(r[-1]) for r in main_text.LABELLED]
    assert sum(right) >= 0.9 * len(right)


def base_statistics(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_statistics_and_rules(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, int(i != 11)) for i in range(44)] + [(None, 1), (3, None)], "doc_id long, quality int")
    judged = quality_rules.judge(odd, labels)
    got = Counter((r.doc_id, *[r[c] for c in quality_rules.BASE]) for r in judged.collect())
    assert got == Counter((r[0], *base_statistics(r[1])) for r in odd_rows)
    assert not judged.where("base_failed and kept").count()
    assert quality_rules.learn(odd, labels.limit(0)) == []
    assert quality_rules.judge(empty, labels).count() == 0
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_rule_is_learned_and_spares_the_clean(spark):
    rows = [(i, " ".join(f"w{i}x{j}{'%%' if i % 4 == 0 else ''}" for j in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert got == {i: i % 4 != 0 for i in range(200)}


def test_language_on_held_out_rows(spark, sf, odd, odd_rows, empty):
    got = queries.op9_language(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    model = language.train(odd, F.col("lang"))
    found = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2))
    assert {r.lang_pred for r in language.predict(odd, language.train(empty, F.col("lang"))).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_interpolation_counts_and_sums(odd, odd_rows, empty):
    training = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 0
    model = interpolation.train(odd.where(training))
    got = interpolation.score(odd, training, model).collect()
    tokens = [(r[0], [*words(r[1]), None]) for r in odd_rows]
    c = Counter(t for d, ts in tokens if (d or 0) % 3 for t in ts)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, ts in tokens:
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        want[(d, len(ts), sum(c[t] > 0 for t in ts), n, round(base, 5))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert interpolation.score(empty, training, model).count() == 0
    none = interpolation.train(empty)
    assert {r.score for r in interpolation.score(odd, F.lit(False), none).collect()} == {0.0}


def test_cold_path_gives_the_scores_of_the_hot_one(odd):
    """Without broadcast bigrams the same probabilities come from the shuffle."""
    training = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 0
    model = interpolation.train(odd.where(training))
    cold = model._replace(ids=model.ids[:0], n=model.n[:0])
    a = sorted((r.n_tokens, round(r.score, 3)) for r in interpolation.score(odd, training, model).collect())
    b = sorted((r.n_tokens, round(r.score, 3)) for r in interpolation.score(odd, training, cold).collect())
    assert [x[0] for x in a] == [x[0] for x in b]
    assert all(abs(x[1] - y[1]) < 0.01 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("frequent", "hot"), [(4, 200_000), (65_000, 200_000), (30, 5)])
def test_interpolation_counts_bigrams_of_all_words(spark, monkeypatch, frequent, hot):
    """Scores against counts of all bigrams, however few words are broadcast."""
    monkeypatch.setattr(interpolation, "FREQUENT", frequent)
    monkeypatch.setattr(interpolation, "HOT", hot)
    monkeypatch.setattr(interpolation, "CANDIDATE", 2)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(150)]
    texts = {i: [vocabulary[min(int(rng.expovariate(0.03)), 149)] for _ in range(rng.randint(0, 60))] for i in range(90)}
    texts[90] = ["unseen", "w1", "unheard", "unseen"]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    training = F.col("doc_id") % 10 != 0
    model = interpolation.train(df.where(training))
    got = {r.doc_id: r for r in interpolation.score(df, training, model).collect()}
    one, two, before = Counter(), Counter(), Counter()
    for i, t in texts.items():
        pairs = list(zip([None, *t], [*t, ""], strict=True))
        if i % 10:
            one.update(w for _, w in pairs)
            two.update(pairs)
            before.update(v for v, _ in pairs)
    n = sum(one.values())
    for i, t in texts.items():
        want = 0.0
        for v, w in zip([None, *t], [*t, ""], strict=True):
            l2, l1, l0 = model.weights[before[v].bit_length()]
            want += math.log10(l2 * two[v, w] / max(before[v], 1) + l1 * one[w] / n + l0 / (len(one) + 1))
        assert got[i].score == pytest.approx(want, abs=1e-4), i
        assert got[i].n_known == sum(one[w] > 0 for w in [*t, ""])
    assert model.weights[0, 0] == 0 and np.allclose(model.weights.sum(axis=1), 1)


def test_weights_recover_a_mixture():
    p2, p1 = np.array([0.9, 0.0]), np.array([0.1, 0.1])
    weights = interpolation.learned_weights(p2, p1, 1e-6, np.array([60.0, 40.0]), 500)
    assert weights.sum() == pytest.approx(1) and 0.4 < weights[0] < 0.65 and weights[1] > 0.3


def test_toxicity_restores_and_scores(spark, empty):
    rng = np.random.default_rng(1)
    vocabulary = ["garden", "window", "letter", "summer", "people", "little", "number", "travel", "simple", "winter"]
    rows = []
    for i in range(400):
        text = [vocabulary[j] + vocabulary[k] for j, k in rng.integers(0, 10, (40, 2))]
        if i % 4 == 0:
            text[7] = ["dreadful", "dr3adful", "dreeeadful"][i // 4 % 3]
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = noisy_channel.fit(docs.where("doc_id < 300"), labels)
    extra = spark.createDataFrame([(900, None), (901, ""), (902, "so d r e a d f u l now")], "doc_id long, text string")
    got = {r.doc_id: r for r in noisy_channel.score(docs.union(extra), model).collect()}
    assert all((got[i].score >= 0.7) == (i % 4 == 0) for i in range(300, 400))
    assert got[900].score == got[901].score == pytest.approx(noisy_channel.FLOOR)
    assert got[902].score >= 0.7 and "dreadful" in got[902].restored
    assert noisy_channel.score(empty, model).count() == 0
    none = noisy_channel.fit(empty, labels)
    assert all(r.score == pytest.approx(noisy_channel.FLOOR) for r in noisy_channel.score(extra, none).collect())


def test_pipeline_stages_keep_the_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs_out = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs_out.columns == docs.columns
        path = str(tmp_path / f"stage{i}")
        docs_out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() > 0
    assert docs.select(F.sum("length")).first()[0] > 0


@pytest.mark.parametrize(("partitions", "block", "holders"), [(1, 300_000, 32), (4, 300, 32), (1, 300_000, 2), (4, 300, 2)])
def test_changed_passages_whose_parts_others_hold_first(spark, monkeypatch, partitions, block, holders):
    """Every run of equal words of two changed copies is first met in other documents,
    which hold 36 words of the passage each: no first holder is a right partner."""
    monkeypatch.setattr(passages, "BLOCK_WORDS", block)
    monkeypatch.setattr(passages, "HOLDERS", holders)
    docs, want = [], set()
    for n in range(3):
        p = [f"m{n}x{i}" for i in range(72)]
        for s in (0, 12, 24, 36) * 3:
            docs.append(p[s : s + 36])
        docs.append(p)
        for copy in range(2):
            docs.append([f"c{n}x{copy}x{i}" if i % 24 == 12 else w for i, w in enumerate(p)])
            want.add(len(docs) - 1)
        docs.append([f"v{n}x{i}" if i % 3 == 0 else w for i, w in enumerate(p)])  # too much changed
    rows = [(d, " ".join([f"d{d}x{i}" for i in range(70)] + t + [f"e{d}x{i}" for i in range(70)])) for d, t in enumerate(docs)]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()
    assert {r.doc_id for r in found} == want
    assert all(r.n_words >= 70 and r.similarity > 0.9 and r.other_id < r.doc_id for r in found)


def test_repeated_words_beside_a_passage(spark):
    """Seeds that repeat close by are thinned; the exact windows around them still meet."""
    rng = random.Random(5)
    rows = []
    for n in range(6):
        p = [f"m{n}x{i}" for i in range(8)] + ["na"] * rng.randint(20, 60) + [f"q{n}x{i}" for i in range(30)] + ["la", "li"] * 30
        for copy in range(3):
            rows.append((len(rows), " ".join(["na"] * 7 * copy + [f"d{len(rows)}x{i}" for i in range(20)] + p + ["la"] * copy)))
    got = {r.doc_id for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got >= {d for d in range(18) if d % 3}
