from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from factfeed.operators.alignment import (
    anchor_statements,
    common_letters,
    common_run,
    last_char,
    locate_sentences,
    token_at,
    with_offsets,
)
from factfeed.operators.rewards import place_sentences, token_rewards


def brute_run(sentence: str, answer: str):
    """All substrings, longest first, then leftmost in answer and sentence."""
    best = (0, 0, 0)
    key = (0, 0, 0)
    for i in range(len(sentence)):
        for n in range(1, len(sentence) - i + 1):
            at = answer.find(sentence[i : i + n])
            if at < 0:
                break
            if best[2] == 0 or (-n, at, i) < key:
                best, key = (i, at, n), (-n, at, i)
    return best


def lcs_len(a: str, b: str) -> int:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return table[-1][-1]


def is_subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def word(rng, n):
    return "".join(rng.choice("abcé😀") for _ in range(n))


def both_texts(rng, n, left, right):
    return [(word(rng, rng.randint(0, left)), word(rng, rng.randint(0, right))) for _ in range(n)]


def test_longest_run_against_all_substrings(spark):
    rows = both_texts(random.Random(5), 600, 12, 25) + [("aaaa", "a" * 9), ("a" * 9, "aaaa"), ("", ""), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "s string, a string")
    for r in df.select("s", "a", common_run(F.col("s"), F.col("a")).alias("run")).collect():
        if r.s is not None and r.a is not None:
            assert tuple(r.run) == brute_run(r.s, r.a), (r.s, r.a)


def read_back(a: str, b: str) -> str:
    """From the earliest end of the table's last row: up, else left, else take."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(table[-1][j], row[-1], table[-1][j - 1] + 1 if x == y else 0))
        table.append(row)
    i, j, out = len(a), table[-1].index(max(table[-1])), ""
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            out, i, j = a[i - 1] + out, i - 1, j - 1
    return out


def test_common_letters_are_a_longest_subsequence(spark):
    df = spark.createDataFrame(both_texts(random.Random(6), 600, 10, 15) + [("", "a"), ("a", "")], "s string, t string")
    for r in df.select("s", "t", common_letters(F.col("s"), F.col("t")).alias("got")).collect():
        assert len(r.got) == lcs_len(r.s, r.t)
        assert is_subsequence(r.got, r.s) and is_subsequence(r.got, r.t)
        assert r.got == read_back(r.s, r.t)


def test_placing_runs_once_a_sentence_without_python(spark):
    outputs = spark.createDataFrame(
        [(1, ["One", " fox", " ran", "."], [False] * 4)], "answer_id long, tokens array<string>, special array<boolean>"
    )
    labels = spark.createDataFrame(
        [(1, "One fox so ran.", f"fox {i}", "Correct", "5") for i in range(9)],
        "answer_id long, sentence string, statement string, verify string, assess string",
    )
    scored = token_rewards(outputs, labels)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    placed = place_sentences(outputs, labels.select("answer_id", "sentence").distinct(), special=True).collect()
    assert [tuple(r.place) for r in placed] == [(0, 0, 8)]
    assert sum(scored.first().scores) > 9


def place(spark, rows):
    df = locate_sentences(spark.createDataFrame(rows, "sentence string, answer string"))
    return [tuple(r["place"]) for r in df.collect()]


def test_sentence_places(spark):
    rows = [
        ("bcd", "abcdbcd"),
        ("xbcdy", "abcd bcd"),
        ("zzz", "abc"),
        ("été", "un été"),
        ("ab", ""),
    ]
    assert place(spark, rows) == [(0, 1, 3), (1, 1, 3), (0, 0, 0), (0, 3, 3), (0, 0, 0)]


def anchors(spark, rows):
    df = spark.createDataFrame(rows, "sentence string, statement string, answer string")
    out = anchor_statements(locate_sentences(df))
    return [r["anchor"] for r in out.collect()]


def test_anchor_of_statements(spark):
    rows = [
        # whole sentence: last letter before the full stop
        ("Ann was born in Rome.", "Ann was born in Rome.", "So. Ann was born in Rome. Yes."),
        # beginning of the sentence
        ("Ann was born in Rome.", "Ann was", "So. Ann was born in Rome. Yes."),
        # letters in order with gaps
        ("abcdef.", "ace.", "--abcdef."),
        # statement letter missing in the sentence: longest subsequence "ace"
        ("abcdef.", "axcze.", "--abcdef."),
        # only "def" of the sentence stands in the answer, "bd" ends inside it
        ("abcXdef.", "bd", "__def__"),
        # no aligned letter inside the placed part
        ("abcXdef.", "abc", "__def__"),
        # nothing in common
        ("abc", "xyz", "abc"),
    ]
    assert anchors(spark, rows) == [23, 10, 6, 6, 2, None, None]


def test_earliest_positions(spark):
    # "aa" is matched at the first two letters although later ones exist
    assert anchors(spark, [("aXaXa", "aa", "aXaXa")]) == [2]


def test_token_index(spark):
    df = spark.createDataFrame(
        [(["ab", "", "cde", "</s>"], [False, False, False, True])], "tokens array<string>, special array<boolean>"
    )
    full = with_offsets(df).first()
    assert full["ends"] == [2, 2, 5, 9] and full["n_tokens"] == 4
    assert with_offsets(df, special=False).first()["ends"] == [2, 2, 5]
    at = [
        with_offsets(df).select(token_at(F.col("ends"), F.col("n_tokens"), F.lit(i)).alias("t")).first()["t"]
        for i in (-1, 0, 1, 2, 4, 5, 8, 9, 50)
    ]
    assert at == [0, 0, 0, 2, 2, 3, 3, 3, 3]


def test_token_index_against_counting(spark):
    rng = random.Random(9)
    rows = [([word(rng, rng.choice((0, 0, 1, 2, 7))) for _ in range(rng.randint(1, 70))], rng.randint(-1, 150)) for _ in range(200)]
    df = with_offsets(spark.createDataFrame(rows, "tokens array<string>, at int"))
    for r in df.select("tokens", "at", token_at(F.col("ends"), F.col("n_tokens"), F.col("at")).alias("tok")).collect():
        ends = [sum(map(len, r.tokens[: i + 1])) for i in range(len(r.tokens))]
        assert r.tok == min(sum(e <= r["at"] for e in ends), len(ends) - 1)


def test_few_searches_in_a_sentence_with_long_parts(spark, monkeypatch):
    """The fold over a sentence of the answer but for one letter: its state moves in
    as many steps as letters are left, and in a few more for each doubling."""
    folds = []
    real = F.aggregate
    monkeypatch.setattr(F, "aggregate", lambda col, zero, step, end: folds.append((zero, step)) or real(col, zero, step, end))
    sentence = "x".join([word(random.Random(1), 30), word(random.Random(2), 300)])
    df = spark.createDataFrame([(sentence, sentence.replace("x", ""))], "s string, a string")
    assert df.select(common_run(F.col("s"), F.col("a"))["n"]).first()[0] == 300
    ((zero, step),) = folds
    until = lambda k: df.select(real(F.sequence(F.lit(1), F.lit(k)), zero, step)["best"]).first()[0]
    assert until(80) == 300


def test_last_char(spark):
    df = spark.createDataFrame([((0, 4, 3),), ((0, 0, 0),)], "place struct<sent_at:int,ans_at:int,n:int>")
    assert [r["c"] for r in df.select(last_char(F.col("place")).alias("c")).collect()] == [6, -1]


def test_common_letters_of_long_texts(spark):
    """Work of a letter follows the sentence's words of bits, not its length times the
    letters found: texts of many words of bits are read back in seconds."""
    rng = random.Random(8)
    pairs = [tuple("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (500, 900)) for _ in range(16)]
    df = spark.createDataFrame(pairs, "s string, t string").coalesce(1)
    begin = time.monotonic()
    rows = df.select("s", "t", common_letters(F.col("s"), F.col("t")).alias("got")).collect()
    assert time.monotonic() - begin < 10
    for r in rows[:2]:
        assert r.got == read_back(r.s, r.t)
