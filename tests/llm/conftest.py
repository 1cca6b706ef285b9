from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, bucket int, side string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows; every column may be null."""
    rng = random.Random(5)
    base = prose(rng, 400)
    shared = prose(rng, 80)
    texts = [
        None, "", " \t\n ", "one", base, base, base.upper(), base.replace(base[:9], "zzz", 1),
        prose(rng, 200) + " " + shared + " " + prose(rng, 30), shared + "\n" + prose(rng, 150),
        prose(rng, 30_000), "#### $$$$ " * 40, "x" * 70_000, "Ünïcödé ÉÈ 漢字 ▁ <|endoftext|> </s>  two  spaces ",
        *[prose(rng, rng.randint(20, 120)) for _ in range(30)],
    ]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), 1, "x", 2, "y") for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, "no id at all " * 5, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
