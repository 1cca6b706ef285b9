"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased; everything that is no letter counts as one blank, so
n-grams see word borders. All n-grams of 1 to `longest` characters fall into
2**bits buckets per length. Training counts (language, bucket) over all training
documents: each task adds up dense counts, which Spark sums 16 buckets a row; the
model on the driver has languages x buckets numbers, with at most `MOST_LANGUAGES`
languages (more are refused, not dropped). Scoring gathers rows of the broadcast
log-probability matrix for a batch's n-grams and sums them by document.

Null texts, and texts without a letter, are `und` with score 0. Repeated rows are
learned and scored each. Rows without a language are scored only. An empty
training set predicts `und` everywhere; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

BLANK = 0
WIDTH = 16  # counters in a row
MOST_LANGUAGES = 512
_SLICE = 1 << 18


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # float32: bucket x language
    priors: np.ndarray
    bits: int
    longest: int


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _characters(values: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with non-letters as blanks, and the offsets."""
    lower = [v.lower() for v in values]
    chars = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    chars[~letters[chars]] = BLANK
    return chars, np.concatenate([[0], np.cumsum([len(v) for v in lower], dtype=np.int64)])


def _buckets(chars: np.ndarray, a: int, b: int, n: int, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start in a:b, and which of them lie in one text."""
    b = min(b, len(chars) - n + 1)
    h = np.full(max(b - a, 0), 2166136261 + n, np.uint32)
    for j in range(n):
        h ^= chars[a + j : b + j]
        h *= np.uint32(16777619)
    h ^= h >> np.uint32(15)
    inside = np.ones(len(h), bool)
    for j in range(1, n):
        cut = ends - j - a
        inside[cut[(cut >= 0) & (cut < len(h))]] = False
    return (h & np.uint32((1 << bits) - 1)).astype(np.int64) + ((n - 1) << bits), inside


def train(docs: DataFrame, label: Column, bits: int = 14, longest: int = 4, smoothing: float = 0.5) -> Model:
    size = longest << bits
    names = [f"c{i}" for i in range(WIDTH)]

    def make():
        letters = _letters()
        totals: dict[str, np.ndarray] = {}

        def step(batch):
            labels = batch.column(0).to_pylist()
            values = texts(batch.column(1))
            for name in set(labels):
                own = [v for v, x in zip(values, labels, strict=True) if x == name]
                counts = totals.setdefault(name, np.zeros(size + 1, np.int64))
                counts[size] += len(own)
                for i in range(0, len(own), 256):
                    chars, at = _characters(own[i : i + 256], letters)
                    for n in range(1, longest + 1):
                        for a in range(0, len(chars), _SLICE):
                            found, inside = _buckets(chars, a, a + _SLICE, n, at[1:], bits)
                            counts[:size] += np.bincount(found[inside], minlength=size)

        def finish():
            for name, counts in totals.items():
                grid = np.zeros(-(-len(counts) // WIDTH) * WIDTH, np.int64)
                grid[: len(counts)] = counts
                grid = grid.reshape(-1, WIDTH)
                rows = np.flatnonzero(grid.any(axis=1))
                yield [pa.array([name] * len(rows)), pa.array(rows)] + [pa.array(grid[rows, i]) for i in range(WIDTH)]

        return step, finish

    rows = docs.where(label.isNotNull()).select(label.cast("string").alias("label"), F.col("text").cast("string"))
    schema = "label: string, place: long, " + ", ".join(f"{n}: long" for n in names)
    summed = map_batches(rows, make, schema).groupBy("label", "place").agg(*[F.sum(n).alias(n) for n in names])
    # the number of languages is checked before the sums are collected
    languages = [r[0] for r in rows.select("label").distinct().orderBy("label").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(languages), -(-(size + 1) // WIDTH) * WIDTH))
    for r in summed.collect():
        counts[languages.index(r[0]), r[1] * WIDTH : (r[1] + 1) * WIDTH] = r[2:]
    n_docs = counts[:, size]
    weights = np.empty((size, len(languages)), np.float32)
    for n in range(longest):  # a distribution for each length
        part = counts[:, n << bits : (n + 1) << bits] + smoothing
        weights[n << bits : (n + 1) << bits] = np.log(part / part.sum(axis=1, keepdims=True)).T
    priors = np.log((n_docs + 1) / (n_docs.sum() + max(len(languages), 1)))
    return Model(languages, weights, priors, bits, longest)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score: the posterior of that language."""
    # a plain tuple: workers need not have the class
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def make():
        m, letters = Model(*shared.value), _letters()

        def score(values: list[str]):
            chars, at = _characters(values, letters)
            total = np.tile(m.priors, (len(values), 1))
            for n in range(1, m.longest + 1):
                for a in range(0, len(chars), _SLICE):
                    found, inside = _buckets(chars, a, a + _SLICE, n, at[1:], m.bits)
                    if not len(found):
                        continue
                    w = m.weights[found]
                    w[~inside] = 0
                    first = np.searchsorted(at, a, "right") - 1
                    last = np.searchsorted(at, a + len(found), "left")
                    docs_here = np.arange(first, last)
                    docs_here = docs_here[at[docs_here + 1] > np.maximum(at[docs_here], a)]
                    total[docs_here] += np.add.reduceat(w, np.maximum(at[docs_here] - a, 0), axis=0, dtype=np.float64)
            any_letter = np.add.reduceat(np.append(chars != BLANK, False), np.minimum(at[:-1], len(chars)), dtype=np.int64)
            any_letter[np.diff(at) == 0] = 0
            return total, any_letter > 0

        def step(batch):
            names, scores = [], []
            values = texts(batch.column(1))
            for a in range(0, len(values), 256):
                total, written = score(values[a : a + 256])
                if not m.languages:
                    written[:] = False
                best = total.argmax(axis=1) if m.languages else np.zeros(len(total), int)
                for i, b in enumerate(best):
                    names.append(m.languages[b] if written[i] else "und")
                    scores.append(float(1 / np.exp(total[i] - total[i, b]).sum()) if written[i] else 0.0)
            return [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, make, "doc_id: long, lang_pred: string, score: double")
