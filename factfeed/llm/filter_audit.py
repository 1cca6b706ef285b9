"""What each filter removes in every order of filters, from counts of failure masks.

A document's mask says which filters it fails. In an order of the filters it is removed
at its first failing filter, so the orders that remove it at one step, after the same
passed filters, share a prefix: in lexicographic order they are an interval of ranks.
The Lehmer digits of the prefix give the interval's ends. A mask's count is added where
such an interval begins and taken away where it ends, for each step; a prefix sum over
the ranks then gives the removals of all orders at once.

Only masks are counted on documents: one row a (part, mask) is left, at most 32 a part.
Equal texts are found by SHA-256. Copies are first counted by text, part, labels and id,
then by text, part and labels along with their smallest id, so copies are combined before
they move, and a text that a third of all rows have is no large group.

Null texts are empty: they fail A alone, and E after the first empty text. A null lang
is the part ''. A row with a null doc_id never fails E and makes no other row fail; it
has no labels. Rows that repeat the smallest doc_id of a text do not fail E. Of several
labels of a document, one is enough; labels with a null value count as 0. Empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

LETTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10  # words, percent of words, percent of code points


def text_mask(raw: bytes, not_upper: bytes, not_symbol: bytes, trailing: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = raw.split()  # at the six bytes 09-0D and 20
    points = len(raw) if raw.isascii() else len(raw.translate(None, trailing))
    upper = len(raw.translate(None, not_upper))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * upper > MAX_UPPER * points) << 2
        | (len(raw.translate(None, not_symbol)) > 0) << 3
    )


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask of every row: the filters that see one text only."""

    def make():
        every = bytes(range(256))
        not_upper = every.translate(None, bytes(range(65, 91)))
        not_symbol, trailing = every.translate(None, SYMBOLS), bytes(range(128, 192))

        def step(batch):
            digests, masks = [], []
            for raw in batch.column(2).to_pylist():
                raw = raw or b""
                digests.append(hashlib.sha256(raw).digest())
                masks.append(text_mask(raw, not_upper, not_symbol, trailing))
            return [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())]

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")), F.col("text").cast("string").cast("binary"))
    return map_batches(rows, make, "doc_id: long, part: string, digest: binary, mask: int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and failed filters, E among them."""
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    own = own.agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    rows = text_masks(docs).join(own, "doc_id", "left").fillna(0, ["good", "toxic"])
    cell = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *cell).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    cells = by_id.groupBy(*cell).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"),
    )
    first = cells.groupBy(F.col("digest")).agg(F.min("least.doc_id").alias("first"))
    cells = cells.join(first, "digest")
    later = F.col("known") - F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), (F.col("n") - later).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), later.alias("n")))
    counted = cells.select("part", "good", "toxic", F.explode(split).alias("at")).where("at.n > 0")
    n = F.col("at.n")
    return counted.groupBy("part", "at.mask").agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def removal_intervals(mask: int, k: int = len(LETTERS)) -> list[tuple[int, int, int]]:
    """(step, lo, hi): ranks lo .. hi - 1 of the orders that remove the mask at step."""
    out = []

    def walk(rank: int, left: list[int], step: int):
        size = factorial(len(left) - 1)
        for digit, f in enumerate(left):  # Lehmer digit: the filter's place among those left
            lo = rank + digit * size
            if mask >> f & 1:
                out.append((step, lo, lo + size))
            elif len(left) > 1:
                walk(lo, left[:digit] + left[digit + 1 :], step + 1)

    walk(0, list(range(k)), 0)
    return out


def order_totals(masks: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every order (row) and step (column) from counts (masks, 3) of n, good, toxic."""
    k, ranks = len(LETTERS), factorial(len(LETTERS))
    edges = np.zeros((ranks + 1, k, 3), np.int64)
    for mask, count in zip(masks.tolist(), counts, strict=True):
        for step, lo, hi in removal_intervals(mask):
            edges[lo, step] += count
            edges[hi, step] -= count
    removed, good, toxic = np.moveaxis(np.cumsum(edges, axis=0)[:ranks], 2, 0)
    letter = np.array(list(itertools.permutations(range(k))))
    fails = np.array([counts[masks >> f & 1 == 1, 0].sum() for f in range(k)])
    alone = np.array([counts[masks == 1 << f, 0].sum() for f in range(k)])
    share = np.array([removed[letter == f].sum() for f in range(k)])
    return {
        "kept": counts[:, 0].sum() - np.cumsum(removed, axis=1),
        "removed": removed,
        "redundant": fails[letter] - removed,
        "unique_fails": alone[letter],
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": share[letter],
    }


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every part, order of the filters and step."""
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names)

    def totals(table: pa.Table) -> pa.Table:  # at most 32 rows
        counts = np.stack([table.column(c).to_numpy() for c in ("n", "good", "toxic")], axis=1)
        found = order_totals(table.column("mask").to_numpy(), counts)
        orders = ["".join(p) for p in itertools.permutations(LETTERS)]
        k = len(LETTERS)
        columns = {
            "part": pa.array([table.column("part")[0].as_py()] * (len(orders) * k), pa.string()),
            "filter_order": pa.array(np.repeat(orders, k).tolist(), pa.string()),
            "step": pa.array(np.tile(np.arange(1, k + 1), len(orders)), pa.int32()),
        }
        return pa.table(columns | {n: pa.array(found[n].ravel(), pa.int64()) for n in names})

    return mask_counts(docs, labels).groupBy("part").applyInArrow(totals, schema)
