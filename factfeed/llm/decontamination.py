"""Benchmark passages in documents, by an Aho-Corasick automaton.

Text is normalised to lower-case words (runs of 0-9, a-z and non-ASCII
characters; only A-Z is folded) joined by single spaces. Every `window`
consecutive words of a benchmark item are a pattern, an item of fewer words is
one pattern. One pass over a document finds all occurrences of all patterns; its
word positions lead back to the original text.

The items are collected in blocks of a checked size. As a rule that is one block
and one automaton; a larger benchmark is cut into several blocks, each scanned by
its own pass over the rows, so that no task holds more than a block.

Null or empty texts and items have no words; repeated items count each under its
own id. Repeated documents are scanned each. Empty tables give no hits or no rows.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BLOCK_BYTES = 16 << 20  # benchmark text in one automaton
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # as in the text, A-Z not yet folded


def _table() -> bytes:
    out = bytearray(b" " * 256)
    for b in range(256):
        c = chr(b).lower() if b < 128 else ""
        if b >= 128:
            out[b] = b
        elif c.isalnum():
            out[b] = ord(c)
    return bytes(out)


def normal_words(text: str | None, table: bytes) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(table).split()


def automaton(items: list[tuple[int, str]], window: int) -> ahocorasick.Automaton | None:
    """Patterns with their length in words and the items that have them."""
    table = _table()
    patterns: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        words = normal_words(text, table)
        for i in range(max(len(words) - window, 0) + 1 if words else 0):
            part = words[i : i + window]
            patterns.setdefault(b" ".join(part), (len(part), set()))[1].add(item)
    if not patterns:
        return None
    found = ahocorasick.Automaton()
    for p, (n, ids) in patterns.items():
        # the library takes str; Latin-1 gives each UTF-8 byte a character
        found.add_word(f" {p.decode('latin-1')} ", (n, tuple(ids)))
    found.make_automaton()
    return found


def _blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    if n == 1:
        return [[tuple(r) for r in rows.collect()]]
    return [[tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()] for i in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, hits: word intervals [first, last] that lie in some
    occurrence, in order and apart, and items: ids with an occurrence, sorted.

    All columns of `docs` but doc_id and text stay out; join on doc_id for them.
    """
    kept = "doc_id: long, text: string, n_words: long, hits: array<int>, items: array<long>"
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hits"),
        F.array().cast("array<long>").alias("items"),
    )
    blocks = _blocks(benchmark)
    for i, items in enumerate(blocks):
        last = i == len(blocks) - 1
        rows = map_batches(rows, _scanner(items, window, last), kept.replace(" text: string,", "") if last else kept)
    return rows


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs`, all columns as they are, in which no pattern occurs.

    Each row is judged by its own text, so ids may be null or repeated."""
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")
    for items in _blocks(benchmark):
        rows = map_batches(rows, _filter(items, window, at), rows.schema)
    return rows.toDF(*names)


def _filter(items: list[tuple[int, str]], window: int, at: int):
    def make():
        machine, table = automaton(items, window), _table()

        def clean(text) -> bool:
            line = f" {b' '.join(normal_words(text, table)).decode('latin-1')} "
            return next(machine.iter(line), None) is None

        def step(batch):
            if machine is None:
                return batch.columns
            mask = pa.array([clean(t.as_py()) for t in batch.column(at)])
            return [c.filter(mask) for c in batch.columns]

        return step

    return make


def _scanner(items: list[tuple[int, str]], window: int, last: bool):
    def make():
        machine = automaton(items, window)
        table = _table()

        def one(text):
            words = normal_words(text, table)
            if machine is None or not words:
                return len(words), [], set()
            line = f" {b' '.join(words).decode('latin-1')} "
            spans, ids = [], set()
            done, at = 0, 0
            for end, (n, owners) in machine.iter(line):
                at += line.count(" ", done, end)  # spaces before the closing one
                done = end
                spans.append((at - n, at - 1))
                ids.update(owners)
            return len(words), spans, ids

        def step(batch):
            n_words, hits, found = [], [], []
            old_hits, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for text, before, known in zip(batch.column(1), old_hits, old_items, strict=True):
                n, spans, ids = one(text.as_py())
                n_words.append(n)
                hits.append(merged(spans + list(zip(before[::2], before[1::2], strict=True))))
                found.append(sorted(ids.union(known)))
            out = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))]
            return [batch.column(0), *out] if last else [batch.column(0), batch.column(1), *out]

        return step

    return make


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint intervals in order, flat: first, last, first, last ..."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1] + 1:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def original_spans(text: str, hits: list[int]) -> list[tuple[int, int]]:
    """Character ranges of the original text for word intervals of `scan`."""
    at = np.array([m.span() for m in WORD.finditer(text)])
    return [(int(at[a][0]), int(at[b][1])) for a, b in zip(hits[::2], hits[1::2], strict=True)]


def report(scanned: DataFrame) -> DataFrame:
    """Counts and a digest of the items per document."""
    # hits: first, last, first, last ...; an interval has last + 1 - first words
    signed = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x + 1).otherwise(-x))
    covered = F.aggregate(signed, F.lit(0), lambda total, x: total + x)
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        covered.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
