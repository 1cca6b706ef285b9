"""Packing token sequences into full windows by non-negative least squares.

Documents are handled in blocks of about `block_tokens` tokens, in the task that
reads them; nothing is shuffled and no block depends on another. In a block every
document first gives its full windows. What is left of each is binned by length;
combinations of up to `depth` bins that fill a window are the columns of a matrix
whose non-negative least-squares fit to the histogram says how often to use each.
The rounded counts are filled with real pieces, whose surplus over the bins' lower
edges is cut off and joins the leftover pieces; these are packed greedily, longest
fitting piece first, cutting one piece where none fits. The last, partly filled
sequence of a block is divided into lengths that are powers of two, so that no
sequence needs padding.

Every document has at least one token (the end id), so null and empty texts give
one piece of length 1. Rows that repeat a doc_id are packed one by one. An empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts
from .encoding import encoder

SCHEMA = (
    "doc_id: long, start: long, length: long, doc_tokens: long, "
    "sequence_id: long, offset: long, ids: binary"
)


class Piece(NamedTuple):
    doc: int
    start: int
    length: int


def combinations(bins: int, depth: int) -> np.ndarray:
    """Rows: ways to write `bins` as a sum of at most `depth` bins, as counts per bin."""
    rows: list[list[int]] = []

    def grow(parts: list[int], least: int, left: int) -> None:
        if left >= least:
            rows.append([*parts, left])
        if len(parts) + 1 < depth:
            for part in range(least, left // 2 + 1):
                grow([*parts, part], part, left - part)

    grow([], 1, bins)
    out = np.zeros((len(rows), bins + 1))
    for i, parts in enumerate(rows):
        for part in parts:
            out[i, part] += 1
    return out


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 with a.T @ x close to h, by accelerated projected gradient steps."""
    x = y = np.zeros(len(a))
    step = 1.0 / max(np.linalg.norm(a @ a.T if len(a) < a.shape[1] else a.T @ a, 2), 1e-9)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (a @ (y @ a - h)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(pieces: list[Piece], window: int, width: int, depth: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences from the fitted combinations, and the pieces left over."""
    bins = window // width
    by_bin: list[list[Piece]] = [[] for _ in range(bins + 1)]
    for p in pieces:
        by_bin[p.length // width].append(p)
    left = by_bin[0]
    histogram = np.array([0.0] + [len(b) for b in by_bin[1:]])
    combos = combinations(bins, depth)
    usable = np.flatnonzero(((combos > 0) <= (histogram > 0)).all(axis=1))
    full: list[list[Piece]] = []
    if len(usable):
        combos = combos[usable]
        repeat = nnls(combos, histogram)
        for i in np.argsort(-repeat, kind="stable"):
            need = np.flatnonzero(combos[i])
            there = min(len(by_bin[b]) // int(combos[i, b]) for b in need)
            for _ in range(min(int(round(repeat[i])), there)):
                taken = [by_bin[b].pop() for b in need for _ in range(int(combos[i, b]))]
                over = sum(p.length for p in taken) - window
                taken.sort(key=lambda p: p.length)
                last = taken[-1]
                if over:  # the longest has more than the surplus, as bins are narrow
                    taken[-1] = Piece(last.doc, last.start, last.length - over)
                    left.append(Piece(last.doc, last.start + last.length - over, over))
                full.append(taken)
    return full, [p for b in by_bin for p in b]


def greedy(pieces: list[Piece], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Longest fitting piece first; the last, partly filled sequence apart."""
    pool = sorted((p.length, p.doc, p.start) for p in pieces)
    full: list[list[Piece]] = []
    now: list[Piece] = []
    gap = window
    while pool:
        at = bisect.bisect_right(pool, (gap, float("inf"), 0)) - 1
        if at >= 0:
            length, doc, start = pool.pop(at)
        else:  # all are longer: cut the shortest
            n, doc, start = pool.pop(0)
            length = gap
            bisect.insort(pool, (n - gap, doc, start + gap))
        now.append(Piece(doc, start, length))
        gap -= length
        if gap == 0:
            full.append(now)
            now, gap = [], window
    return full, now


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The same tokens in sequences whose lengths are powers of two."""
    total = sum(p.length for p in pieces)
    out, rest = [], list(pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        now = []
        while room:
            p = rest.pop(0)
            n = min(room, p.length)
            now.append(Piece(p.doc, p.start, n))
            if n < p.length:
                rest.insert(0, Piece(p.doc, p.start + n, p.length - n))
            room -= n
        out.append(now)
    return out


def sequences(lengths: list[int], window: int = 4096, width: int = 32, depth: int = 3) -> list[list[Piece]]:
    """Pieces of documents of these lengths, by sequence."""
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, n in enumerate(lengths):
        whole = n // window * window
        full.extend([Piece(doc, at, window)] for at in range(0, whole, window))
        if n > whole:
            rest.append(Piece(doc, whole, n - whole))
    planned, rest = plan(rest, window, width, depth)
    packed, rest = greedy(rest, window)
    return full + planned + packed + powers_of_two(rest)


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    window: int = 4096,
    block_tokens: int = 2_000_000,
) -> DataFrame:
    """Pieces of all documents, with their ids as little-endian 32-bit numbers."""

    def make():
        encode = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        state = {"docs": [], "ids": [], "tokens": 0, "next": task << 36}

        def flush():
            doc_ids, ids = state["docs"], state["ids"]
            lengths = [len(x) for x in ids]
            columns: list[list] = [[] for _ in range(7)]
            for sequence in sequences(lengths, window):
                offset = 0
                for p in sequence:
                    part = ids[p.doc][p.start : p.start + p.length]
                    row = (doc_ids[p.doc], p.start, p.length, lengths[p.doc], state["next"], offset, part.tobytes())
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += p.length
                state["next"] += 1
                if len(columns[0]) >= 512:
                    yield arrow(columns)
                    columns = [[] for _ in range(7)]
            if columns[0]:
                yield arrow(columns)
            state["docs"], state["ids"], state["tokens"] = [], [], 0

        def arrow(columns):
            return [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())]

        def step(batch):
            keys, values = batch.column(0).to_pylist(), texts(batch.column(1))
            end = np.array([end_id], "<u4")
            for a in range(0, len(keys), 256):
                for key, ids in zip(keys[a : a + 256], encode(values[a : a + 256]), strict=True):
                    state["docs"].append(key)
                    state["ids"].append(np.concatenate([ids.astype("<u4"), end]))
                    state["tokens"] += len(ids) + 1
                    if state["tokens"] >= block_tokens:
                        yield from flush()

        return step, lambda: flush() if state["docs"] else []

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, SCHEMA)
