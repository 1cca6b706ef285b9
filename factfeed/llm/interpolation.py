"""Word n-gram scores by deleted interpolation.

Tokens of a text are its words (lower-cased A-Z) and one end token. With v the
token before w, the model is

    P(w | v) = l2(b) * f2(w | v) + l1(b) * c(w) / N + l0(b) / (V + 1)

where f2 is the maximum-likelihood bigram estimate c(v, w) / c(v), and b the bucket
of v's frequency (powers of two; 0 for a context that training does not have). The
weights of each bucket are learned by expectation-maximisation on deleted counts:
every training occurrence is scored with itself taken out of all its counts. Bigrams
of all words count, and all counts cover all training documents.

Plan: words are 64-bit hashes. Tasks add up their block before anything is
shuffled; frequent words (at most FREQUENT) and the most frequent bigrams (at most
HOT) are broadcast and scored where the text is, which also takes every hot key out
of the shuffle and changes no probability. Occurrences of all other bigrams go, as
compact arrays, to the task that counts them: those of two frequent words by bigram;
those after another context first to that context's task, which adds c(v), and if w
is not frequent either, on to w's task. Per-document sums come back by block.

Null and empty texts have the end token only. Repeated rows count and are scored
each. With no training documents P(w | v) is 1 for every token, the share of the
one unknown word. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfeed.session import materialize

from .common import map_batches
from .passages import _planes, _unplaned
from .wordhash import hash_words, mix

FREQUENT = 65_000  # (FREQUENT + 2) ** 2 < 2 ** 32
HOT = 200_000
CANDIDATE = 8  # least count of a bigram that may be broadcast
BLOCK_TOKENS, BLOCK_DOCS = 1_000_000, 60_000
BUCKETS = 33  # of context frequency: 0 is a context without training
STEPS = 4  # of an octave, in the histograms that the weights are learned from
ZERO = -1_000_000
END = np.uint64(0xE5D0000000000001)
COLD, CONTEXT, WORD, DONE, SUMS = 1, 2, 3, 4, 5  # rows of the two rounds
BASE_ADD = 0.1


class Counts(NamedTuple):
    hashes: np.ndarray  # frequent words, sorted
    counts: np.ndarray  # 0: all other words, 1..n: frequent words, n + 1: start of text
    total: int  # N
    distinct: int  # V


class Model(NamedTuple):
    counts: Counts
    weights: np.ndarray  # bucket x (l2, l1, l0)
    ids: np.ndarray  # most frequent bigrams, sorted
    n: np.ndarray


def _model(shared: tuple) -> Model:
    return Model(Counts(*shared[0]), *shared[1:])


def _buckets(df: DataFrame) -> int:
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, an end token after each text, and the texts' bounds."""
    words = hash_words(column)
    n = np.diff(words.bounds) + 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(bounds[-1], np.uint64)
    last = np.zeros(len(out), bool)
    last[bounds[1:] - 1] = True
    out[last] = END
    out[~last] = words.hashes
    return out, bounds


def _spread(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(values.astype(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _by_bucket(bucket: np.ndarray, order: np.ndarray, columns, buckets: int):
    """(bucket, arrays) for each bucket that has rows; `order` sorts by bucket first."""
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)):
        rows = order[edge[b] : edge[b + 1]]
        yield int(b), [c[rows] for c in columns]


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    found = [_unplaned(x.as_py(), kind) for x in table.column(name)]
    return np.concatenate(found) if found else np.empty(0, kind)


def _unigrams(train: DataFrame) -> DataFrame:
    """word (hash as a signed number), n of all training tokens."""
    buckets = _buckets(train)

    def make():
        kept: list[np.ndarray] = []
        size = {"n": 0}

        def flush():
            words, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            size["n"] = 0
            bucket = _spread(words, buckets)
            order = np.argsort(bucket, kind="stable")
            rows = [(b, _planes(w), _planes(c.astype(np.uint32))) for b, (w, c) in _by_bucket(bucket, order, (words, n), buckets)]
            return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]

        def step(batch):
            for a in range(0, batch.num_rows, 1000):
                kept.append(_tokens(batch.column(0).slice(a, 1000))[0])
                size["n"] += len(kept[-1])
                if size["n"] >= BLOCK_TOKENS:
                    yield flush()

        return step, lambda: [flush()] if kept else []

    def add(table: pa.Table) -> pa.Table:
        words, at = np.unique(_joined(table, "words", np.uint64), return_inverse=True)
        n = np.bincount(at, _joined(table, "n", np.uint32)).astype(np.int64)
        return pa.table({"word": words.view(np.int64), "n": n})

    blocks = map_batches(train.select(F.col("text").cast("string")), make, "bucket: int, words: binary, n: binary")
    return blocks.groupBy("bucket").applyInArrow(add, "word long, n long")


def _at_most(rows: DataFrame, most: int) -> int:
    """The least count such that at most `most` rows have it or more."""
    octaves = rows.groupBy(F.floor(F.log2("n") * 16).alias("q")).agg(F.count("*").alias("k"), F.max("n").alias("high"))
    left, floor = most, 0
    for r in octaves.orderBy(F.desc("q")).collect():  # 16 an octave: a few hundred rows
        if r["k"] > left:
            return r["high"] + 1
        left -= r["k"]
        floor = r["q"]
    return 1


def _counts(train: DataFrame) -> Counts:
    words = materialize(_unigrams(train), "words")
    end = int(np.array([END]).view(np.int64)[0])
    total = words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == end, F.col("n")))).first()
    if not total[1]:
        return Counts(np.array([END]), np.zeros(3, np.int64), 0, 0)
    floor = _at_most(words.where(F.col("word") != end), FREQUENT - 1)
    found = words.where((F.col("n") >= floor) | (F.col("word") == end)).toArrow()
    hashes, n = found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    counts = np.concatenate([[total[0] - n.sum()], n[order], [total[2]]])
    return Counts(hashes[order], counts.astype(np.int64), int(total[0]), int(total[1]))


def _codes(tokens: np.ndarray, bounds: np.ndarray, c: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the contexts and of the tokens: 0 is a word that is not frequent."""
    code = _code(tokens, c)
    before = np.empty_like(code)
    before[1:] = code[:-1]
    before[bounds[:-1]] = len(c.hashes) + 1
    return before, code


def _context_bucket(n: np.ndarray) -> np.ndarray:
    out = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1
    return np.where(n > 0, np.minimum(out, BUCKETS - 1), 0)


def _code(words: np.ndarray, c: Counts) -> np.ndarray:
    at = np.minimum(np.searchsorted(c.hashes, words), len(c.hashes) - 1)
    return np.where(c.hashes[at] == words, at + 1, 0)


def _previous(tokens: np.ndarray) -> np.ndarray:
    """The token before each; at the start of a text its code tells, not this."""
    return np.concatenate([tokens[:1], tokens[:-1]])


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) * np.uint64(0xD6E8FEB86659FD93) + w)


def _times(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of n over all rows with the same key, for each row."""
    _, at = np.unique(keys, return_inverse=True)
    return np.bincount(at, n)[at].astype(np.int64) if len(keys) else np.empty(0, np.int64)


def _of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.compute.equal(table.column("kind"), kind))


def _quantum(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * STEPS), ZERO).astype(np.int64)


def _statistics(train: DataFrame, c: Counts) -> DataFrame:
    """Histograms of deleted estimates and the more frequent bigrams.

    kind 0: x, q: quanta of the deleted f2 and c(w) / N, n occurrences in bucket b
    kind 2: bigram x of two frequent words has the count n
    """
    # plain tuples: workers need not have the classes
    shared = train.sparkSession.sparkContext.broadcast(tuple(c))
    buckets = _buckets(train)
    types = (pa.int32(), pa.int32(), *[pa.binary()] * 5)

    def rows_of(kind, place, *columns):
        bucket = _spread(place, buckets)
        for b, parts in _by_bucket(bucket, np.argsort(bucket, kind="stable"), columns, buckets):
            yield (b, kind, *map(_planes, parts), *[b""] * (5 - len(parts)))

    def histogram(c, n_vw, n_v, n_w):
        """Of distinct bigrams."""
        f2 = (n_vw - 1) / np.maximum(n_v - 1, 1)
        return _summed(0, _context_bucket(n_v), _quantum(f2), _quantum((n_w - 1) / max(c.total - 1, 1)), n_vw)

    def make():
        c = Counts(*shared.value)
        side = len(c.hashes) + 2
        kept: list[tuple] = []
        size = {"n": 0}

        def flush():
            before, code, tokens, previous = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            size["n"] = 0
            common = (code > 0) & (before > 0)
            ids, n = np.unique((before[common] * side + code[common]).astype(np.uint32), return_counts=True)
            rows = list(rows_of(COLD, ids, ids, n.astype(np.uint32)))
            before, v, w = before[~common], previous[~common], tokens[~common]
            # a frequent context is told by its code, which also names the start of a text
            pair = _pair(np.where(before > 0, before.astype(np.uint64), v), w)
            pair, first, n = np.unique(pair, return_index=True, return_counts=True)
            before, v, w, n = before[first], v[first], w[first], n.astype(np.uint32)
            a = before == 0
            rows += rows_of(CONTEXT, v[a], v[a], w[a], pair[a], n[a])
            rows += rows_of(WORD, w[~a], w[~a], pair[~a], c.counts[before[~a]], n[~a])
            return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]

        def step(batch):
            for a in range(0, batch.num_rows, 1000):
                tokens, bounds = _tokens(batch.column(0).slice(a, 1000))
                kept.append((*_codes(tokens, bounds, c), tokens, _previous(tokens)))
                size["n"] += len(tokens)
                if size["n"] >= BLOCK_TOKENS:
                    yield flush()

        return step, lambda: [flush()] if kept else []

    def by_context(table: pa.Table) -> pa.Table:
        c = Counts(*shared.value)
        side = len(c.hashes) + 2
        rows, done = list(zip(*[x.to_pylist() for x in _of_kind(table, WORD).columns], strict=True)), []
        cold = _of_kind(table, COLD)
        if cold.num_rows:
            ids, at = np.unique(_joined(cold, "c0", np.uint32), return_inverse=True)
            n = np.bincount(at, _joined(cold, "c1", np.uint32)).astype(np.int64)
            done.append(histogram(c, n, c.counts[ids // np.uint32(side)], c.counts[ids % np.uint32(side)]))
            high = n >= CANDIDATE
            none = np.zeros(high.sum(), np.int64)
            done.append([none + 2, none, ids[high].astype(np.int64), none, n[high]])
        other = _of_kind(table, CONTEXT)
        if other.num_rows:
            v, w, pair = (_joined(other, f"c{j}", np.uint64) for j in range(3))
            n = _joined(other, "c3", np.uint32)
            n_v, n_vw = _times(v, n), _times(pair, n)
            code = _code(w, c)
            rows += rows_of(WORD, w[code == 0], w[code == 0], pair[code == 0], n_v[code == 0], n[code == 0])
            first = np.unique(pair, return_index=True)[1]
            first = first[code[first] > 0]
            done.append(histogram(c, n_vw[first], n_v[first], c.counts[code[first]]))
        if done:
            b = table.column("bucket")[0].as_py()
            rows.append((b, DONE, *[_planes(np.concatenate([np.asarray(x[i], np.int64) for x in done])) for i in range(5)]))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=table.column_names)

    def by_word(table: pa.Table) -> pa.Table:
        c = Counts(*shared.value)
        done = _of_kind(table, DONE)
        out = [[_joined(done, f"c{i}", np.int64) for i in range(5)]]
        asked = _of_kind(table, WORD)
        if asked.num_rows:
            w, pair = _joined(asked, "c0", np.uint64), _joined(asked, "c1", np.uint64)
            n_v, n = _joined(asked, "c2", np.int64), _joined(asked, "c3", np.uint32)
            n_w, n_vw = _times(w, n), _times(pair, n)
            first = np.unique(pair, return_index=True)[1]
            out.append(histogram(c, n_vw[first], n_v[first], n_w[first]))
        return pa.table([np.concatenate([x[i] for x in out]) for i in range(5)], names=["kind", "b", "x", "q", "n"])

    schema = "bucket: int, kind: int, " + ", ".join(f"c{j}: binary" for j in range(5))
    blocks = map_batches(train.select(F.col("text").cast("string")), make, schema)
    known = blocks.groupBy("bucket").applyInArrow(by_context, schema.replace(":", ""))
    return known.groupBy("bucket").applyInArrow(by_word, "kind long, b long, x long, q long, n long")


def _summed(kind: int, b, x, q, n) -> list[np.ndarray]:
    key, at = np.unique(np.stack([b, x, q]), axis=1, return_inverse=True)
    return [np.full(key.shape[1], kind), key[0], key[1], key[2], np.bincount(at.ravel(), n).astype(np.int64)]


def learned_weights(p2: np.ndarray, p1: np.ndarray, p0: float, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights by expectation-maximisation on weighted deleted estimates."""
    p = np.stack([p2, p1, np.full(len(p2), p0)], axis=1)
    weights = np.full(3, 1 / 3)
    for _ in range(rounds):
        share = p * weights
        share /= share.sum(axis=1, keepdims=True)
        weights = (share * n[:, None]).sum(axis=0) / n.sum()
        weights = np.maximum(weights, 1e-6)
        weights /= weights.sum()
    return weights


def train(docs: DataFrame) -> Model:
    """The model of all rows of `docs`."""
    c = _counts(docs)
    if not c.total:
        rest = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
        return Model(c, rest, np.empty(0, np.uint32), np.empty(0, np.int64))
    found = materialize(_statistics(docs, c), "bigrams")
    # at most BUCKETS x (quanta of two probabilities) rows
    rows = found.where("kind < 2").groupBy("kind", "b", "x", "q").agg(F.sum("n").alias("n")).toArrow()
    kind, b, x, q, n = (rows.column(k).to_numpy() for k in ("kind", "b", "x", "q", "n"))
    hot = found.where("kind = 2").select("x", "n")
    hot = hot.where(F.col("n") >= _at_most(hot, HOT)).toArrow()
    ids, times = hot.column("x").to_numpy().astype(np.uint32), hot.column("n").to_numpy()
    order = np.argsort(ids)

    def value(quantum):
        return np.where(quantum == ZERO, 0.0, 2.0 ** (np.maximum(quantum, ZERO // 1000) / STEPS))

    p2, p1 = value(x), value(q)
    p0 = 1 / (c.distinct + 1)
    weights = np.tile(learned_weights(p2, p1, p0, n.astype(float)), (BUCKETS, 1))
    for i in np.unique(b):
        own = b == i
        weights[i] = learned_weights(p2[own], p1[own], p0, n[own].astype(float))
    weights[0, 0] = 0.0  # nothing was seen after this context
    weights[0] /= weights[0].sum()
    return Model(c, weights, ids[order], times[order])


def _probability(m: Model, b, f2, n_w) -> np.ndarray:
    c = m.counts
    w = m.weights[b]
    return w[:, 0] * f2 + w[:, 1] * (n_w / max(c.total, 1)) + w[:, 2] / (c.distinct + 1)


def _base(m: Model, n_w) -> np.ndarray:
    c = m.counts
    return np.log10((n_w + BASE_ADD) / (c.total + BASE_ADD * (c.distinct + 1)))


def score(docs: DataFrame, training: Column, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `training` must be true of the rows that the model was trained on.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tuple(model.counts), *model[1:]))
    buckets = _buckets(docs)
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5)

    def rows_of(block, trained, kind, place, which, *columns):
        bucket = _spread(place[which], buckets)
        for b, parts in _by_bucket(bucket, np.argsort(bucket, kind="stable"), [x[which] for x in columns], buckets):
            yield (b, block, kind, trained, *map(_planes, parts), *[b""] * (5 - len(parts)))

    def sums_of(block, d, p, *more):
        """Sums by document of a block, to be added where its head is."""
        docs_here, at = np.unique(d, return_inverse=True)
        sums = [np.bincount(at, np.log10(p)).astype(np.float32).tobytes()]
        if more:
            base, known = more
            sums += [np.bincount(at, base).tobytes(), np.bincount(at, known).astype(np.int64).tobytes()]
        return (int(block % buckets), int(block), SUMS, 0, _planes(docs_here), *sums, *[b""] * (4 - len(sums)))

    def occurrences(rows: pa.Table, *kinds):
        """Arrays of all rows, the slice of each, and which occurrences are of training."""
        found = [[_unplaned(x.as_py(), kind) for x in rows.column(f"c{j}")] for j, kind in enumerate(kinds)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in found[0]])]).astype(np.int64)
        columns = [np.concatenate(x) for x in found]
        trained = np.repeat(rows.column("trained").to_numpy(), np.diff(at))
        parts = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
        return columns, list(zip(rows.column("block").to_pylist(), rows.column("trained").to_pylist(), parts, strict=True)), columns[-1] < trained

    def make():
        m = _model(shared.value)
        c = m.counts
        side = len(c.hashes) + 2
        context = _context_bucket(c.counts)
        kept: list[tuple] = []
        size = {"n": 0, "block": TaskContext.get().partitionId() << 32}

        def flush():
            # training documents first: an index below `trained` is one of them
            flags = np.concatenate([k[0] for k in kept])
            place = np.empty(len(flags), np.int64)
            place[np.argsort(~flags, kind="stable")] = np.arange(len(flags))
            keys = pa.concat_arrays([k[1] for k in kept])
            tokens = np.concatenate([k[2] for k in kept])
            before, code = np.concatenate([k[3] for k in kept]), np.concatenate([k[4] for k in kept])
            n_tokens = np.concatenate([k[5] for k in kept])
            kept.clear()
            doc = np.repeat(place, n_tokens)
            n_docs, trained = len(flags), int(flags.sum())
            block = size["block"]
            size["block"] += 1
            size["n"] = 0
            common = code > 0
            both = common & (before > 0)
            n_w = c.counts[code]
            base = np.bincount(doc[common], _base(m, n_w[common]), n_docs)
            known = np.bincount(doc[common], n_w[common] > 0, n_docs)
            ids = (before * side + code).astype(np.uint32)
            at = np.minimum(np.searchsorted(m.ids, ids), max(len(m.ids) - 1, 0))
            here = both & (m.ids[at] == ids) if len(m.ids) else np.zeros(len(ids), bool)
            n_v = np.maximum(c.counts[before[here]], 1)
            p = _probability(m, context[before[here]], m.n[at[here]] / n_v, n_w[here])
            model_sum = np.bincount(doc[here], np.log10(p), n_docs)
            back = np.argsort(place)
            table = pa.array([k for k in keys.take(pa.array(back)).to_pylist()], pa.int64())
            rows = [
                (int(block % buckets), block, 0, trained, _ids(table), n_tokens[back].astype(np.int64).tobytes(), model_sum.tobytes(), base.tobytes(), known.astype(np.int64).tobytes())
            ]
            ask = both & ~here
            x, d = ids[ask], doc[ask].astype(np.uint16)
            bucket = _spread(x, buckets)
            for b, (i, j) in _by_bucket(bucket, np.lexsort((d, x, bucket)), (x, d), buckets):
                rows.append((b, block, COLD, trained, _planes(i), _planes(j), b"", b"", b""))
            v, w, d = _previous(tokens), tokens, doc.astype(np.uint16)
            pair = _pair(np.where(before > 0, before.astype(np.uint64), v), w)
            rows += rows_of(block, trained, CONTEXT, v, before == 0, v, w, pair, d)
            rows += rows_of(block, trained, WORD, w, (before > 0) & ~common, w, pair, c.counts[before], d)
            return [pa.array(col, t) for col, t in zip(zip(*rows, strict=True), types, strict=True)]

        def step(batch):
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                tokens, bounds = _tokens(part.column(2))
                flags = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                kept.append((flags, part.column(0), tokens, *_codes(tokens, bounds, c), np.diff(bounds)))
                size["n"] += len(tokens)
                if size["n"] >= BLOCK_TOKENS or sum(len(k[0]) for k in kept) >= BLOCK_DOCS:
                    yield flush()

        return step, lambda: [flush()] if kept else []

    def as_table(rows) -> pa.Table:
        names = ["bucket", "block", "kind", "trained", *[f"c{j}" for j in range(5)]]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def by_context(table: pa.Table) -> pa.Table:
        """Sums of what this bucket counts, and what goes on to the task of its word."""
        m = _model(shared.value)
        c = m.counts
        side = len(c.hashes) + 2
        on = table.filter(pa.compute.is_in(table.column("kind"), pa.array([0, WORD], pa.int32())))
        rows = list(zip(*[x.to_pylist() for x in on.columns], strict=True))
        cold = _of_kind(table, COLD)
        if cold.num_rows:
            (ids, d), parts, seen = occurrences(cold, np.uint32, np.uint16)
            n_v, n_w = c.counts[ids // np.uint32(side)], c.counts[ids % np.uint32(side)]
            p = _probability(m, _context_bucket(n_v), _times(ids, seen) / np.maximum(n_v, 1), n_w)
            rows += [sums_of(block, d[s], p[s]) for block, _, s in parts]
        other = _of_kind(table, CONTEXT)
        if other.num_rows:
            (v, w, pair, d), parts, seen = occurrences(other, np.uint64, np.uint64, np.uint64, np.uint16)
            n_v, code = _times(v, seen), _code(w, c)
            common = code > 0
            p = _probability(m, _context_bucket(n_v), _times(pair, seen) / np.maximum(n_v, 1), c.counts[code])
            for block, trained, s in parts:
                if common[s].any():
                    rows.append(sums_of(block, d[s][common[s]], p[s][common[s]]))
                rows += rows_of(block, trained, WORD, w[s], ~common[s], w[s], pair[s], n_v[s], d[s])
        return as_table(rows)

    def by_word(table: pa.Table) -> pa.Table:
        m = _model(shared.value)
        on = table.filter(pa.compute.is_in(table.column("kind"), pa.array([0, SUMS], pa.int32())))
        rows = list(zip(*[x.to_pylist() for x in on.columns], strict=True))
        asked = _of_kind(table, WORD)
        if asked.num_rows:
            (w, pair, n_v, d), parts, seen = occurrences(asked, np.uint64, np.uint64, np.int64, np.uint16)
            n_w = _times(w, seen)
            p = _probability(m, _context_bucket(n_v), _times(pair, seen) / np.maximum(n_v, 1), n_w)
            base = _base(m, n_w)
            rows += [sums_of(block, d[s], p[s], base[s], n_w[s] > 0) for block, _, s in parts]
        return as_table(rows)

    def gather(table: pa.Table) -> pa.Table:
        rows = list(zip(*[table.column(n).to_pylist() for n in ("kind", "c0", "c1", "c2", "c3", "c4")], strict=True))
        head = next(r for r in rows if r[0] == 0)
        ids = pa.ipc.open_stream(head[1]).read_all().column(0)
        n_tokens = np.frombuffer(head[2], np.int64)
        total, base = np.frombuffer(head[3], np.float64).copy(), np.frombuffer(head[4], np.float64).copy()
        known = np.frombuffer(head[5], np.int64).copy()
        for kind, docs_here, sums, more, seen, _ in rows:
            if kind:
                at = _unplaned(docs_here, np.uint16)
                total[at] += np.frombuffer(sums, np.float32)
                if more:
                    base[at] += np.frombuffer(more, np.float64)
                    known[at] += np.frombuffer(seen, np.int64)
        return pa.table([ids, pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(training, F.lit(False)), F.col("text").cast("string"))
    blobs = ", ".join(f"c{j}: binary" for j in range(5))
    schema = f"bucket: int, block: long, kind: int, trained: int, {blobs}"
    asked = map_batches(rows, make, schema)
    known = asked.groupBy("bucket").applyInArrow(by_context, schema.replace(":", ""))
    answers = known.groupBy("bucket").applyInArrow(by_word, schema.replace(":", ""))
    scored = answers.groupBy("block").applyInArrow(gather, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(model.counts.total).cast("long"))


def _ids(column: pa.Array) -> bytes:
    """A column with its nulls as an Arrow stream."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([column], names=["doc_id"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()
