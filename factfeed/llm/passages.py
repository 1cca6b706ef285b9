"""Fuzzy passages that documents share, by collinear chaining of k-mer seeds.

1. Seeds: of the k-word hashes of a text, the smallest in every `WINNOW` in a row.
   Any run of k + WINNOW - 1 words that two texts share gives them a common seed.
   Windows of `min_words` words are keys too where a text repeats itself so that they
   hold no two different seeds `LEAST_CHAIN` words wide.
2. Matches: every occurrence of a key is linked to the key's first occurrence
   (smallest doc_id). Seeds of at most `HOLDERS` documents are linked to all earlier
   holders as well. A block of texts sends a frequent seed of `HOLDERS` + 1 documents
   only and links the others itself, so no group grows with a seed's holders.
3. Chains: the matches of a pair of documents are merged to runs on a diagonal;
   runs in the same order in both are chained under a linear gap cost, the best
   predecessor found in a Fenwick tree of prefix maxima.
4. Alignment: the words around each chain are aligned; the longest span of at
   least `min_words` words and `similarity` is a row, and so are those in the words
   before and after it: a chain whose whole span does not pass is split at its gaps.
5. The first holders come first. For the words that their rows leave open, 3 and 4 are
   done again with all other holders. Of a seed with more than `HOLDERS` documents
   they are found by two different seeds within `min_words` words: a join on that pair
   gives all earlier documents that hold both, without a cap. Copies are covered by
   then, so what is joined are the words that no first holder explains.
6. Of a document's rows the fewest are kept that cover the same words, so their
   number is bounded by its words and not by its partners.

A row says that words start_word .. start_word + n_words - 1 of doc_id repeat words
of other_id, an earlier document (smaller doc_id). Two texts are aligned wherever
they share seeds whose chain is `LEAST_CHAIN` words wide, however many documents hold
each of them, unless rows cover those words of the later one already. So all words of
windows of `min_words` words that an earlier document has are in a row, whatever
documents hold parts of them and however the table is partitioned. Copies of whole
documents are passages as well. A passage with changed words is missed if its two
holders share no such seeds: one in about four k-word hashes is a seed.

Null, empty and short texts have no seeds and no rows. Rows that repeat a doc_id
are one document, whose texts are not compared with one another. A null doc_id is
left out. Words are compared in lower case (A-Z). An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfeed.session import materialize

from .common import map_batches, texts
from .wordhash import Words, hash_words, long_windows, mix, windows

K = 5
WINNOW = 7
MIN_WORDS, SIMILARITY = 50, 0.8
BLOCK_WORDS = 300_000  # a task holds about a key for four words of a block, some 10 MB
BUCKET_BYTES = 5 << 20  # of text whose keys a bucket holds, about a quarter of a million
HOLDERS = 32  # documents of a seed up to which all are linked with one another
WIDE = 3  # bytes of a word in an alignment: two words are taken for one in 16 million
RUN_GAP = 40  # words between two matches of a run
GAP_COST = 0.2  # of each word left out in either text, against 1 for a word matched
LEAST_CHAIN = 14  # words that a chain must span to be aligned
LONG_RUN = 40  # words from which a run is aligned apart from its chain as well
PAD = 64  # words beside a chain that the alignment may still take
FIRST, OTHER, FREQUENT, SHARED, COVERED, TOGETHER = range(6)  # kinds of rows, see `matches` and `left_open`
_LONG, _FIRST = np.uint64(1), np.uint64(0xD6E8FEB86659FD93)
_SENT = np.uint64((1 << 48) - 1)  # of a key; its place tells more
WORD = re.compile("[^\x20\x09-\x0d]+")


def winnowed(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds, their word positions and the index of their text."""
    enough = np.diff(words.bounds) >= k
    found = windows(words, k)
    n = np.diff(found.bounds) * enough
    text = np.repeat(np.arange(len(n)), np.diff(found.bounds))
    h = found.hashes.copy()
    low, at = h.copy(), np.arange(len(h))
    for j in range(1, WINNOW):  # smallest of each window, the first of equals
        ahead = np.arange(len(h)) + j
        there = (ahead < len(h)) & (ahead < found.bounds[text + 1])
        less = np.zeros(len(h), bool)
        less[there] = h[ahead[there]] < low[there]
        low[less], at[less] = h[ahead[less]], ahead[less]
    last = found.bounds[text + 1] - np.arange(len(h))
    full = (last >= np.minimum(WINNOW, n[text])) & enough[text]  # windows inside the text
    at = np.unique(at[full])
    return h[at], at - found.bounds[text[at]], text[at]


def keys(words: Words, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, positions, texts and places (that equal keys share) of the seeds and of the
    windows of `min_words` words without two different seeds; the lowest bit of a key
    marks those windows. Their place is their smallest k-word hash, so windows in a row
    are in the same place."""
    seed, pos, text = winnowed(words, k)
    found, at, of = long_windows(words, min_words)
    # a seed with equal ones close by on both sides is left out: texts that repeat a few
    # words; beside two different seeds without equal ones a window is no key: in
    # another text they have no more than one equal one close by, and stay as well
    order = np.lexsort((pos, seed, text))
    near = (seed[order][1:] == seed[order][:-1]) & (text[order][1:] == text[order][:-1])
    near &= pos[order][1:] - pos[order][:-1] <= LEAST_CHAIN
    sides = np.zeros(len(seed), np.int64)
    sides[order[1:]] += near
    sides[order[:-1]] += near
    lone = sides == 0
    of_seed, value, place = text[lone], seed[lone] & ~_LONG, words.bounds[text[lone]] + pos[lone]
    # where the first two different seeds behind a place end, LEAST_CHAIN words wide; words
    # outside of a window have no part in the choice of its seeds but for WINNOW - 1 at its ends
    nowhere = np.iinfo(np.int64).max
    end = np.full(len(value) + 1, nowhere)
    ahead = np.searchsorted(place, place + max(LEAST_CHAIN - k, 1))
    for _ in range(8):
        there = np.minimum(ahead, max(len(value) - 1, 0))
        good = (ahead < len(value)) & (end[:-1] == nowhere) & (of_seed[there] == of_seed) & (value[there] != value)
        end[:-1][good] = place[there[good]] + k + WINNOW - 1
        ahead = ahead + 1
    end = np.minimum.accumulate(end[::-1])[::-1]
    base = words.bounds[of] + at
    rest = end[np.searchsorted(place, base + WINNOW - 1)] > base + min_words
    found, at, of = found[rest], at[rest], of[rest]
    seed, pos, text = seed[sides < 2], pos[sides < 2], text[sides < 2]
    grams = windows(words, min(k, min_words))
    low, size, wide = grams.hashes, 1, max(min_words - k + 1, 1)
    while size < wide:  # smallest of the next `wide`; only windows inside a text are used
        step = min(size, wide - size)
        low = np.minimum(low, np.concatenate([low[step:], low[len(low) - min(step, len(low)) :]]))
        size += step
    return (
        np.concatenate([seed & ~_LONG, found | _LONG]) & _SENT,
        np.concatenate([pos, at]),
        np.concatenate([text, of]),
        np.concatenate([seed, mix(low[grams.bounds[of] + at])]),
    )


def _merged(d, c, pd, pc, n):
    """Matches of a pair that touch on a diagonal as one."""
    if not len(d):
        return d, c, pd, pc, n
    order = np.lexsort((pd, pc - pd, c, d))
    d, c, pd, pc, n = (v[order] for v in (d, c, pd, pc, n))
    end = pd + n
    touch = (d[1:] == d[:-1]) & (c[1:] == c[:-1]) & ((pc - pd)[1:] == (pc - pd)[:-1]) & (pd[1:] <= end[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~touch]))
    return d[first], c[first], pd[first], pc[first], (np.maximum.reduceat(end, first) - pd[first]).astype(np.int32)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte significance: the shuffle's codec shrinks equal bytes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _numbers(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDE, 4), np.uint8)
    out[:, :WIDE] = np.frombuffer(raw, np.uint8).reshape(-1, WIDE)
    return out.view(np.uint32).ravel()


def _holders(key, doc):
    """Of occurrences in (key, doc, pos) order: the first of the key, and how many other
    documents hold it before."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return head, np.cumsum(other) - np.cumsum(other)[head]


def _linked(key, doc, pos, head, k, min_words):
    """Matches (doc, first doc, pos, first pos, words, FIRST) of the occurrences in
    other documents than that of the first."""
    other = doc != doc[head]
    n = np.where(key[other] & _LONG, min_words, k).astype(np.int32)
    found = _merged(doc[other], doc[head[other]], pos[other], pos[head[other]], n)
    return (*found, np.full(len(found[0]), FIRST, np.int32))


def _others(key, doc, pos, head, few, k):
    """Matches of kind OTHER: the seeds `few` documents hold, with all holders between
    the first and the own one."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32))]
    at = np.flatnonzero(few & (doc != doc[head]))
    back = 1
    while len(at):
        at = at[at - back > head[at]]
        there = at - back
        far = at[(doc[at] != doc[there]) & (doc[there] != doc[head[at]])]
        out.append((doc[far], doc[far - back], pos[far], pos[far - back]))
        # a second place in the first holder
        far = at[doc[there] == doc[head[at]]]
        out.append((doc[far], doc[far - back], pos[far], pos[far - back]))
        back += 1
    d, c, pd, pc = (np.concatenate(x) for x in zip(*out, strict=True))
    return d, c, pd, pc, np.full(len(d), k, np.int32), np.full(len(d), OTHER, np.int32)


def _occurrences(key, doc, pos, kind):
    n = np.zeros(len(key), np.int32)
    return doc, key.astype(np.int64), pos, n, n, np.broadcast_to(np.int32(kind), len(key)).astype(np.int32)


def _stacked(parts):
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def matches(docs: DataFrame, k: int = K, min_words: int = MIN_WORDS) -> DataFrame:
    """d, c, pd, pc, n, kind: n words from word pd of document d and from pc of c are equal.

    FIRST: c is the first holder; OTHER: c is another one. FREQUENT and SHARED: the seed
    c is at word pd of d, and more than `HOLDERS`, or several, documents hold it.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    # a bucket is a group in one process: their number follows the text
    buckets = max(2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), size // BUCKET_BYTES)
    shift = np.uint64(32)

    def make():
        kept: list[tuple] = []
        size = {"n": 0, "block": TaskContext.get().partitionId() << 32}

        def flush():
            seed, pos, doc, place = (np.concatenate(c) for c in zip(*kept, strict=True))
            kept.clear()
            size["n"] = 0
            order = np.lexsort((pos, doc, seed))
            seed, pos, doc, place = seed[order], pos[order].astype(np.int32), doc[order], place[order]
            head, before = _holders(seed, doc)
            long = (seed & _LONG).astype(bool)
            # of a window the first goes on, of a seed as many as show that it is frequent
            new = np.where(long, head == np.arange(len(seed)), before <= HOLDERS)
            over = ~new & ~long
            stays = ~new | (head == np.arange(len(seed)))
            own = np.cumsum(stays) - 1
            found = _linked(seed[stays], doc[stays], pos[stays], own[head[stays]], k, min_words)
            found = _stacked([found, _occurrences(seed[over], doc[over], pos[over], FREQUENT)])
            bucket = ((place[new] >> shift) * np.uint64(buckets) >> shift).astype(np.int64)
            # in the order of the texts: ids and distances of positions take few bytes
            order = np.lexsort((pos[new], doc[new], seed[new] & _LONG, bucket))
            seed, doc, pos, bucket = seed[new][order], doc[new][order], pos[new][order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            into = np.searchsorted(np.arange(buckets + 1) * (len(found[0]) / buckets), np.arange(len(found[0])), "right") - 1
            cut = np.searchsorted(into, np.arange(buckets + 1))
            rows = [[] for _ in range(10)]
            for b in range(buckets):
                s, m = slice(edge[b], edge[b + 1]), slice(cut[b], cut[b + 1])
                if s.start == s.stop and m.start == m.stop:
                    continue
                parts = [seed[s], doc[s], np.diff(pos[s], prepend=np.int32(0)), found[0][m], found[1][m], found[2][m], found[3][m], found[4][m], found[5][m]]
                for column, x in zip(rows, [b, *[_planes(p) for p in parts]], strict=True):
                    column.append(x)
            return [pa.array(rows[0], pa.int32())] + [pa.array(c, pa.binary()) for c in rows[1:]]

        def step(batch):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, batch.num_rows, 500):
                words = hash_words(batch.column(1).slice(a, 500))
                seed, pos, text, place = keys(words, k, min_words)
                kept.append((seed, pos, ids[a : a + 500][text], place))
                size["n"] += len(words.hashes)
                if size["n"] >= BLOCK_WORDS:
                    yield flush()

        def finish():
            return [flush()] if kept else []

        return step, finish

    def join(table: pa.Table) -> pa.Table:
        def all_of(i, kind):
            return np.concatenate([_unplaned(x.as_py(), kind) for x in table.column(i)])

        seed, doc = all_of(1, np.uint64), all_of(2, np.int64)
        pos = np.concatenate([np.cumsum(_unplaned(x.as_py(), np.int32), dtype=np.int32) for x in table.column(3)])
        order = np.lexsort((pos, doc, seed))
        seed, doc, pos = seed[order], doc[order], pos[order]
        head, before = _holders(seed, doc)
        holders = np.zeros(len(seed), np.int64)
        np.maximum.at(holders, head, before + 1)
        holders = np.where(seed & _LONG, 0, holders[head])  # of a seed
        often, several = holders > HOLDERS, (holders > 1) & (holders <= HOLDERS)
        parts = [
            (all_of(4, np.int64), all_of(5, np.int64), *(all_of(i, np.int32) for i in (6, 7, 8, 9))),
            _linked(seed, doc, pos, head, k, min_words),
            _others(seed, doc, pos, head, several, k),
            _occurrences(seed[often], doc[often], pos[often], FREQUENT),
            _occurrences(seed[several], doc[several], pos[several], SHARED),
        ]
        return pa.table(list(_stacked(parts)), names=["d", "c", "pd", "pc", "n", "kind"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "bucket: int, seed: binary, doc: binary, pos: binary, ld: binary, lc: binary, lpd: binary, lpc: binary, ln: binary, lk: binary"
    blocks = map_batches(rows, make, schema)
    return blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(join, "d long, c long, pd int, pc int, n int, kind int")


def chain_runs(runs: list[tuple]) -> list[tuple]:
    """Best chains of runs (i0, i1, j0, j1), ends exclusive, sorted by i0.

    A chain's worth is the words of its runs less the gap cost. Predecessors end
    before a run begins in both texts; among them the best is the largest prefix
    maximum over j1 in a Fenwick tree, which runs enter as i passes their end.
    """
    n = len(runs)
    if n == 1:
        i0, i1, j0, j1 = runs[0]
        return [(i1 - i0, i0, i1, j0, j1)]
    ends = sorted({r[3] for r in runs})
    rank = {j: x + 1 for x, j in enumerate(ends)}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ends) + 1)
    by_end = sorted(range(n), key=lambda x: runs[x][1])
    worth, before = [0.0] * n, [-1] * n
    entered = 0
    for x in range(n):
        i0, i1, j0, j1 = runs[x]
        while entered < n and runs[by_end[entered]][1] <= i0:
            q = by_end[entered]
            entered += 1
            key = (worth[q] + GAP_COST * (runs[q][1] + runs[q][3]), q)
            at = rank[runs[q][3]]
            while at < len(tree):
                if key > tree[at]:
                    tree[at] = key
                at += at & -at
        lo, hi = 0, len(ends)  # ranks of ends up to j0
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ends[mid] <= j0 else (lo, mid)
        best = (float("-inf"), -1)
        while lo:
            best = max(best, tree[lo])
            lo -= lo & -lo
        gain = best[0] - GAP_COST * (i0 + j0)
        worth[x] = (i1 - i0) + max(0.0, gain)
        if gain > 0:
            before[x] = best[1]
    out, used = [], [False] * n
    for x in sorted(range(n), key=lambda x: -worth[x]):
        if used[x]:
            continue
        last = first = x
        total = worth[x]
        used[x] = True
        while before[first] >= 0 and not used[before[first]]:
            first = before[first]
            used[first] = True
        if before[first] >= 0:
            total -= worth[before[first]]
        out.append((total, runs[first][0], runs[last][1], runs[first][2], runs[last][3]))
    return out


def by_document(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(columns of whole documents) -> columns or None, for long columns `d`, ..;
    some 200,000 rows at a time, or one document's."""
    width = len(rows.columns)

    def make():
        held: list[np.ndarray] = []

        def step(batch):
            held.append(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(width)]))
            if sum(x.shape[1] for x in held) < 200_000:
                return None
            rows = np.concatenate(held, axis=1)
            held.clear()
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last document may go on
            held.append(rows[:, cut:])
            return work(*rows[:, :cut]) if cut else None

        def finish():
            rows = np.concatenate(held, axis=1) if held else np.empty((width, 0), np.int64)
            done = work(*rows) if rows.shape[1] else None
            return [done] if done else []

        return step, finish

    return map_batches(rows.repartition("d").sortWithinPartitions("d"), make, schema)


def left_open(found: DataFrame, rows: DataFrame, k: int, min_words: int) -> DataFrame:
    """Matches in words of d that `rows` do not cover, and rows of kind TOGETHER: two
    different seeds, at least one of them frequent, that c is a hash of, begin at word pd
    of d and pc words behind it; n is 1 if `rows` do not cover both."""
    span = max(min_words - k, 1)

    def work(d, c, pd, pc, n, kind):
        order = np.lexsort((pd, d))
        d, c, pd, pc, n, kind = (v[order] for v in (d, c, pd, pc, n, kind))
        at = (np.cumsum(np.concatenate([[0], d[1:] != d[:-1]])) << 32) + pd
        done = kind == COVERED
        begin, until = at[done], np.maximum.accumulate(at[done] + n[done])
        row = np.searchsorted(begin, at, "right") - 1
        words = np.where((kind == FIRST) | (kind == OTHER), n, k)
        covered = (until[row] >= at + words) & (row >= 0) if len(begin) else np.zeros(len(d), bool)
        keep = ((kind == FIRST) | (kind == OTHER)) & ~covered
        parts = [tuple(v[keep] for v in (d, c, pd, pc, n, kind))]
        seeds = (kind == FREQUENT) | (kind == SHARED)
        d, seed, at, pd, often, covered = (v[seeds] for v in (d, c, at, pd, kind == FREQUENT, covered))
        a = np.arange(len(seed))
        ahead = 0
        while len(a):
            ahead += 1
            a = a[a + ahead < len(seed)]
            a = a[at[a + ahead] - at[a] <= span]
            b = a + ahead
            wide = (at[b] - at[a] >= LEAST_CHAIN - k) & (seed[a] != seed[b]) & (often[a] | often[b])
            x, y = a[wide], b[wide]
            both = mix(seed[x].astype(np.uint64) * _FIRST + seed[y].astype(np.uint64)).view(np.int64)
            free = (~covered[x] | ~covered[y]).astype(np.int64)
            parts.append((d[x], both, pd[x], pd[y] - pd[x], free, np.full(len(x), TOGETHER, np.int64)))
        d, c, pd, pc, n, kind = _stacked(parts)
        return [pa.array(v, t) for v, t in zip((d, c, pd, pc, n, kind), kinds, strict=True)] if len(d) else None

    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
    taken = rows.select(
        F.col("doc_id").alias("d"), F.lit(0).cast("long").alias("c"), F.col("start_word").cast("int").alias("pd"),
        F.lit(0).alias("pc"), F.col("n_words").cast("int").alias("n"), F.lit(COVERED).alias("kind"),
    )
    return by_document(found.union(taken), work, "d: long, c: long, pd: int, pc: int, n: int, kind: int")


def held_together(rows: DataFrame, k: int) -> DataFrame:
    """Matches of kind OTHER with all earlier documents that hold both seeds too."""
    pairs = rows.where(F.col("kind") == TOGETHER)
    free = pairs.where("n = 1").select("d", "c", "pd", F.col("pc").alias("gap"))
    other = pairs.select(F.col("d").alias("e"), "c", F.col("pd").alias("pe"), F.col("pc").alias("other_gap"))
    both = free.join(other, "c").where("e < d")
    match = lambda i, j, n: F.struct(i.alias("pd"), j.alias("pc"), n.alias("n"))
    pd, pe, gap, other_gap = (F.col(c) for c in ("pd", "pe", "gap", "other_gap"))
    two = F.array(match(pd, pe, F.lit(k)), match(pd + gap, pe + other_gap, F.lit(k)))
    places = F.when(gap == other_gap, F.array(match(pd, pe, gap + k))).otherwise(two)
    return both.select("d", F.col("e").alias("c"), F.inline(places)).withColumn("kind", F.lit(OTHER))


def chains(found: DataFrame, more: bool = False) -> DataFrame:
    """d, c, i0, i1, j0, j1: chains of each pair worth aligning; with `more` only of
    pairs that have a match of kind OTHER."""

    def work(d, c, pd, pc, n, kind):
        diagonal = pc - pd
        order = np.lexsort((pd, diagonal, c, d))
        d, c, pd, pc, n, kind, diagonal = (v[order] for v in (d, c, pd, pc, n, kind, diagonal))
        if more:
            pair = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])]))
            new = np.repeat(np.logical_or.reduceat(kind == OTHER, pair), np.diff(np.append(pair, len(d))))
            if not new.any():
                return None
            d, c, pd, pc, n, diagonal = (v[new] for v in (d, c, pd, pc, n, diagonal))
        same = (d[1:] == d[:-1]) & (c[1:] == c[:-1])
        joined = same & (diagonal[1:] == diagonal[:-1]) & (pd[1:] - (pd + n)[:-1] <= RUN_GAP)
        starts = np.flatnonzero(np.concatenate([[True], ~joined]))
        size = np.maximum.reduceat(pd + n, starts) - pd[starts]
        runs_at = np.lexsort((pc[starts], pd[starts], c[starts], d[starts]))
        starts, size = starts[runs_at], size[runs_at]
        rd, rc, i0, j0 = d[starts], c[starts], pd[starts], pc[starts]
        i1, j1 = i0 + size, j0 + size
        pair = np.concatenate([[True], (rd[1:] != rd[:-1]) | (rc[1:] != rc[:-1])])
        at = np.append(np.flatnonzero(pair), len(rd))
        columns: list[list] = [[] for _ in range(6)]
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            runs = list(zip(i0[s:e].tolist(), i1[s:e].tolist(), j0[s:e].tolist(), j1[s:e].tolist(), strict=True))
            found = {r[1:] for r in chain_runs(runs)}
            # a long run is aligned for itself too, whatever its chain comes to
            found.update(r for r in runs if r[1] - r[0] >= LONG_RUN)
            for chain in sorted(found):
                if chain[1] - chain[0] >= LEAST_CHAIN:
                    for column, v in zip(columns, (int(rd[s]), int(rc[s]), *chain), strict=True):
                        column.append(v)
        return [pa.array(c, pa.int64()) for c in columns] if columns[0] else None

    return by_document(found, work, "d: long, c: long, i0: long, i1: long, j0: long, j1: long")


def passing(blocks: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Spans (a, b, s, t, matched) of matching blocks (a, s, n) in order that pass.

    The longest span that passes is taken first, less the ends whose gaps outweigh
    their matches, then those of the blocks before and after it.
    """
    out, todo = [], [(0, len(blocks))]
    total = np.concatenate([[0], np.cumsum(blocks[:, 2])])
    begin, end = blocks[:, :2], blocks[:, :2] + blocks[:, 2:]

    def passes(p, q):
        size = end[q] - begin[p]
        return size.min() >= min_words and total[q + 1] - total[p] >= similarity * size.max() - 1e-9

    while todo:
        lo, hi = todo.pop()
        best, found = min_words - 1, None
        for p in range(lo, hi):
            if end[hi - 1, 0] - begin[p, 0] <= best:
                break
            size = end[p:hi] - begin[p]
            good = (total[p + 1 : hi + 1] - total[p] >= similarity * size.max(axis=1) - 1e-9) & (size.min(axis=1) >= min_words)
            if good.any():
                q = p + int(np.flatnonzero(good)[-1])
                if end[q, 0] - begin[p, 0] > best:
                    best, found = end[q, 0] - begin[p, 0], (p, q)
        if found is None:
            continue
        p, q = found
        score, first, top = 0, p, (0, p, q)
        for r in range(p, q + 1):
            gap = int((begin[r] - end[r - 1]).max()) if r > first else 0
            if score <= gap:
                score, first = 0, r
            else:
                score -= gap
            score += int(blocks[r, 2])
            top = max(top, (score, first, r), key=lambda x: x[0])
        if passes(*top[1:]):
            p, q = top[1:]
        out.append((*(int(v) for v in (begin[p, 0], end[q, 0], begin[p, 1], end[q, 1])), int(total[q + 1] - total[p])))
        todo += [part for part in ((lo, p), (q + 1, hi)) if part[0] < part[1]]
    return out


def align(x: np.ndarray, y: np.ndarray, i0: int, i1: int, j0: int, j1: int, min_words: int = MIN_WORDS, similarity: float = SIMILARITY):
    """Spans (a, b, s, t, matched): words a:b of x and s:t of y around the chain pass."""
    found = []
    if j0 - i0 == j1 - i1:  # one diagonal: compare it directly
        shift = j0 - i0
        lo, hi = max(0, -shift), min(len(x), len(y) - shift)
        same = np.concatenate([[False], x[lo:hi] == y[lo + shift : hi + shift], [False]]).astype(np.int8)
        starts, ends = np.flatnonzero(np.diff(same) > 0) + lo, np.flatnonzero(np.diff(same) < 0) + lo
        found = passing(np.stack([starts, starts + shift, ends - starts], axis=1), min_words, similarity)
        if any(a <= i0 and i1 <= b for a, b, *_ in found):
            return found
    # matching blocks of the whole neighbourhood
    blocks = SequenceMatcher(None, x.tolist(), y.tolist(), autojunk=False).get_matching_blocks()[:-1]
    return found + passing(np.array(blocks, np.int64).reshape(-1, 3), min_words, similarity)


def shared_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, k: int = K) -> DataFrame:
    """doc_id, other_id, start_word, n_words, other_start, other_words, similarity."""
    found = materialize(matches(docs, k, min_words), "matches")
    linked = F.col("kind").isin(FIRST, OTHER)
    first = materialize(aligned(docs, chains(found.where(F.col("kind") == FIRST)), min_words, similarity), "passages")
    rest = materialize(left_open(found, covering(first), k, min_words), "open")
    more = chains(rest.where(linked).union(held_together(rest, k)), more=True)
    return covering(first.union(aligned(docs, more, min_words, similarity)))


def aligned(docs: DataFrame, chained: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Rows of all spans that pass, around each chain."""
    found = materialize(chained, "chains")
    key = ["d", "c", "i0", "i1", "j0", "j1"]
    ends = [("d", "i0", "i1", 0), ("c", "j0", "j1", 1)]
    wanted = None
    for doc, lo, hi, side in ends:
        part = found.select(F.col(doc).alias("doc_id"), F.lit(side).alias("side"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), *key)
        wanted = part if wanted is None else wanted.union(part)

    def make_words():
        def step(batch):
            out, ids = [], []
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                words = hash_words(part.column(1))
                low = np.ascontiguousarray(words.hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDE :])
                ids.append(part.column(0))
                out += [low[x:y].tobytes() for x, y in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
            return [pa.concat_arrays(ids), pa.array(out, pa.binary())]

        return step

    def make_align():
        def step(batch):
            rows = [[] for _ in range(7)]
            for r in zip(*[batch.column(i).to_pylist() for i in range(10)], strict=True):
                d, c, i0, i1, j0, j1, base_x, x, base_y, y = r
                x, y = _numbers(x), _numbers(y)
                for a, b, s, t, matched in align(x, y, i0 - base_x, i1 - base_x, j0 - base_y, j1 - base_y, min_words, similarity):
                    share = matched / max(b - a, t - s)
                    for column, v in zip(rows, (d, c, base_x + a, b - a, base_y + s, t - s, share), strict=True):
                        column.append(v)
            return [pa.array(c, pa.int64()) for c in rows[:6]] + [pa.array(rows[6], pa.float64())]

        return step

    # each text becomes WIDE bytes a word once; the JVM cuts them around the chains
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hashed = map_batches(rows, make_words, "doc_id: long, words: binary")
    base = F.greatest(F.col("lo") - PAD, F.lit(0))
    part = F.substring("words", (WIDE * base + 1).cast("int"), (WIDE * (F.col("hi") + PAD - base)).cast("int"))
    slices = wanted.join(hashed, "doc_id").select("side", base.alias("base"), part.alias("words"), *key)
    one = [F.max(F.when(F.col("side") == s, F.struct("base", "words"))).alias(f"s{s}") for s in (0, 1)]
    both = slices.groupBy(*key).agg(*one).where("s0 is not null and s1 is not null")
    both = both.select(*key, "s0.base", "s0.words", F.col("s1.base").alias("base1"), F.col("s1.words").alias("words1"))
    return map_batches(both, make_align, ROWS)


ROWS = "doc_id: long, other_id: long, start_word: long, n_words: long, other_start: long, other_words: long, similarity: double"


def covering(rows: DataFrame) -> DataFrame:
    """The fewest rows that cover what all rows of a document cover."""
    # of rows that begin together the one that reaches farthest comes first
    order = ["doc_id", "start_word", F.desc("n_words"), F.desc("similarity"), "other_id", "other_start", "other_words"]
    in_order = rows.repartition("doc_id").sortWithinPartitions(*order)

    def make_cover():
        cover = Cover()

        def columns(rows):
            return [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)] if rows else None

        fields: list = []

        def step(batch):
            fields[:] = batch.schema
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            return columns([r for row in rows for r in cover.take(row)])

        def finish():
            last = columns(cover.end())
            return [last] if last else []

        return step, finish

    return map_batches(in_order, make_cover, ROWS)


class Cover:
    """The fewest rows that cover what all rows of a document cover.

    Rows (doc, other, start, n, ..) come by document and start. From the end of what
    is covered the next row is the one that reaches farthest among those that begin
    before it; it is known once a row begins behind it.
    """

    def __init__(self):
        self.doc = self.best = None
        self.done = 0  # words up to here are covered, or in no row

    def _chosen(self, until: float):
        """Rows needed before a row that begins at `until`."""
        if self.best is not None and self.done < until and self.best[2] + self.best[3] > self.done:
            self.done = self.best[2] + self.best[3]
            return [self.best]
        return []

    def take(self, row) -> list:
        doc, start, reach = row[0], row[2], row[2] + row[3]
        if doc != self.doc:
            out = self.end()
            self.doc, self.best, self.done = doc, row, start
            return out
        out = self._chosen(start)
        if start > self.done:
            self.best, self.done = row, start
        elif reach > self.best[2] + self.best[3]:
            self.best = row
        return out

    def end(self) -> list:
        return self._chosen(float("inf"))


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents without the words that `passages` finds in earlier ones.

    Texts without a passage stay as they are; a text that loses all its words is
    left out. Columns and their order are those of `docs`.
    """
    names = docs.columns
    places = [f"c{i}" for i in range(len(names))]  # no name of the input can clash
    rows = docs.toDF(*places)
    own, at = F.col(places[names.index("doc_id")]), names.index("text")
    # the passages of one document: no more than its words
    spans = passages.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start_word", "n_words"))).alias("spans"))
    flat = F.flatten(F.transform("spans", lambda s: F.array(s["start_word"], s["start_word"] + s["n_words"])))
    joined = rows.join(spans, own.cast("long") == spans["doc_id"], "left").select(*places, flat.alias("flat"))
    whole = joined.where("flat is null").select(*places)
    marked = joined.where("flat is not null")

    def make():
        def step(batch):
            kept, out = [], []
            for text, spans in zip(texts(batch.column(at)), batch.column(len(names)).to_pylist(), strict=True):
                left = cut_words(text, list(zip(spans[::2], spans[1::2], strict=True)))
                kept.append(bool(left))
                out.append(left)
            mask = pa.array(kept)
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            return [c.filter(mask) for c in columns]

        return step

    return whole.union(map_batches(marked, make, rows.schema)).toDF(*names)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these intervals (ends exclusive)."""
    at = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for a, b in sorted(spans):
        a, b = max(a, 0), min(b, len(at))
        if b <= a:
            continue
        begin, end = at[a][0], at[b - 1][1]
        if begin > done:
            out.append(text[done:begin])
        done = max(done, end)
    out.append(text[done:])
    return "".join(out).strip(" \t\n\r\x0b\x0c")
