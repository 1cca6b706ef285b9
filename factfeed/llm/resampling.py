"""Documents drawn towards a target distribution, ranked by regular sampling.

1. Features are all words and pairs of neighbouring words, hashed to buckets. Counting
   them over the documents and over the target gives each bucket a gain, an array of
   `buckets` numbers that every task gets.
2. A document's weight is the floored mean of its features' gains; Gumbel noise, drawn
   from a hash of doc_id, turns it into a score, and the highest scores are drawn.
3. Ranks come from parallel sorting by regular sampling. The scoring tasks write sorted
   runs and mark every so-many-th row of a run; the marked keys, sorted, give regular
   splitters. Rows move to the segment between two splitters, where they are merged and
   numbered. The segments' sizes, summed up, turn those numbers into exact ranks.

A sort key is score, doc_id and the row's place in the runs, so no two are equal: any
number of ties is cut where splitters fall. The driver holds the gains, about `SAMPLES`
marked keys, at least one a run, and one size a segment; a segment has about
`SEGMENT_ROWS` rows of some 60 bytes.

Null and empty texts have no features, weight 0, and are never drawn. A null doc_id has
the noise of an empty id and comes last among equal scores. Repeated rows are scored and
ranked each. With an empty target all gains come from the documents alone. Empty tables
of documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factfeed.session import materialize

from .common import map_batches, texts

BUCKETS = 10_000
RUN_ROWS = 200_000
SEGMENT_ROWS = 1_000_000
SAMPLES = 100_000
HELD = 100_000  # features counted at a time
KEY = 24  # bytes of a sort key
_SIGN = np.uint64(1 << 63)


def word_table() -> bytes:
    """Bytes of words, A-Z folded; a space for all others."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def features(text: str, table: bytes) -> tuple[int, list[int]]:
    """Number of words, and the CRC-32 of every word and every pair of neighbours."""
    words = text.encode("utf-8", "surrogatepass").translate(table).split()
    one = [crc32(w) for w in words]
    return len(words), one + [crc32(b" " + w, before) for before, w in zip(one, words[1:])]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Features in each bucket, and the number of rows."""

    def make():
        table, total, rows = word_table(), np.zeros(buckets, np.int64), [0]
        held: list[int] = []

        def add():
            np.add(total, np.bincount(np.array(held, np.int64) % buckets, minlength=buckets), out=total)
            held.clear()

        def step(batch):
            rows[0] += batch.num_rows
            for text in texts(batch.column(0)):
                held.extend(features(text, table)[1])
                if len(held) > HELD:
                    add()

        def finish():
            add()
            at = np.flatnonzero(total)
            yield [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows[0]), pa.int64())]

        return step, finish

    counted = map_batches(docs.select(F.col("text").cast("string")), make, "bucket: int, n: long")
    out, rows = np.zeros(buckets, np.int64), 0
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():  # at most buckets + 1
        if bucket < 0:
            rows = n
        else:
            out[bucket] = n
    return out, rows


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target against that in the source."""
    n = float(len(source))
    s_all, t_all = float(source.sum()), float(target.sum())
    ratios = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def sort_keys(score: np.ndarray, doc_id: np.ndarray, missing: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Byte strings in the order of descending score, doc_id (missing last), place."""
    out = np.empty((len(score), 3), ">u8")
    out[:, 0] = ~(score.view(np.uint64) ^ _SIGN)
    out[:, 1] = np.where(missing, ~np.uint64(0), doc_id.view(np.uint64) ^ _SIGN)
    out[:, 2] = place
    return out.view(f"S{KEY}").ravel()


def _binary(keys: np.ndarray) -> pa.Array:
    ends = np.arange(0, KEY * (len(keys) + 1), KEY, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(keys.tobytes())])


def sorted_runs(docs: DataFrame, gains: np.ndarray, seed: int, least_words: int, stride: int) -> DataFrame:
    """doc_id, n_features, weight, score, key, marked: runs in the order of key.

    Rows below `least_words` have no key. Every `stride`-th row of a run is marked, at
    least one."""

    def make():
        table, buckets = word_table(), len(gains)
        held: list[tuple] = []
        next_place = [TaskContext.get().partitionId() << 40]

        def flush():
            ids, words, n, weight = (list(c) for c in zip(*held, strict=True))
            held.clear()
            weight = np.array(weight, np.int64)
            score = weight + np.array([noise(i, seed) for i in ids], np.int64)
            missing = np.array([i is None for i in ids])
            numbers = np.array([i or 0 for i in ids], np.int64)
            place = next_place[0] + np.arange(len(ids), dtype=np.uint64)
            next_place[0] += len(ids)
            keys = sort_keys(score, numbers, missing, place)
            drawn = np.array(words) >= least_words
            order = np.flatnonzero(drawn)
            order = order[np.argsort(keys[order])]
            rest = np.flatnonzero(~drawn)
            marked = np.zeros(len(ids), bool)
            if len(order):
                marked[min(stride, len(order)) // 2 : len(order) : stride] = True
            order = np.concatenate([order, rest])
            key = pa.concat_arrays([_binary(keys[order[: len(order) - len(rest)]]), pa.nulls(len(rest), pa.binary())])
            columns = [pa.array(numbers[order], pa.int64(), mask=missing[order])]
            columns += [pa.array(np.array(c, np.int64)[order]) for c in (n, weight, score)]
            return [*columns, key, pa.array(marked)]

        def step(batch):
            for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words, found = features(text, table)
                total = int(gains[np.array(found, np.int64) % buckets].sum()) if found else 0
                held.append((i, words, len(found), total // len(found) if found else 0))
                if len(held) >= RUN_ROWS:
                    yield flush()

        def finish():
            return [flush()] if held else []

        return step, finish

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, make, "doc_id: long, n_features: long, weight: long, score: long, key: binary, marked: boolean")


def ranked_by_key(runs: DataFrame, segments: int) -> tuple[DataFrame, list[int]]:
    """The rows with a key, their segment and their number in it (from 1); segment sizes."""
    marked = sorted(bytes(r.key) for r in runs.where("marked").select("key").collect())
    cuts = sorted({marked[len(marked) * i // segments] for i in range(1, segments)}) if marked else []
    splitters = np.array(cuts, f"S{KEY}")

    def make():
        def step(batch):
            keys = np.array(batch.column(4).to_pylist(), f"S{KEY}")
            found = np.searchsorted(splitters, keys, "right").astype(np.int32)
            return [batch.column(i) for i in range(5)] + [pa.array(found)]

        return step

    fields = "doc_id: long, n_features: long, weight: long, score: long, key: binary, segment: int"
    moved = map_batches(runs.where("key is not null"), make, fields).repartitionById(max(segments, 1), F.col("segment"))
    merged = moved.sortWithinPartitions("segment", "key")
    place = F.row_number().over(Window.partitionBy("segment").orderBy("key"))
    numbered = materialize(merged.withColumn("place", place).drop("key"), "segments")
    sizes = [0] * (len(cuts) + 1)
    for segment, n in numbered.groupBy("segment").count().collect():  # one row a segment
        sizes[segment] = n
    return numbered, sizes


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = 20, buckets: int = BUCKETS, segments: int | None = None
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; undrawn rows have no rank."""
    spark = docs.sparkSession
    source, rows = bucket_counts(docs, buckets)
    gains = bucket_gains(source, bucket_counts(target, buckets)[0])
    runs = materialize(sorted_runs(docs, gains, seed, least_words, max(1, rows // SAMPLES)), "sorted-runs")
    segments = segments or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SEGMENT_ROWS))
    numbered, sizes = ranked_by_key(runs, segments)
    drawn = percent * sum(sizes) // 100
    before = spark.createDataFrame(list(enumerate(np.cumsum([0, *sizes[:-1]]).tolist())), "segment int, before long")
    rank = F.col("before") + F.col("place")
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered.join(F.broadcast(before), "segment").select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.union(runs.where("key is null").select(*columns, F.lit(None).cast("long").alias("rank")))
