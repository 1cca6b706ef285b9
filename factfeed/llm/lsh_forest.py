"""Near-duplicates by an LSH forest of MinHash signatures.

A document is the set of its distinct k-word shingles (lower-cased words). Equal
sets are found by their fingerprints and stand for one another. For the others,
each of `TREES` trees orders all signatures by its own `DEPTH` MinHash values;
neighbours in that order share the longest prefixes. A document's candidates in a
tree are its next `REACH` neighbours with a common prefix of at least `SHALLOW`
values: where many signatures agree, the neighbours agree in more values, so the
depth adapts to the region, and no region yields all its pairs. The order is a
range partitioning that splits a crowded region over tasks; the rows at the edges
of the parts are compared again.

Candidates are confirmed on full shingle sets. Each document's most promising
candidate goes first; of the others only those that join two components are still
needed. Components take the smallest doc_id as their name.

A region (the signatures that agree in SHALLOW values of a tree) of more than
REACH + 1 rows has pairs that are no neighbours. If all of it is one component by
then, no such pair matters. Otherwise every row outside the region's largest
component is compared with all rows of the region on full sets, in blocks of about
BLOCK rows and BLOCK_SHINGLES shingles; a block gives only links that join two
components, never its pairs. So REACH decides the cost of a region, not its links.

Recall: a pair of similarity s agrees in a prefix of SHALLOW values in a tree with
probability s**SHALLOW; the chance to be no candidate in any of 16 trees is
(1 - 0.85**4)**16 = 0.00001 at s = 0.85.

Null and empty texts have the empty set and are linked with nothing. Rows that
repeat a doc_id are one node. A null doc_id has the null component unless its set
equals another's. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfeed.session import materialize, small_or_none

from .common import map_batches
from .components import components
from .wordhash import hash_words, mix, windows

K = 5
TREES, DEPTH, SHALLOW, REACH = 16, 8, 4, 4
SKETCH_BITS = 2  # of each MinHash value, kept beside a tree's label
SURE_BELOW = 0.62  # estimates this low are no candidates: 6 deviations below 0.85
BLOCK = 500  # rows of a crowded region on each side of a block
BLOCK_SHINGLES = 2_000_000  # and their shingles
_SLICE = 4096


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    n = TREES * DEPTH
    return (
        rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1),
        rng.integers(0, 2**32, n, dtype=np.uint32),
    )


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    found = windows(hash_words(column), k)
    return [np.unique(found.hashes[a:b]) for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]


def signature(shingles: np.ndarray, factors) -> np.ndarray:
    a, b = factors
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _SLICE):
        part = a[:, None] * x[None, i : i + _SLICE]
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit fingerprint), labels, sketch."""

    def make():
        factors = _factors()

        def step(batch):
            out = [[] for _ in range(5)]
            for a in range(0, batch.num_rows, 1000):
                for s in shingle_sets(batch.column(1).slice(a, 1000), k):
                    out[0].append(len(s))
                    out[1].append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                    out[2].append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    low = signature(s, factors)
                    # two bytes of each value, big-endian: bytes compare as numbers do
                    out[3].append((low >> np.uint32(16)).astype(">u2").tobytes())
                    bits = (low[:, None] >> np.arange(SKETCH_BITS, dtype=np.uint32)) & np.uint32(1)
                    out[4].append(np.packbits(bits.astype(np.uint8)).tobytes())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return [batch.column(0)] + [pa.array(c, t) for c, t in zip(out, types, strict=True)]

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, make, "doc_id: long, n_shingles: long, set_a: long, set_b: long, labels: binary, sketch: binary")


def _estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of the sets of two sketches, estimated from the values that agree."""
    both = ~(x ^ y)
    pair = both & (both >> np.uint64(1)) & np.uint64(0x5555555555555555)  # both bits agree
    agree = np.bitwise_count(pair).sum(axis=-1) / (TREES * DEPTH)
    return (agree - 0.25) / 0.75


def _neighbours(share: float, edges: bool):
    """Candidate pairs of rows in (tree, label, id) order; with `edges`, the first
    and last rows of the part as well."""

    def make():
        held: list[tuple] = []  # the last REACH rows, each a tuple of columns
        counter = {"rows": 0}

        def rows_of(batch):
            return [batch.column(i).to_pylist() for i in range(5)]

        def step(batch):
            tree, label, doc, size, sketch = rows_of(batch)
            head = held[:]
            tree = [r[0] for r in head] + tree
            label = [r[1] for r in head] + label
            doc = [r[2] for r in head] + doc
            size = [r[3] for r in head] + size
            sketch = [r[4] for r in head] + sketch
            n, old = len(tree), len(head)
            t = np.array(tree, np.int16)
            lab = np.frombuffer(b"".join(label), np.uint8).reshape(n, -1)
            ids, sizes = np.array(doc, np.int64), np.array(size, np.int64)
            bits = np.frombuffer(b"".join(sketch), np.uint64).reshape(n, -1)
            a_out, b_out, e_out = [], [], []
            for d in range(1, REACH + 1):
                if n <= d:
                    break
                at = np.arange(max(old - d, 0), n - d)  # pairs of two held rows are known
                same = (t[at] == t[at + d]) & (lab[at, : 2 * SHALLOW] == lab[at + d, : 2 * SHALLOW]).all(axis=1)
                same &= np.minimum(sizes[at], sizes[at + d]) >= share * np.maximum(sizes[at], sizes[at + d])
                same &= ids[at] != ids[at + d]
                at = at[same]
                guess = _estimate(bits[at], bits[at + d])
                keep = guess >= SURE_BELOW
                at = at[keep]
                a_out.append(np.minimum(ids[at], ids[at + d]))
                b_out.append(np.maximum(ids[at], ids[at + d]))
                e_out.append(guess[keep])
            border = []
            if edges and counter["rows"] < REACH:
                border = range(old, min(n, old + REACH - counter["rows"]))
            counter["rows"] += n - old
            out = _pairs(a_out, b_out, e_out)
            held[:] = list(zip(tree[-REACH:], label[-REACH:], doc[-REACH:], size[-REACH:], sketch[-REACH:], strict=True))
            return out + _border([(tree[i], label[i], doc[i], size[i], sketch[i]) for i in border])

        def finish():
            return _border(held) if edges else []

        return step, finish

    return make


_BORDER = (pa.int16(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
_OUT = "a: long, b: long, guess: double, tree: short, label: binary, id: long, n: long, sketch: binary"


def _pairs(a, b, e) -> list[list]:
    if not a or not sum(map(len, a)):
        return []
    a, b, e = np.concatenate(a), np.concatenate(b), np.concatenate(e)
    return [[pa.array(a), pa.array(b), pa.array(e)] + [pa.nulls(len(a), t) for t in _BORDER]]


def _border(rows) -> list[list]:
    if not rows:
        return []
    none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.float64())]
    return [none + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BORDER, strict=True)]]


def _in_trees(reps: DataFrame, depth: int, *others: str) -> DataFrame:
    """tree, label (its first `depth` values there), id, n, sketch of every row in every tree."""
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    rows = reps.select(
        F.explode(trees).alias("tree"), "labels", F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch", *others
    )
    label = F.expr(f"substring(labels, tree * {2 * DEPTH} + 1, {2 * depth})")
    return rows.select(F.col("tree").cast("short"), label.alias("label"), "id", "n", "sketch", *others)


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs a < b with the highest estimate of their similarity."""
    rows = _in_trees(reps, DEPTH)
    order = ("tree", "label", "id")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(map_batches(sorted_rows, _neighbours(percent / 100, True), _OUT), "forest")
    # a few rows of every part: its first and last ones, whose neighbours may be in the next
    border = found.where("tree is not null").select("tree", "label", "id", "n", "sketch")
    seams = border.distinct().coalesce(1).sortWithinPartitions(*order)
    pairs = found.where("tree is null").select("a", "b", "guess")
    pairs = pairs.union(map_batches(seams, _neighbours(percent / 100, False), _OUT).select("a", "b", "guess"))
    return pairs.groupBy("a", "b").agg(F.max("guess").alias("guess"))


def _across(percent: int):
    """Links of a block's queries and members that join components of the block."""

    def links(block: pa.Table) -> pa.Table:
        ids, sizes = block["id"].to_numpy(), block["n"].to_numpy()
        parts, query = block["component"].to_numpy(), block["query"].to_numpy()
        bits = np.frombuffer(b"".join(block["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
        of = np.flatnonzero(~query)
        raw = block["shingles"].to_pylist()
        sets = [np.frombuffer(raw[i], np.uint64) for i in of]
        name: dict[int, int] = {}

        def root(x: int) -> int:
            while name.get(x, x) != x:
                x = name[x]
            return x

        a, b = [], []
        if sets:
            words, entries = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
        for i in np.flatnonzero(query) if sets else ():
            near = (parts[of] != parts[i]) & (100 * np.minimum(sizes[of], sizes[i]) >= percent * np.maximum(sizes[of], sizes[i]))
            near[near] = _estimate(bits[of[near]], bits[i]) >= SURE_BELOW
            if not near.any():
                continue
            own = np.frombuffer(raw[i], np.uint64)
            both = np.add.reduceat(np.isin(words, own, assume_unique=True)[entries], starts, dtype=np.int64)
            near &= 100 * both >= percent * (sizes[of] + sizes[i] - both)
            for j in of[near]:
                x, y = root(int(parts[i])), root(int(parts[j]))
                if x != y:
                    name[max(x, y)] = min(x, y)
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def crowded(reps: DataFrame, groups: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame | None:
    """a, b: links that join components in regions that neighbours do not cover;
    None if there is no such region."""
    placed = reps.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = materialize(placed.withColumn("component", F.coalesce("component", "doc_id")), "placed")
    rows = _in_trees(placed, SHALLOW, "component")
    parts = rows.groupBy("tree", "label", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    regions = parts.groupBy("tree", "label").agg(
        F.sum("rows").alias("total"), F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("rows", "component", "n")).alias("top")
    )

    def blocks(of_rows, of_shingles):
        return F.ceil(F.greatest(of_rows / BLOCK, of_shingles / BLOCK_SHINGLES))

    mixed = regions.where((F.col("total") > REACH + 1) & (F.col("parts") > 1)).select(
        "tree",
        "label",
        F.col("top.component").alias("top"),
        blocks(F.col("total"), F.col("n")).alias("blocks"),
        blocks(F.col("total") - F.col("top.rows"), F.col("n") - F.col("top.n")).alias("turns"),
    )
    mixed = small_or_none(materialize(mixed, "mixed"))
    if mixed is None:
        return None
    rows = materialize(rows.join(mixed, ["tree", "label"]), "crowd")
    rows = rows.join(full_sets(rows.select(F.col("id").alias("doc_id")), docs, k).withColumnRenamed("doc_id", "id"), "id")
    # a repeated doc_id may have several sets
    rows = rows.where(F.octet_length("shingles") == 8 * F.col("n"))

    def spread(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    block, turn = F.pmod(F.xxhash64("id"), "blocks"), F.pmod(F.xxhash64("id"), "turns")
    kept = ("tree", "label", "id", "n", "sketch", "component", "shingles")
    members = rows.select(*kept, F.lit(False).alias("query"), block.alias("block"), spread("turns").alias("turn"))
    queries = rows.where("component != top").select(*kept, F.lit(True).alias("query"), spread("blocks").alias("block"), turn.alias("turn"))
    return members.union(queries).groupBy("tree", "label", "block", "turn").applyInArrow(_across(percent), "a long, b long").distinct()


def full_sets(ids: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, shingles of the documents named in `ids`, written once."""

    def make():
        def step(batch):
            out = []
            for a in range(0, batch.num_rows, 1000):
                out += [s.tobytes() for s in shingle_sets(batch.column(1).slice(a, 1000), k)]
            return [batch.column(0), pa.array(out, pa.binary())]

        return step

    # a short list of ids spares the texts a shuffle; a long one is joined by shuffle
    ids = small_or_none(materialize(ids.distinct(), "wanted"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.limit(0) if ids is None else rows.join(ids, "doc_id", "left_semi")
    return materialize(map_batches(rows, make, "doc_id: long, shingles: binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def make():
        def step(batch):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep)
            return [batch.column(0).filter(mask), batch.column(1).filter(mask)]

        return step

    first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return map_batches(joined, make, "a: long, b: long").distinct()


def _as_links(groups: DataFrame) -> DataFrame:
    return groups.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    made = materialize(sketches(docs, k), "sketches")
    named = made.where("n_shingles > 0")
    same = ("set_a", "set_b", "n_shingles")
    # the representative of each set, aggregated before any join on hot sets
    heads = materialize(named.groupBy(*same).agg(F.min("doc_id").alias("rep")), "heads")
    members = materialize(named.select("doc_id", *same).join(heads, list(same)).select("doc_id", "n_shingles", "rep"), "members")
    reps = named.join(heads.where("rep is not null").select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same], "left_semi")
    reps = materialize(reps.select("doc_id", "n_shingles", "labels", "sketch").dropDuplicates(["doc_id", "n_shingles"]), "reps")
    pairs = materialize(candidates(reps, percent), "pairs")
    # first the best candidate of every document
    ends = pairs.select(F.col("a").alias("u"), "guess", "a", "b").union(pairs.select(F.col("b").alias("u"), "guess", "a", "b"))
    best = ends.groupBy("u").agg(F.max(F.struct("guess", "a", "b")).alias("top")).select("top.a", "top.b").distinct()
    best = materialize(best, "best")
    sets = full_sets(ends.select(F.col("u").alias("doc_id")), docs, k)
    links = materialize(confirmed(best, sets, percent), "links")
    groups = materialize(components(links), "groups")
    # then those that would still join two components
    left, right = groups.select(F.col("node").alias("a"), F.col("component").alias("ca")), groups.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    rest = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    more = materialize(confirmed(materialize(rest, "rest"), sets, percent), "links")
    groups = materialize(components(_as_links(groups).union(more)), "groups")
    # then the regions that neighbours did not cover
    last = crowded(reps, groups, docs, percent, k)
    if last is not None:
        groups = materialize(components(_as_links(groups).union(materialize(last, "links"))), "groups")
    out = members.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.union(made.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
