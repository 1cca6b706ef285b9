"""Toxicity after noisy-channel deobfuscation.

Disguised spellings are restored first. A suspicious stretch of text (letters mixed
with look-alike digits or signs, a letter three or more times in a row, letters set
apart by spaces or signs) becomes a lattice: each character may be itself, a letter
it looks like, one of several copies, or a separator that was put in. A Viterbi pass
finds the path that is likeliest under a character trigram model times the channel's
cost. Text without such a stretch is its own restoration.

The scorer is a lexicon learned from labelled documents: whole restored words and
word beginnings of 4 to 7 letters, with a smoothed share of toxic documents among
those that have them. A word counts by its surest entry, and the words of a text
combine as independent evidence, 1 - prod(1 - p).

The character model counts all training documents, labelled or not. The lexicon is
fitted on about `FIT_ROWS` labelled ones (chosen by a hash of doc_id), of which near
copies, by the sketches of their whole shingle sets, count once. Both are bounded:
ALPHABET**3 trigram counts and at most MOST_ENTRIES lexicon entries.

Null and empty texts have no words and the lowest score. Labels with a null are
ignored; of several labels of one document the highest counts. Repeated rows are
scored each. With no labelled rows every text has the lowest score. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts
from .lsh_forest import shingle_sets

FIT_ROWS = 20_000
MOST_ENTRIES = 50_000
LEAST_TOXIC, LEAST_SHARE = 6, 0.9  # of a lexicon entry: toxic documents, and their share
PRIOR_WEIGHT = 1.0
ALPHABET = 64
FLOOR = 0.01  # score of a text without an entry

# Signs and the letters they stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
PUT_IN = "*|+#!"  # signs that may also have been put between letters
SKETCH, ALIKE = 16, 8  # minima of a shingle set, and how many of them near copies share
COST = 1.0  # of reading a sign as a letter, in nats
SIGNS = re.escape("".join(LOOKALIKES))
LETTER = r"[^\W\d_]"
# a run of letters is tried from its first letter only, and given up as a whole
AROUND = rf"(?<!{LETTER}){LETTER}++[{SIGNS}]+{LETTER}+(?:[{SIGNS}]*{LETTER}+)*"  # letters around signs
BEFORE = rf"(?<![\w{SIGNS}])[{SIGNS}]{{1,3}}{LETTER}+(?:[{SIGNS}]*{LETTER}+)*"  # signs before letters
REPEATED = rf"\w*({LETTER})\1\1\w*"
APART = rf"(?<!\w)(?:{LETTER}[ .\-_*~]{{1,2}}){{3,}}{LETTER}(?!\w)"  # letters set apart
# what a text must hold for a pattern to match; few texts hold any of it
SIGNED = re.compile(rf"[{SIGNS}]{LETTER}")
THRICE = re.compile(rf"({LETTER})\1\1")
SINGLE = re.compile(rf"[ .\-_*~]{LETTER}[ .\-_*~]{{1,2}}{LETTER}[ .\-_*~]")
WORD = re.compile(r"[^\W\d_]+")


def suspicious(value: str) -> re.Pattern | None:
    """The pattern of all stretches this text may hold; None if there are none."""
    parts = [AROUND, BEFORE] if SIGNED.search(value) else []
    parts += [REPEATED] if THRICE.search(value) else []
    parts += [APART] if SINGLE.search(value) else []
    return re.compile("|".join(parts)) if parts else None  # compiled once: re keeps it


class Model(NamedTuple):
    letters: str
    trigrams: np.ndarray  # log-probabilities, ALPHABET ** 3
    entries: dict[str, float]


class Reader:
    """Restores stretches of text; keeps what it has read."""

    def __init__(self, letters: str, trigrams: np.ndarray):
        self.code = {c: i + 1 for i, c in enumerate(letters)}  # 0: border, last: any other
        self.other = ALPHABET - 1
        self.trigrams = trigrams.reshape(ALPHABET, ALPHABET, ALPHABET).tolist() if len(trigrams) else None
        self.known: dict[str, str] = {}

    def text(self, value: str) -> str:
        """Restoration of a lower-cased text."""
        if self.trigrams is None:
            return value
        found = suspicious(value)
        return found.sub(lambda m: self.stretch(m[0]), value) if found else value

    def stretch(self, raw: str) -> str:
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[raw] = self._viterbi(raw)
        return found

    def _lattice(self, raw: str) -> list[list[tuple[str, float]]]:
        """For each run of one character: what it may stand for, with its cost."""
        apart = re.fullmatch(r"(?:\w\W{1,2})+\w", raw) is not None
        out = []
        for m in re.finditer(r"(.)\1*", raw, re.S):
            c, n = m[1], len(m[0])
            if c.isalpha():
                ways = [(c, 0.0 if n == 1 else 0.5)]
                if n > 1:
                    ways.append((c * 2, 0.0 if n == 2 else 0.5))
                if n == 3:
                    ways.append((c * 3, 1.0))
            else:
                ways = [(x * k, COST) for x in LOOKALIKES.get(c, "") for k in {1, min(n, 2)}]
                if apart or n <= 2 and c in PUT_IN:
                    ways.append(("", 0.0 if apart else 2 * COST))
                ways.append((m[0], 0.0 if not apart else 3 * COST))
            out.append(ways)
        return out

    def _viterbi(self, raw: str) -> str:
        other, code, logp = self.other, self.code, self.trigrams
        # state: the last two letters, at most ALPHABET ** 2; value: (cost, text)
        states = {(0, 0): (0.0, "")}
        for ways in [*self._lattice(raw), [("\0", 0.0)]]:
            new: dict = {}
            for (a, b), (cost, text) in states.items():
                for emitted, price in ways:
                    x, y, total = a, b, cost + price
                    for c in emitted:
                        z = 0 if c == "\0" else code.get(c, other)
                        total -= logp[x][y][z]
                        x, y = y, z
                    had = new.get((x, y))
                    if had is None or total < had[0]:
                        new[(x, y)] = (total, text + emitted)
            states = new
        return min(states.values())[1].rstrip("\0")


def features(word: str) -> list[str]:
    return [f"={word}", *[word[:n] for n in range(4, min(len(word), 7) + 1)]]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of about FIT_ROWS labelled documents, near copies once."""
    own = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    own = own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    part = int(min(1.0, FIT_ROWS / max(own.count(), 1)) * 1_000_000)
    few = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    odd = np.random.default_rng(SKETCH).integers(1 << 63, size=SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def make():
        def step(batch):
            sets = shingle_sets(batch.column(1), 5)
            low = [int(s[0].view(np.int64)) if len(s) else 0 for s in sets]
            sketch = [np.array([(s * m).min() for m in odd]).tobytes() if len(s) else bytes(8 * SKETCH) for s in sets]
            return [batch.column(i) for i in range(3)] + [pa.array(low, pa.int64()), pa.array(sketch, pa.binary())]

        return step

    def thin(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH)
        return rows.take(pa.array(unlike(sketches), pa.int64())).select(["text", "toxic"])

    # about FIT_ROWS rows of two numbers, whatever the tables' sizes
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(few), "doc_id")
    rows = rows.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int"))
    keyed = map_batches(rows, make, "doc_id: long, text: string, toxic: int, low: long, sketch: binary")
    # a group has documents that share their smallest shingle, FIT_ROWS of them at most
    return keyed.groupBy("low").applyInArrow(thin, "text: string, toxic: int")


def unlike(sketches: np.ndarray) -> list[int]:
    """Rows of which no earlier one of them is a near copy."""
    kept: list[int] = []
    held = np.empty_like(sketches)
    for i, row in enumerate(sketches):
        if not ((held[: len(kept)] == row).sum(axis=1) >= ALIKE).any():
            held[len(kept)] = row
            kept.append(i)
    return kept


def _letters() -> np.ndarray:
    """Which code points are letters, as WORD has them."""
    return np.array([chr(c).isalnum() and not chr(c).isdecimal() for c in range(0x110000)])


def _joined(values: list[str]) -> np.ndarray:
    """Code points of lower-cased texts, set apart by blanks."""
    return np.frombuffer(" ".join(v.lower() for v in values).encode("utf-32-le", "surrogatepass"), np.uint32)


def trigram_line(chars: np.ndarray, letters: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Codes of the words, two borders (0) around each; words with a letter three
    times in a row are left out."""
    at = np.flatnonzero(letters[chars])
    if not len(at):
        return np.zeros(2, np.int64)
    c = chars[at]
    word = np.cumsum(np.concatenate([[0], np.diff(at) > 1]))
    if len(at) > 2:
        thrice = (c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & (at[2:] - at[:-2] == 2)
        drop = np.zeros(word[-1] + 1, bool)
        drop[word[2:][thrice]] = True
        c, word = c[~drop[word]], word[~drop[word]]
        word = np.cumsum(np.concatenate([[0], np.diff(word) > 0])) if len(word) else word
    line = np.zeros(len(c) + 2 * (word[-1] + 2 if len(word) else 1), np.int64)
    line[2 + np.arange(len(c)) + 2 * word] = codes[c]
    return line


def _counted(docs: DataFrame, make_count, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums of an array of `size` counts that every task fills from all texts."""

    def make():
        counts = np.zeros(size, np.int64)
        count = make_count()

        def step(batch):
            values = texts(batch.column(0))
            for a in range(0, len(values), 256):
                counts[:] += np.bincount(count(_joined(values[a : a + 256])), minlength=size)

        def finish():
            at = np.flatnonzero(counts)
            return [[pa.array(at), pa.array(counts[at])]] if len(at) else []

        return step, finish

    rows = map_batches(docs.select(F.col("text").cast("string")), make, "at: long, n: long")
    found = rows.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    return found.column("at").to_numpy(), found.column("n").to_numpy()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows among `docs`."""
    from factfeed.session import materialize

    sample = materialize(_sample(docs, labels), "toxic-fit")

    def letters_of():
        known = _letters()
        return lambda chars: chars[known[chars]]

    at, n = _counted(docs, letters_of, 0x110000)
    letters = "".join(sorted(chr(c) for c in at[np.lexsort((at, -n))][: ALPHABET - 2]))

    def trigrams_of():
        known, codes = _letters(), np.full(0x110000, ALPHABET - 1, np.int64)
        for i, c in enumerate(letters):
            codes[ord(c)] = i + 1

        def count(chars):
            line = trigram_line(chars, known, codes)
            return (line[:-2] * ALPHABET + line[1:-1]) * ALPHABET + line[2:]

        return count

    at, n = _counted(docs, trigrams_of, ALPHABET**3)
    trigrams = _trigram_model(at, n) if len(at) else np.empty(0)

    def make_features():
        both: Counter = Counter()
        toxic: Counter = Counter()
        reader = Reader(letters, trigrams)

        def step(batch):
            for value, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                mine = {f for w in set(WORD.findall(reader.text(value.lower()))) for f in features(w)}
                both.update(mine)
                if label:
                    toxic.update(mine)

        def finish():
            names = list(both)
            for a in range(0, len(names), 50_000):
                part = names[a : a + 50_000]
                yield [pa.array(part), pa.array([toxic[f] for f in part]), pa.array([both[f] for f in part])]

        return step, finish

    counted = map_batches(sample, make_features, "name: string, toxic: long, n: long")
    counted = counted.groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    whole = sample.agg(F.avg("toxic")).first()[0] or 0.0
    sure = counted.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") >= LEAST_SHARE * F.col("n")))
    sure = sure.orderBy(F.desc("toxic"), "name").limit(MOST_ENTRIES).collect()
    entries = {r["name"]: (r["toxic"] + PRIOR_WEIGHT * whole) / (r["n"] + PRIOR_WEIGHT) for r in sure}
    return Model(letters, trigrams, entries)


def _trigram_model(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Trigrams mixed with bigrams and single letters, as log-probabilities."""
    tri = np.zeros(ALPHABET**3)
    tri[at] = n
    tri = tri.reshape(ALPHABET, ALPHABET, ALPHABET)
    bi = tri.sum(axis=0)
    one = bi.sum(axis=0)
    p1 = (one + 1) / (one.sum() + ALPHABET)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32).ravel()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, restored (the text after deobfuscation, null where it is the lower-cased
    text itself), score."""
    # a plain tuple: workers need not have the class
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def make():
        m = Model(*shared.value)
        reader = Reader(m.letters, m.trigrams)
        known: dict[str, float] = {}

        def word(w: str) -> float:
            return max((m.entries.get(f, 0.0) for f in features(w)), default=0.0)

        def step(batch):
            restored, scores = [], []
            for value in texts(batch.column(1)):
                value = value.lower()
                clean = reader.text(value)
                restored.append(clean if clean != value else None)
                if len(known) > 400_000:
                    known.clear()
                rest = 1.0 - FLOOR
                for w in set(WORD.findall(clean)):
                    p = known.get(w)
                    if p is None:
                        p = known[w] = word(w)
                    if p:
                        rest *= 1.0 - p
                scores.append(1.0 - rest)
            return [batch.column(0), pa.array(restored, pa.string()), pa.array(scores, pa.float64())]

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, make, "doc_id: long, restored: string, score: double")


def judged(docs: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """Scores of all documents by a model that knows only the labels of `training` rows."""
    return score(docs, fit(docs.where(training), labels))
