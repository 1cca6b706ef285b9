"""Token counts with a whole-token shortcut.

`whole_tokens` proves once, on the driver, which vocabulary strings encode alone
as one token: a piece that starts with the word mark and whose plain text the
library encodes to just that piece. Where no piece has the mark behind another
character, no merge crosses a space, so a text is the sum of its space-separated
words. A word of the proven set counts one; each other distinct word of a batch
is merged once by the library. Texts that begin or end with a space, repeat one
or hold the mark itself are counted whole by the library, as is everything under
a vocabulary for which the proof fails.

Null and empty texts have 0 tokens. Repeated rows are counted each. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

MARK = "▁"
KNOWN_WORDS = 600_000  # words kept with their counts in a task; then it starts anew


def _library(name: str):
    import public_tokenizers
    import sentencepiece

    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    return sentencepiece.SentencePieceProcessor(model_file=path)


def whole_tokens(name: str) -> frozenset[str] | None:
    """Words that are one token, or None if words can't be counted apart."""
    model = _library(name)
    size = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
    pieces = [model.id_to_piece(i) for i in range(size) if not special[i]]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        return None
    # a word mark is put before the text, and no other space is added or dropped
    if model.encode("a  b ", out_type=str) != model.encode(MARK + "a  b ", out_type=str)[-len(model.encode("a  b ", out_type=str)) :]:
        return None
    probe = "a  b c "
    if "".join(model.encode(probe, out_type=str)) != MARK + probe.replace(" ", MARK):
        return None
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return frozenset(w for w, e in zip(words, model.encode(words, num_threads=1), strict=True) if len(e) == 1)


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    whole = whole_tokens(model)  # at most the vocabulary, a fixed size

    def make():
        library = _library(model)
        counts: dict[str, int] = {}

        def by_word(values: list[str]) -> np.ndarray:
            out = np.zeros(len(values), np.int64)
            odd = [i for i, v in enumerate(values) if v[:1] == " " or v[-1:] == " " or "  " in v or MARK in v]
            for i, e in zip(odd, library.encode([values[i] for i in odd], num_threads=1), strict=True):
                out[i] = len(e)
            if not counts or len(counts) > KNOWN_WORDS:
                counts.clear()
                counts.update(dict.fromkeys(whole, 1))
            odd = set(odd)
            parts = [(i, v.split(" ")) for i, v in enumerate(values) if v and i not in odd]
            new = [w for w in {w for _, p in parts for w in p} if w not in counts]
            for a in range(0, len(new), 4096):
                for w, e in zip(new[a : a + 4096], library.encode(new[a : a + 4096], num_threads=1), strict=True):
                    counts[w] = len(e)
            for i, p in parts:
                out[i] = sum(map(counts.__getitem__, p))
            return out

        def whole_text(values: list[str]) -> np.ndarray:
            return np.array([len(e) for e in library.encode(values, num_threads=1)], np.int64)

        count = by_word if whole is not None else whole_text

        def step(batch):
            values = texts(batch.column(1))
            found = [count(values[a : a + 256]) for a in range(0, len(values), 256)]
            return [batch.column(0), batch.column(2), pa.array(np.concatenate(found))]

        return step

    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return map_batches(rows, make, "doc_id: long, n_bytes: long, n_tokens: long")
