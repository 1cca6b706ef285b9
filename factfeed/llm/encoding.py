"""Token ids of whole texts, exactly as the tokenizers library gives them.

Encoding a running text with the library spends most of its time on normalizing
and splitting. For the one pre-tokenization described in `FAMILY` no token spans
white space, so that each distinct white-space-free word of a batch is encoded
once and its ids are looked up for all its occurrences. Texts with characters for
which Python's lower-casing or white space might differ from the library's, or
with the text of a special token, go to the library as they are; so does
everything under any other tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

# The normalizer and splitter for which words can be encoded apart.
FAMILY = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
)
KNOWN_WORDS = 600_000  # words kept with their ids; then the memory starts anew


def encoder(name: str):
    """A function from a list of texts to a list of id arrays."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)

    def library(values: list[str]) -> list[np.ndarray]:
        found = tokenizer.encode_batch(values, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    try:
        steps = spec["pre_tokenizer"]["pretokenizers"]
        family = (
            (spec["normalizer"]["normalizers"], steps[0]["pattern"]["Regex"]) == FAMILY
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
            and spec["post_processor"] is None
        )
    except (KeyError, TypeError, IndexError):
        family = False
    return _by_word(tokenizer, library, spec) if family else library


def _by_word(tokenizer, library, spec):
    special = [t["content"] for t in spec["added_tokens"]]
    # beyond U+017F lower case differs; U+0130 changes its length in lower case; U+001C-U+001F are white space in Python only
    strange = re.compile("[^\t-\r -~\x80-įı-ſ]|" + "|".join(map(re.escape, special)))
    letters = "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == "L")
    digits = "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == "N")
    split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits}]+")
    spelled = _byte_letters()
    model = tokenizer.model

    def ids_of(part: str) -> list[int]:
        if not part.isascii():
            part = "".join(map(spelled.__getitem__, part.encode()))
        return [t.id for t in model.tokenize(part)]

    known = _Numbers()
    parts: dict[str, list[int]] = {}
    flat = np.empty(0, np.uint32)  # ids of all known words
    edges = np.zeros(1, np.int64)  # of word i: flat[edges[i]:edges[i + 1]]

    def learn(words: list[str]) -> None:
        nonlocal flat, edges
        new: list[int] = []
        ends = []
        for word in words:
            if word.isalpha():
                new += ids_of(word)
            else:
                for part in split.findall(word):
                    ids = parts.get(part)
                    if ids is None:
                        ids = parts[part] = ids_of(part)
                    new += ids
            ends.append(len(new))
        edges = np.concatenate([edges, len(flat) + np.array(ends, np.int64)])
        flat = np.concatenate([flat, np.array(new, np.uint32)])

    def encode(values: list[str]) -> list[np.ndarray]:
        nonlocal flat, edges
        out: list = [None] * len(values)
        plain = [i for i, v in enumerate(values) if not strange.search(v)]
        other = sorted(set(range(len(values))) - set(plain))
        for i, ids in zip(other, library([values[i] for i in other]), strict=True):
            out[i] = ids
        if len(known) > KNOWN_WORDS:
            known.clear()
            parts.clear()
            flat, edges = flat[:0].copy(), edges[:1].copy()
        words: list[str] = []
        counts = []
        for i in plain:
            found = values[i].lower().split()
            words += found
            counts.append(len(found))
        code = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        learn(known.new)
        known.new.clear()
        lens = edges[code + 1] - edges[code]
        at = np.concatenate([[0], np.cumsum(lens)])
        place = np.arange(at[-1]) + np.repeat(edges[code] - at[:-1], lens)
        ids = flat[place]
        upto = at[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        for i, a, b in zip(plain, upto[:-1], upto[1:], strict=True):
            out[i] = ids[a:b]
        return out

    return encode


class _Numbers(dict):
    """Numbers words as they first come and remembers the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


def _byte_letters() -> list[str]:
    """The published byte-level alphabet: printable bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out
