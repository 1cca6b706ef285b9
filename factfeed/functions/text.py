"""Sentences, word tokens, trimming and HTML escapes."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SENTENCE = r"[^.!?\n]+[.!?]*"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def raw_sentences(col: Column) -> Column:
    """Sentence pieces with their leading blanks kept."""
    return F.regexp_extract_all(col, F.lit(SENTENCE), F.lit(0))


def sentences(col: Column) -> Column:
    """Trimmed, non-blank sentences in text order."""
    return F.filter(F.transform(raw_sentences(col), strip), lambda s: s != "")


def drop_stops(tokens: Column, stops: Sequence[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(list(stops)))


def word_tokens(col: Column, stops: Sequence[str] | None = None) -> Column:
    """Runs of letters and digits, every other visible character by itself."""
    tokens = F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))
    return drop_stops(tokens, stops) if stops else tokens


def token_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(TOKEN))


def chars(col: Column) -> Column:
    return F.split(col, "")


# A character reference: decimal, hexadecimal, or a name (which may run on into text).
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Names that count without a semicolon too, the longest first.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
# Numbers 128 to 159 are read as the Windows code page, where it has a character.
_WINDOWS = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)]


def _from_number(number: Column) -> Column:
    """Character of a code point as HTML reads it; null is a number out of range."""
    between = lambda low, high: number.between(low, high)
    nothing = (
        between(0x1, 0x8) | (number == 0xB) | between(0xE, 0x1F) | (number == 0x7F)
        | between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    windows = F.element_at(F.array(*[F.lit(c) for c in _WINDOWS]), (number - 0x7F).cast("int"))
    return (
        F.when(number.isNull() | (number == 0) | between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("\ufffd"))
        .when(between(0x80, 0x9F), windows)
        .when(nothing, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def _resolve(reference: Column) -> Column:
    """Text of one character reference, itself if its name is unknown."""
    names = F.str_to_map(
        F.lit("\x01".join(f"{n}\x02{c}" for n, c in html5.items())), F.lit("\x01"), F.lit("\x02")
    )
    digits = F.regexp_extract(reference, r"^&#(?:[xX]0*([0-9a-fA-F]*)|0*[0-9]*)", 1)
    digits = F.when(reference.rlike("^&#[xX]"), digits).otherwise(F.regexp_extract(reference, r"^&#0*([0-9]*)", 1))
    base = F.when(reference.rlike("^&#[xX]"), 16).otherwise(10)
    number = F.when(F.length(digits) == 0, F.lit(0)).when(
        F.length(digits) <= 8, F.call_function("conv", digits, base, F.lit(10)).cast("bigint")
    )
    name = F.substring(reference, 2, 40)
    known = F.try_element_at(names, name)
    bare = F.regexp_extract(name, f"^({_BARE})", 1)
    rest = F.substr(name, F.length(bare) + 1)
    named = F.coalesce(known, F.when(bare != "", F.concat(F.try_element_at(names, bare), rest)), reference)
    return F.when(F.startswith(reference, F.lit("&#")), _from_number(number)).otherwise(named)


def unescape_html(col: Column) -> Column:
    """Resolve character references as HTML 5 does; a text without "&" is left as it is."""
    parts = F.split(col, REFERENCE, -1)
    found = F.regexp_extract_all(col, F.lit(REFERENCE), F.lit(0))
    tails = F.zip_with(F.transform(found, _resolve), F.slice(parts, F.lit(2), F.size(found)), lambda a, b: F.concat(a, b))
    return F.when(F.contains(col, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(tails, ""))).otherwise(col)


def escape_html(col: Column) -> Column:
    # fixed values: the five escaped characters, "&" first
    for char, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    ):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def fill(template: str, values: dict[str, Column]) -> Column:
    """Replace the {name} marks of a template one after the other."""
    col = F.lit(template)
    for name, value in values.items():
        col = F.replace(col, F.lit("{" + name + "}"), value)
    return col
