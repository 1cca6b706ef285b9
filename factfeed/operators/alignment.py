"""Finding sentences and statements again in the answer text.

Lengths and positions are in characters. All of it are column expressions: folds
over one sentence and one answer at a time, so a row's work follows its own texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import bind
from ..functions.text import chars

_WORD = 62  # sentence positions in a number: a sum of two and a carry fits 64 bits
_FULL = 2**_WORD - 1


def common_run(sentence: Column, answer: Column) -> Column:
    """(sent_at, ans_at, n) of the longest common substring; leftmost in the
    answer, then leftmost in the sentence.

    A window moves over the sentence, one character longer than the best so far: it
    grows while the answer contains it, by twice as many characters after a success
    and half as many after a failure, else it moves on. A move, a success and the
    failures that undo successes are at most 2 n + 1 steps for n characters; a sentence
    that has long parts of the answer takes few searches. A second pass finds the
    leftmost place of the windows that are as long as the longest.
    """
    n = F.length(sentence)

    def state(i: Column, best: Column, by: Column) -> Column:
        return F.struct(i.alias("i"), best.alias("best"), by.alias("by"))

    def move(s: Column, _: Column) -> Column:
        i, best, by = s["i"], s["best"], s["by"]
        longer = best + by
        grows = (i + longer <= n + 1) & F.contains(answer, F.substring(sentence, i, longer))
        return (
            F.when(i + best > n, s)  # what is left of the sentence cannot beat the best
            .when(grows, state(i, longer, by * 2))
            .when(by > 1, state(i, best, (by / 2).cast("int")))
            .otherwise(state(i + 1, best, by))
        )

    steps = F.when(n > 0, F.sequence(F.lit(1), 2 * n + 1)).otherwise(F.array().cast("array<int>"))
    best = F.aggregate(steps, state(F.lit(1), F.lit(0), F.lit(1)), move, lambda s: s["best"])

    def leftmost(longest: Column) -> Column:
        starts = F.sequence(F.lit(1), n - longest + 1)
        found = F.filter(starts, lambda i: F.contains(answer, F.substring(sentence, i, longest)))
        places = F.transform(
            found,
            lambda i: F.struct(
                (F.position(F.substring(sentence, i, longest), answer) - 1).alias("ans_at"), (i - 1).alias("sent_at")
            ),
        )
        in_order = lambda first: F.struct(first["sent_at"].alias("sent_at"), first["ans_at"].alias("ans_at"), longest.alias("n"))
        return F.get(F.transform(F.array(F.array_min(places)), in_order), F.lit(0))

    nothing = F.struct(F.lit(0).alias("sent_at"), F.lit(0).alias("ans_at"), F.lit(0).alias("n"))
    # a result that is used twice is bound to a name by a one-element transform
    return F.get(F.transform(F.array(best), lambda b: F.when(b > 0, leftmost(b)).otherwise(nothing)), F.lit(0))


def common_letters(statement: Column, sentence: Column) -> Column:
    """A longest common subsequence, read back from its earliest end.

    For every prefix of the statement the sentence positions are kept at which a common
    subsequence of one more letter can end first: as the zero bits of words of `_WORD`
    positions, so that one more letter is a sum and three masks a word (the published
    bit-vector form, Hyyro 2004). Reading back, a letter is taken where the row before
    it has an end less among the positions left; it lies at the last end among them.
    """
    n = F.length(sentence)
    full = F.lit(_FULL).cast("bigint")
    words = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / _WORD).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )

    def reversed_word(w: Column) -> Column:
        places = F.sequence(F.least(n, (w + 1) * _WORD), w * _WORD + 1, F.lit(-1))
        return F.transform(places, lambda i: F.substring(sentence, i, F.lit(1)))

    def longest(letters: Column) -> Column:
        own = F.array_distinct(letters)

        def with_words(parts: Column) -> Column:
            def mask(c: Column) -> Column:
                bits = lambda part: F.array_join(F.transform(part, lambda x: F.when(x == c, "1").otherwise("0")), "")
                return F.transform(parts, lambda part: F.call_function("conv", bits(part), F.lit(2), F.lit(10)).cast("bigint"))

            return F.transform(F.array(F.map_from_arrays(own, F.transform(own, mask))), rows_of)

        def rows_of(masks: Column) -> Column:
            def extend(rows: Column, c: Column) -> Column:
                def add(s: Column, pair: Column) -> Column:
                    v, m = pair["v"], pair["m"]
                    total = v + v.bitwiseAND(m) + s["carry"]
                    new = total.bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)
                    return F.struct(F.shiftright(total, _WORD).alias("carry"), F.array_append(s["row"], new).alias("row"))

                zero = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("row"))
                pairs = F.zip_with(F.element_at(rows, -1), F.element_at(masks, c), lambda v, m: F.struct(v.alias("v"), m.alias("m")))
                return F.array_append(rows, F.aggregate(pairs, zero, add)["row"])

            return F.aggregate(letters, F.array(F.transform(words, lambda _: full)), extend)

        def read_back(rows: Column) -> Column:
            def ends(i: Column, until: Column) -> Column:
                """Ends of row i up to a position, word by word."""

                def word(v: Column, w: Column) -> Column:
                    left = F.least(F.greatest(until - w * _WORD, F.lit(0)), F.lit(_WORD))
                    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), left.cast("int")) - 1
                    return F.bitwise_not(v).bitwiseAND(low)

                return F.transform(F.get(rows, i), word)

            def count(found: Column) -> Column:
                return F.aggregate(found, F.lit(0), lambda a, x: a + F.bit_count(x))

            def last(found: Column) -> Column:
                return F.array_max(F.transform(found, lambda x, w: F.when(x != 0, w * _WORD + F.length(F.bin(x)))))

            def pick(s: Column, i: Column) -> Column:
                taken = count(ends(i, s["until"])) > count(ends(i - 1, s["until"]))
                end = last(ends(i, s["until"]))
                more = F.struct((end - 1).alias("until"), F.concat(F.get(letters, i - 1), s["text"]).alias("text"))
                return F.when(taken, more).otherwise(s)

            steps = F.when(F.size(letters) > 0, F.sequence(F.size(letters), F.lit(1), F.lit(-1)))
            end = last(ends(F.size(letters), n))
            zero = F.struct(F.coalesce(end, F.lit(0)).alias("until"), F.lit("").alias("text"))
            return F.coalesce(F.aggregate(steps, zero, pick, lambda s: s["text"]), F.lit(""))

        rows = F.get(F.get(F.transform(F.array(F.transform(words, reversed_word)), with_words), F.lit(0)), F.lit(0))
        return F.get(F.transform(F.array(rows), read_back), F.lit(0))

    # results are bound to names by one-element transforms
    letters = F.filter(chars(statement), lambda c: c != "")
    return F.get(F.transform(F.array(letters), longest), F.lit(0))


def locate_sentences(df: DataFrame, sentence: str = "sentence", answer: str = "answer") -> DataFrame:
    """Add place: (sent_at, ans_at, n) of the longest common substring; null if one
    of the texts is null."""
    df = bind(df, "_at", F.position(F.col(sentence), F.col(answer)))
    verbatim = F.struct(
        F.lit(0).alias("sent_at"), (F.col("_at") - 1).alias("ans_at"), F.length(sentence).alias("n")
    )
    place = F.when(F.col("_at") > 0, verbatim).when(F.col("_at") == 0, common_run(F.col(sentence), F.col(answer)))
    return bind(df, "place", place).drop("_at")


def last_char(place: Column) -> Column:
    """Answer position of the last matched character, -1 if none matched."""
    return F.when(place["n"] > 0, place["ans_at"] + place["n"] - 1).otherwise(F.lit(-1))


def _drop_stop(col: Column) -> Column:
    return F.when(F.endswith(col, F.lit(".")), F.substring(col, F.lit(1), F.length(col) - 1)).otherwise(col)


def _walk(letters: Column, sentence: Column, place: Column) -> Column:
    """Match letters one after the other at their earliest positions.

    Returns at (0 once a letter is missing, else the last position) and hit,
    the last position that lies in the placed part of the sentence; 1-based.
    """
    low, high = place["sent_at"] + 1, place["sent_at"] + place["n"]

    def step(s: Column, c: Column) -> Column:
        nxt = F.when(s["lost"], F.lit(0)).otherwise(F.position(c, sentence, s["at"] + 1))
        inside = (nxt >= low) & (nxt <= high)
        return F.struct(
            (s["lost"] | (nxt == 0)).alias("lost"),
            nxt.alias("at"),
            F.when(inside, nxt).otherwise(s["hit"]).alias("hit"),
        )

    zero = F.struct(F.lit(False).alias("lost"), F.lit(0).alias("at"), F.lit(0).alias("hit"))
    return F.aggregate(F.filter(chars(letters), lambda c: c != ""), zero, step)


def anchor_statements(df: DataFrame) -> DataFrame:
    """Add anchor: answer position of the last statement character that is
    aligned with a placed character of the sentence; null if there is none.

    Needs statement, sentence and place. One final full stop of either text is
    left out. Statements whose letters do not all occur in order are matched by a
    longest common subsequence.
    """
    place = F.col("place")
    df = df.withColumn("_stat", _drop_stop(F.col("statement"))).withColumn(
        "_sent", _drop_stop(F.col("sentence"))
    )
    df = bind(df, "_full", _walk(F.col("_stat"), F.col("_sent"), place))
    lost = F.col("_full.lost")
    df = bind(df, "_letters", F.when(lost, common_letters(F.col("_stat"), F.col("_sent"))))
    part = F.when(lost, _walk(F.col("_letters"), F.col("_sent"), place)["hit"]).otherwise(F.col("_full.hit"))
    df = bind(df, "_hit", part)
    anchor = F.when(F.col("_hit") > 0, F.col("_hit") - 1 - place["sent_at"] + place["ans_at"])
    return df.withColumn("anchor", anchor).drop("_stat", "_sent", "_full", "_letters", "_hit")


def with_offsets(outputs: DataFrame, special: bool = True) -> DataFrame:
    """Add ends (cumulated token lengths) and n_tokens to (tokens, special).

    With special=False the special tokens are left out of the offsets.
    """
    tokens = F.col("tokens")
    if not special:
        tokens = F.filter(tokens, lambda t, i: ~F.get("special", i))

    def add(acc: Column, t: Column) -> Column:
        end = acc["end"] + F.length(t)
        return F.struct(end.alias("end"), F.array_append(acc["ends"], end).alias("ends"))

    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("ends"))
    return bind(outputs, "ends", F.aggregate(tokens, zero, add)["ends"]).withColumn(
        "n_tokens", F.size("tokens")
    )


def token_at(ends: Column, n_tokens: Column, char: Column) -> Column:
    """Token holding a character position, at most the last token.

    The ends are in order: the number of those up to the position is found by halving.
    """
    steps = F.sequence(F.lit(0), F.length(F.bin(n_tokens)))

    def halve(s: Column, _: Column) -> Column:
        low, high = s["low"], s["high"]
        mid = F.shiftright(low + high, 1)
        up = F.struct((mid + 1).alias("low"), high.alias("high"))
        return F.when(low == high, s).when(F.get(ends, mid) <= char, up).otherwise(F.struct(low.alias("low"), mid.alias("high")))

    whole = F.struct(F.lit(0).alias("low"), F.size(ends).alias("high"))
    return F.least(F.aggregate(steps, whole, halve, lambda s: s["low"]), n_tokens - 1)
