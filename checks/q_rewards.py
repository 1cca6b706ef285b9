"""Scores from labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from factfeed.config import AnnotateConfig, RewardConfig
from factfeed.functions.numbers import lookup
from factfeed.operators import alignment as al
from factfeed.operators import rewards as rw
from factfeed.operators.annotation import drop_refusals
from factfeed.plans.score import score_from_completions

from . import fixtures as fx
from .ctes import INFO, INFO_VALUE, TRUTH, digit, drop_stop, query
from .registry import check

CONFIG = RewardConfig()


def _claims(spark, sf):
    return drop_refusals(fx.labels(spark, sf))


def _located(spark, sf, rows):
    texts = fx.outputs(spark, sf).select("answer_id", F.array_join("tokens", "").alias("answer"))
    return al.locate_sentences(rows.join(texts, "answer_id"))


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@check(
    "sentence_info",
    query(f"SELECT answer_id, sentence, round({INFO}, 6) AS info FROM labels_h GROUP BY answer_id, sentence", "labels_h"),
)
def sentence_info(spark, sf):
    return rw.sentence_info(fx.labels(spark, sf), CONFIG).withColumn("info", F.round("info", 6))


@check(
    "statement_truth",
    query(f"SELECT answer_id, sentence, statement, round({TRUTH}, 6) AS truth FROM labels_h", "labels_h"),
)
def statement_truth(spark, sf):
    rows = rw.statement_truth(fx.labels(spark, sf), CONFIG)
    return rows.select("answer_id", "sentence", "statement", F.round("truth", 6).alias("truth"))


_OTHER = RewardConfig(
    verification_map={"Correct": 0.45, "Hedged correct": 0.35, "Vague": -1, "Hedged wrong": -1.5, "Wrong": -1.7},
    informative_map={"5": 1.25, "4": 1, "3": 0.75, "2": 0.1, "1": -0.2},
    info_weight=1.2,
    truth_weight=0.5,
)
_V = "CASE verify WHEN 'Correct' THEN 0.45 WHEN 'Hedged correct' THEN 0.35 WHEN 'Vague' THEN -1 WHEN 'Hedged wrong' THEN -1.5 ELSE -1.7 END"
_A = "CASE assess WHEN '5' THEN 1.25 WHEN '4' THEN 1 WHEN '3' THEN 0.75 WHEN '2' THEN 0.1 ELSE -0.2 END"


@check(
    "label_value_maps",
    query(
        f"""SELECT answer_id, sentence, round((0.5 * sum({_V} * abs({_A})) + 1.2 * ln(greatest(-0.9, sum({_A})) + 1))::DOUBLE, 6) AS score
FROM labels_h GROUP BY answer_id, sentence""",
        "labels_h",
    ),
)
def label_value_maps(spark, sf):
    """Other label values and weights than the default ones."""
    return _rounded(rw.sentence_totals(fx.labels(spark, sf), _OTHER))


@check("locate_sentences", query("SELECT answer_id, sentence, sent_at::INTEGER AS sent_at, ans_at::INTEGER AS ans_at, n::INTEGER AS n FROM locs", "locs"))
def locate_sentences(spark, sf):
    rows = _located(spark, sf, _claims(spark, sf).select("answer_id", "sentence").distinct())
    return rows.select("answer_id", "sentence", "place.sent_at", "place.ans_at", "place.n")


@check("anchor_statements", query("SELECT answer_id, sentence, statement, anchor FROM anchors", "anchors"))
def anchor_statements(spark, sf):
    rows = al.anchor_statements(_located(spark, sf, _claims(spark, sf)))
    return rows.select("answer_id", "sentence", "statement", "anchor")


# statements that are no subsequence of their sentence: one in sixteen is reversed, one
# has other vowels. The SQL form fills the whole table of common lengths row by row.
_CHANGED = """CASE WHEN d = 0 THEN reverse(statement) WHEN d = 1 THEN replace(replace(statement, 'a', 'u'), 'e', 'o') ELSE statement END"""
_ANCHORS = query(
    "SELECT answer_id, sentence, claim, statement, CASE WHEN hit > 0 THEN (hit - 1 - sent_at + ans_at)::INTEGER END AS anchor FROM walk WHERE k = length(letters)",
    "walk",
    changed=(
        ("claims",),
        f"""SELECT answer_id, sentence, statement AS claim, {_CHANGED} AS statement, d
FROM (SELECT *, {digit("md5(answer_id || chr(31) || sentence || chr(31) || statement)", 3)} AS d FROM claims)""",
    ),
    common=(
        ("changed",),
        f"""SELECT DISTINCT s, t, 0 AS i, list_resize([]::INTEGER[], length(t) + 1, 0) AS r, [list_resize([]::INTEGER[], length(t) + 1, 0)] AS rs
  FROM (SELECT {drop_stop('statement')} AS s, {drop_stop('sentence')} AS t FROM changed WHERE d < 2)
  UNION ALL
  SELECT s, t, i + 1, r2, list_append(rs, r2)
  FROM (SELECT s, t, i, rs, list_concat([0], list_transform(range(1, length(t) + 1), lambda j: list_max(best[1:j]))) AS r2
    FROM (SELECT *, list_transform(range(1, length(t) + 1), lambda k: greatest(r[k + 1],
            CASE WHEN substr(t, k, 1) = substr(s, i + 1, 1) THEN r[k] + 1 ELSE 0 END)) AS best
          FROM common WHERE i < length(s)))""",
    ),
    back=(
        ("common",),
        """SELECT s, t, rs, i, list_position(r, list_max(r)) - 1 AS j, '' AS letters FROM common WHERE i = length(s)
  UNION ALL
  SELECT s, t, rs, CASE WHEN up OR NOT side THEN i - 1 ELSE i END, CASE WHEN NOT up THEN j - 1 ELSE j END,
    CASE WHEN NOT up AND NOT side THEN substr(s, i, 1) || letters ELSE letters END
  FROM (SELECT *, rs[i + 1][j + 1] = rs[i][j + 1] AS up, rs[i + 1][j + 1] = rs[i + 1][j] AS side FROM back WHERE i > 0 AND j > 0)""",
    ),
    walk=(
        ("changed", "back", "locs"),
        f"""SELECT c.answer_id, c.sentence, c.claim, c.statement, coalesce(b.letters, {drop_stop('c.statement')}) AS letters,
    {drop_stop('c.sentence')} AS sent, l.sent_at, l.ans_at, l.n, 0 AS k, 0::BIGINT AS pos, 0::BIGINT AS hit
  FROM changed c JOIN locs l ON l.answer_id = c.answer_id AND l.sentence = c.sentence
  LEFT JOIN (SELECT * FROM back WHERE i = 0 OR j = 0) b
    ON c.d < 2 AND b.s = {drop_stop('c.statement')} AND b.t = {drop_stop('c.sentence')}
  UNION ALL
  SELECT answer_id, sentence, claim, statement, letters, sent, sent_at, ans_at, n, k + 1, nxt,
    CASE WHEN nxt BETWEEN sent_at + 1 AND sent_at + n THEN nxt ELSE hit END
  FROM (SELECT *, pos + strpos(substr(sent, pos + 1), substr(letters, k + 1, 1)) AS nxt FROM walk WHERE k < length(letters))""",
    ),
)


@check("anchor_changed_statements", _ANCHORS)
def anchor_changed_statements(spark, sf):
    """Statements that only a common subsequence can place."""
    h = F.md5(F.concat_ws("\x1f", F.col("answer_id").cast("string"), "sentence", "statement"))
    d, said = fx.hex_digit(h, 3), F.col("statement")
    other = F.replace(F.replace(said, F.lit("a"), F.lit("u")), F.lit("e"), F.lit("o"))
    claims = _claims(spark, sf).select("answer_id", "sentence", said.alias("claim"), F.when(d == 0, F.reverse(said)).when(d == 1, other).otherwise(said).alias("statement"))
    placed = rw.place_sentences(fx.outputs(spark, sf), claims.select("answer_id", "sentence").distinct(), special=True)
    rows = al.anchor_statements(claims.join(placed, ["answer_id", "sentence"]))
    return rows.select("answer_id", "sentence", "claim", "statement", "anchor")


@check(
    "char_to_token",
    query(
        """SELECT l.answer_id, l.sentence, least(count(*) FILTER (s.cum <= l.idx), any_value(s.n) - 1)::INTEGER AS tok_no
FROM (SELECT answer_id, sentence, CASE WHEN n > 0 THEN ans_at + n - 1 ELSE -1 END AS idx FROM locs) l
JOIN spine s ON s.answer_id = l.answer_id GROUP BY l.answer_id, l.sentence""",
        "locs",
        "spine",
    ),
)
def char_to_token(spark, sf):
    texts = al.with_offsets(fx.outputs(spark, sf)).select("answer_id", "ends", "n_tokens", F.array_join("tokens", "").alias("answer"))
    rows = al.locate_sentences(_claims(spark, sf).select("answer_id", "sentence").distinct().join(texts, "answer_id"))
    tok = al.token_at(F.col("ends"), F.col("n_tokens"), al.last_char(F.col("place")))
    return rows.select("answer_id", "sentence", tok.alias("tok_no"))


_SPINE = """SELECT s.answer_id, s.tok_no::INTEGER AS tok_no, round(coalesce(t.score, 0), 6) AS score
FROM spine s LEFT JOIN {points} t ON t.answer_id = s.answer_id AND t.tok_no = s.tok_no"""
_TOKEN = query(_SPINE.format(points="token_scores"), "spine", "token_scores")


@check("token_rewards", _TOKEN)
def token_rewards(spark, sf):
    return _rounded(rw.reward_rows(rw.token_rewards(fx.outputs(spark, sf), _claims(spark, sf), CONFIG)))


_SENT_POINTS = """(SELECT answer_id, tok_no, sum(score) AS score FROM (
  SELECT l.answer_id, l.sentence, any_value(x.score) AS score,
    least(count(*) FILTER (s.cum <= l.idx AND s.tok_no < s.n - 1), any_value(s.n) - 1) AS tok_no
  FROM (SELECT answer_id, sentence, CASE WHEN n > 0 THEN ans_at + n - 1 ELSE -1 END AS idx FROM locs) l
  JOIN sent_scores x ON x.answer_id = l.answer_id AND x.sentence = l.sentence
  JOIN spine s ON s.answer_id = l.answer_id GROUP BY l.answer_id, l.sentence) GROUP BY answer_id, tok_no)"""


@check("sentence_rewards", query(_SPINE.format(points=_SENT_POINTS), "spine", "locs", "sent_scores"))
def sentence_rewards(spark, sf):
    return _rounded(rw.reward_rows(rw.sentence_rewards(fx.outputs(spark, sf), _claims(spark, sf), CONFIG)))


_ANSWER = query(
    """SELECT s.answer_id, s.tok_no::INTEGER AS tok_no, round(CASE WHEN s.tok_no = s.n - 1 THEN coalesce(t.score, 0) ELSE 0.25 END, 6) AS score
FROM spine s LEFT JOIN (SELECT answer_id, sum(score) AS score FROM sent_scores GROUP BY answer_id) t ON t.answer_id = s.answer_id""",
    "spine",
    "sent_scores",
)


@check("answer_rewards", _ANSWER)
def answer_rewards(spark, sf):
    config = RewardConfig(default_for_none=0.25)
    return _rounded(rw.reward_rows(rw.answer_rewards(fx.outputs(spark, sf), _claims(spark, sf), config)))


@check("rewards_by_granularity", _ANSWER)
def rewards_by_granularity(spark, sf):
    """Refusals are dropped by the dispatching function itself."""
    config = RewardConfig(granularity="answer", default_for_none=0.25)
    return _rounded(rw.reward_rows(rw.labels_to_rewards(fx.outputs(spark, sf), fx.labels(spark, sf), config)))


@check(
    "label_scores",
    query(f"SELECT answer_id, sentence, statement, {INFO_VALUE} AS score FROM labels_h", "labels_h"),
)
def label_scores(spark, sf):
    return fx.labels(spark, sf).select(
        "answer_id", "sentence", "statement", lookup(CONFIG.informative_map, F.col("assess")).alias("score")
    )


def _job_sql() -> str:
    from .ctes import CTES

    saved = CTES["labels_h"]
    CTES["labels_h"] = (("paired",), "SELECT * FROM paired")
    try:
        return query(_SPINE.format(points="token_scores"), "spine", "token_scores")
    finally:
        CTES["labels_h"] = saved


@check("scoring_job", _job_sql())
def scoring_job(spark, sf):
    """From model texts to token scores in one plan."""
    done = score_from_completions(
        fx.outputs(spark, sf), fx.extractions(spark, sf), fx.completions(spark, sf), CONFIG, AnnotateConfig()
    )
    return _rounded(rw.reward_rows(done.scores))
