"""Sequence tables for policy training."""

from __future__ import annotations

from pyspark.sql import functions as F

from factfeed.config import ExperienceConfig
from factfeed.operators import experience as ex
from factfeed.plans.experience import packed_job, padded_job, sequence_info, token_experience

from . import fixtures as fx
from .ctes import CTES, cte, query
from .registry import check

CONFIG = ExperienceConfig(clip=(-2.0, 2.0), gamma=0.9, lambd=0.95)
PAD, EOS = -1, 7
SEED = 3

cte("delta", ("shaped",), """SELECT *, shaped * mask + 0.9 * coalesce(lead(value * mask) OVER w, 0) - value * mask AS d,
  row_number() OVER (PARTITION BY seq_id ORDER BY tok_no DESC) AS back
FROM shaped WINDOW w AS (PARTITION BY seq_id ORDER BY tok_no)""")
cte("adv", ("delta",), """SELECT seq_id, tok_no, back, d AS a FROM delta WHERE back = 1
  UNION ALL
  SELECT t.seq_id, t.tok_no, t.back, t.d + 0.9 * 0.95 * a.a FROM adv a JOIN delta t ON t.seq_id = a.seq_id AND t.back = a.back + 1""")
cte("reach", ("delta",), """SELECT seq_id, tok_no, back, shaped * mask AS g FROM delta WHERE back = 1
  UNION ALL
  SELECT t.seq_id, t.tok_no, t.back, t.shaped * t.mask + 0.9 * r.g FROM reach r JOIN delta t ON t.seq_id = r.seq_id AND t.back = r.back + 1""")
cte("gae", ("adv", "shaped"), """SELECT s.*, a.a AS advantage, a.a + s.value * s.mask AS ret
FROM shaped s JOIN adv a ON a.seq_id = s.seq_id AND a.tok_no = s.tok_no""")


def _shaped(spark, sf):
    return ex.with_kl_and_reward(fx.rollouts(spark, sf), CONFIG)


def _batched(spark, sf):
    return ex.micro_batches(fx.sequences(spark, sf), CONFIG.batch_size)


def _csv(name, alias=None):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(alias or name)


def _ints(name, alias=None):
    return F.array_join(F.transform(name, lambda x: x.cast("int").cast("string")), ",").alias(alias or name)


@check(
    "prompt_batches",
    query(
        f"""SELECT no // 16 AS batch_id, string_agg(qid::VARCHAR, ',' ORDER BY no) AS qids, string_agg(question, '|' ORDER BY no) AS questions,
  string_agg(len(titles)::VARCHAR, ',' ORDER BY no) AS n_titles
FROM (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || qid), qid) - 1 AS no
      FROM (SELECT * FROM records ORDER BY qid LIMIT 100000)) GROUP BY 1""",
        "records",
    ),
)
def prompt_batches(spark, sf):
    rows = ex.prompt_batches(fx.question_records(spark, sf), 100_000, 16, SEED)
    return rows.select(
        "batch_id",
        _csv("qid", "qids"),
        F.array_join("question", "|").alias("questions"),
        F.array_join(F.transform("titles", lambda t: F.size(t).cast("string")), ",").alias("n_titles"),
    )


@check("micro_batches", query("SELECT seq_id, batch_id, pos FROM batched", "batched"))
def micro_batches(spark, sf):
    return _batched(spark, sf).select("seq_id", "batch_id", "pos")


cte("padded", ("batched",), f"""SELECT *, greatest(len(output_ids), 0) AS olen,
  list_concat(list_resize([]::INTEGER[], win - len(prompt_ids), {PAD}), prompt_ids) AS p,
  list_resize(output_ids, wout, {PAD}) AS o, list_resize(rewards, wout, 0) AS r
FROM (SELECT *, max(len(prompt_ids)) OVER (PARTITION BY batch_id) AS win,
        max(len(output_ids)) OVER (PARTITION BY batch_id) AS wout FROM batched)""")
_SLOT = "least(olen, wout - 1)"
_ENDED = f"""SELECT seq_id, batch_id, pos,
  array_to_string(list_concat(p, CASE WHEN output_ids[olen] <> {EOS} THEN
    list_transform(o, lambda x, i: CASE WHEN i - 1 = {_SLOT} THEN {EOS} ELSE x END) ELSE o END), ',') AS sequence,
  array_to_string(list_transform(CASE WHEN output_ids[olen] <> {EOS} THEN
    list_transform(r, lambda x, i: CASE WHEN i - 1 = {_SLOT} THEN x - 1 ELSE x END) ELSE r END, lambda x: x::INTEGER), ',') AS rewards
FROM padded"""


@check(
    "padded_samples",
    query(
        """SELECT seq_id, batch_id, olen::INTEGER AS output_len, len(list_concat(p, o))::INTEGER AS width,
  len(r)::INTEGER AS n_rewards FROM padded""",
        "padded",
    ),
)
def padded_samples(spark, sf):
    rows = ex.padded_samples(_batched(spark, sf), PAD, EOS)
    return rows.select(
        "seq_id", "batch_id", "output_len", F.size("sequence").alias("width"), F.size("rewards").alias("n_rewards")
    )


@check("missing_end_token", query(_ENDED, "padded"))
def missing_end_token(spark, sf):
    rows = ex.padded_samples(_batched(spark, sf), PAD, EOS)
    return rows.select("seq_id", "batch_id", "pos", _csv("sequence"), _ints("rewards"))


@check(
    "packed_samples",
    query(
        """SELECT batch_id, array_to_string(flatten(list(list_concat(prompt_ids, output_ids) ORDER BY pos)), ',') AS sequence,
  array_to_string(flatten(list(list_resize([]::INTEGER[], len(prompt_ids) + len(output_ids), pos + 1) ORDER BY pos)), ',') AS segments,
  string_agg((len(prompt_ids) + len(output_ids))::VARCHAR, ',' ORDER BY pos) AS seq_lens,
  string_agg(greatest(1, len(output_ids))::VARCHAR, ',' ORDER BY pos) AS num_actions,
  array_to_string(list_transform(flatten(list(rewards ORDER BY pos)), lambda x: x::INTEGER), ',') AS rewards
FROM batched GROUP BY batch_id""",
        "batched",
    ),
)
def packed_samples(spark, sf):
    rows = ex.packed_samples(_batched(spark, sf))
    return rows.select(
        "batch_id", _csv("sequence"), _csv("segments"), _csv("seq_lens"), _csv("num_actions"), _ints("rewards")
    )


@check(
    "token_kl",
    query(
        """SELECT seq_id, tok_no, (logp - ref_logp) * mask AS ratio,
  round(exp((logp - ref_logp) * mask) - 1 - (logp - ref_logp) * mask, 6) AS k3, logp - ref_logp AS plain FROM rollouts""",
        "rollouts",
    ),
)
def token_kl(spark, sf):
    a, b, m = F.col("logp"), F.col("ref_logp"), F.col("mask")
    return fx.rollouts(spark, sf).select(
        "seq_id",
        "tok_no",
        ex.approx_kl(a, b, m).alias("ratio"),
        F.round(ex.approx_kl(a, b, m, k3=True), 6).alias("k3"),
        ex.approx_kl(a, b).alias("plain"),
    )


@check(
    "sequence_kl",
    query(
        """SELECT seq_id, round(sum(kl * mask) / nullif(sum(mask), 0), 6) AS masked, round(avg(kl), 6) AS plain
FROM shaped GROUP BY seq_id""",
        "shaped",
    ),
)
def sequence_kl(spark, sf):
    rows = _shaped(spark, sf)
    plain = ex.sequence_kl(rows, packed=True).withColumnRenamed("kl", "plain")
    both = ex.sequence_kl(rows).withColumnRenamed("kl", "masked").join(plain, "seq_id")
    return both.select("seq_id", F.round("masked", 6).alias("masked"), F.round("plain", 6).alias("plain"))


@check("shaped_reward", query("SELECT seq_id, tok_no, round(shaped, 6) AS shaped FROM shaped", "shaped"))
def shaped_reward(spark, sf):
    return _shaped(spark, sf).select("seq_id", "tok_no", F.round("shaped", 6).alias("shaped"))


_GAE = query(
    'SELECT seq_id, tok_no, round(advantage, 6) AS advantage, round(ret, 6) AS "return" FROM gae', "gae"
)


def _two(rows):
    return rows.select("seq_id", "tok_no", F.round("advantage", 6).alias("advantage"), F.round("return", 6).alias("return"))


@check("gae_advantages", _GAE)
def gae_advantages(spark, sf):
    return _two(ex.gae(_shaped(spark, sf), CONFIG.gamma, CONFIG.lambd))


@check("gae_advantages_chunked", _GAE)
def gae_advantages_chunked(spark, sf):
    """Chunks of eight tokens: every sequence is folded in several parts."""
    return _two(ex.gae(_shaped(spark, sf), CONFIG.gamma, CONFIG.lambd, chunk=8))


@check(
    "cumulative_returns",
    query('SELECT seq_id, tok_no, round(g, 6) AS advantage, round(g, 6) AS "return" FROM reach', "reach"),
)
def cumulative_returns(spark, sf):
    return _two(ex.cumulative_returns(_shaped(spark, sf), CONFIG.gamma))


_SUMMARY = """seq_id, round(sum(reward), 6) AS reward, round(sum(shaped), 6) AS "return", sum(mask)::BIGINT AS response_length,
  (max(prompt_len) + sum(mask))::BIGINT AS total_length, count(*) AS num_actions"""


@check("sequence_summary", query(f"SELECT {_SUMMARY} FROM shaped GROUP BY seq_id", "shaped"))
def sequence_summary(spark, sf):
    rows = ex.sequence_summary(_shaped(spark, sf))
    return rows.withColumn("reward", F.round("reward", 6)).withColumn("return", F.round("return", 6))


_NORM = """SELECT seq_id, tok_no, round((advantage - m) / sqrt(v + 1e-8), 6) AS advantage{more}
FROM gae, (SELECT avg(advantage) AS m, var_pop(advantage) AS v FROM gae WHERE mask > 0)"""


@check("normalized_advantages", query(_NORM.format(more=""), "gae"))
def normalized_advantages(spark, sf):
    rows = ex.normalize_advantages(ex.gae(_shaped(spark, sf), CONFIG.gamma, CONFIG.lambd))
    return rows.select("seq_id", "tok_no", F.round("advantage", 6).alias("advantage"))


@check(
    "experience_tokens",
    query(_NORM.format(more=', round(ret, 6) AS "return", round(kl, 6) AS kl, round(shaped, 6) AS shaped'), "gae"),
)
def experience_tokens(spark, sf):
    rows = token_experience(fx.rollouts(spark, sf), CONFIG)
    return rows.select("seq_id", "tok_no", *[F.round(c, 6).alias(c) for c in ("advantage", "return", "kl", "shaped")])


@check(
    "experience_sequences",
    query(
        f"SELECT {_SUMMARY}, round(sum(kl * mask) / nullif(sum(mask), 0), 6) AS kl FROM shaped GROUP BY seq_id",
        "shaped",
    ),
)
def experience_sequences(spark, sf):
    rows = sequence_info(fx.rollouts(spark, sf), CONFIG)
    for c in ("reward", "return", "kl"):
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


# ---- whole jobs over micro-batches -----------------------------------------
_ENDS = f"output_ids[olen] <> {EOS}"
_LAID = dict(
    ended=(
        ("padded",),
        f"""SELECT seq_id, batch_id, pos, len(prompt_ids) AS own, p,
  CASE WHEN {_ENDS} THEN list_transform(o, lambda x, i: CASE WHEN i - 1 = {_SLOT} THEN {EOS} ELSE x END) ELSE o END AS o,
  CASE WHEN {_ENDS} THEN list_transform(r, lambda x, i: CASE WHEN i - 1 = {_SLOT} THEN x - 1 ELSE x END) ELSE r END AS r FROM padded""",
    ),
    # attention by position: behind the first and before the last real token, and one more
    attended=(
        ("ended",),
        f"""SELECT seq_id, list(CASE WHEN i BETWEEN a AND b + 1 THEN 1 ELSE 0 END ORDER BY i) AS attention
FROM (SELECT *, min(i) FILTER (tok NOT IN ({PAD}, {EOS})) OVER w AS a, max(i) FILTER (tok NOT IN ({PAD}, {EOS})) OVER w AS b
  FROM (SELECT seq_id, unnest(list_concat(p, o)) AS tok, unnest(range(1, len(p) + len(o) + 1)) AS i FROM ended)
  WINDOW w AS (PARTITION BY seq_id)) GROUP BY seq_id""",
    ),
    laid=(
        ("ended", "rollouts"),
        f"""SELECT e.seq_id, e.tok_no, coalesce(x.logp, 0) AS logp, coalesce(x.ref_logp, 0) AS ref_logp, coalesce(x.value, 0) AS value, e.reward, e.mask
FROM (SELECT seq_id, i - 1 AS tok_no, r[i] AS reward,
        CASE WHEN i = 1 OR o[i - 1] NOT IN ({PAD}, {EOS}) THEN 1 ELSE 0 END AS mask
      FROM (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM ended)) e
LEFT JOIN rollouts x ON x.seq_id = e.seq_id AND x.tok_no = e.tok_no""",
    ),
    shaped=(("laid",), CTES["shaped"][1].replace("FROM rollouts", "FROM laid")),
)
_ALL = dict(shaped=(("rollouts",), CTES["shaped"][1].replace("FROM rollouts", "FROM (SELECT * REPLACE (1 AS mask) FROM rollouts)")))
_TOKENS = _NORM.format(more=', round(ret, 6) AS "return", round(kl, 6) AS kl, round(shaped, 6) AS shaped')
_TOKEN_COLUMNS = ("advantage", "return", "kl", "shaped")


@check(
    "padded_masks",
    query(
        """SELECT e.seq_id, array_to_string(t.attention, '') AS attention_mask, m.action_mask,
  list_sum(t.attention)::INTEGER AS total_length, m.response_length
FROM ended e JOIN attended t ON t.seq_id = e.seq_id
JOIN (SELECT seq_id, string_agg(mask::VARCHAR, '' ORDER BY tok_no) AS action_mask, sum(mask)::INTEGER AS response_length
      FROM laid GROUP BY seq_id) m ON m.seq_id = e.seq_id""",
        "ended",
        "attended",
        "laid",
        **_LAID,
    ),
)
def padded_masks(spark, sf):
    rows = ex.padded_samples(_batched(spark, sf), PAD, EOS)
    joined = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), "").alias(name)
    return rows.select("seq_id", joined("attention_mask"), joined("action_mask"), "total_length", "response_length")


@check("experience_padded", query(_TOKENS, "gae", **_LAID))
def experience_padded(spark, sf):
    """From sequences to normalized advantages, through the padded layout."""
    rows, _ = padded_job(fx.sequences(spark, sf), PAD, EOS, CONFIG)
    return rows.select("seq_id", "tok_no", *[F.round(c, 6).alias(c) for c in _TOKEN_COLUMNS])


def _rounded(rows):
    for c in ("reward", "return", "kl"):
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


@check(
    "experience_padded_sequences",
    query(
        """SELECT s.seq_id, round(sum(reward), 6) AS reward, round(sum(shaped), 6) AS "return", sum(mask)::BIGINT AS response_length,
  any_value(list_sum(t.attention))::BIGINT AS total_length, count(*) AS num_actions, round(sum(kl * mask) / sum(mask), 6) AS kl
FROM shaped s JOIN attended t ON t.seq_id = s.seq_id GROUP BY s.seq_id""",
        "shaped",
        "attended",
        **_LAID,
    ),
)
def experience_padded_sequences(spark, sf):
    return _rounded(padded_job(fx.sequences(spark, sf), PAD, EOS, CONFIG)[1])


@check(
    "experience_packed",
    query(
        f"""SELECT b.batch_id, n.* FROM ({_TOKENS}) n JOIN batched b ON b.seq_id = n.seq_id""",
        "gae",
        "batched",
        **_ALL,
    ),
)
def experience_packed(spark, sf):
    """From sequences to normalized advantages, through packed batches."""
    rows = ex.packed_tokens(packed_job(fx.sequences(spark, sf), CONFIG))
    return rows.select("batch_id", "seq_id", "tok_no", *[F.round(c, 6).alias(c) for c in _TOKEN_COLUMNS])


@check(
    "experience_packed_sequences",
    query(
        """SELECT b.batch_id, s.seq_id, round(sum(reward), 6) AS reward, round(sum(shaped), 6) AS "return", round(avg(kl), 6) AS kl,
  count(*)::INTEGER AS response_length, (max(prompt_len) + count(*))::INTEGER AS total_length
FROM shaped s JOIN batched b ON b.seq_id = s.seq_id GROUP BY ALL""",
        "shaped",
        "batched",
        **_ALL,
    ),
)
def experience_packed_sequences(spark, sf):
    rows = packed_job(fx.sequences(spark, sf), CONFIG).select("batch_id", F.inline("info")).drop("n_actions")
    return _rounded(rows)
