"""Answer-quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from factfeed.config import VERDICTS, RewardConfig
from factfeed.functions.numbers import safe_div, safe_mean
from factfeed.operators.metrics import COUNTS, METRICS, SHARES, answer_metrics, corpus_metrics, slug
from factfeed.plans.annotate import labels_from_completions

from . import fixtures as fx
from .ctes import CTES, INFO, query
from .registry import check

_COUNTS = [f"count(*) FILTER (verify = '{v}') AS n_{slug(v)}" for v in VERDICTS]
_COUNTS += [f"count(*) FILTER (verify = '{v}' AND assess <> '1') AS n_valid_{slug(v)}" for v in VERDICTS]
_COUNTS += ["count(*) FILTER (assess = '1') AS n_helpless", "count(statement) AS n_statements"]
_METRICS = f"""SELECT answer_id, {', '.join(COUNTS)},
  CASE WHEN n_statements > 0 THEN (n_correct + n_hedged_correct) / n_statements ELSE 0 END AS accuracy,
  CASE WHEN n_statements > 0 THEN (n_valid_correct + n_valid_hedged_correct) / n_statements ELSE 0 END AS valid_accuracy,
  1 - CASE WHEN n_statements > 0 THEN n_vague / n_statements ELSE 0 END AS ground,
  coalesce(info, 1) AS info, coalesce(info_reward, 0) AS info_reward
FROM (SELECT a.answer_id, {', '.join(_COUNTS)}, avg(assess::DOUBLE) AS info
      FROM answers a LEFT JOIN claims c ON c.answer_id = a.answer_id GROUP BY a.answer_id) m
LEFT JOIN (SELECT answer_id, sum(info) AS info_reward
           FROM (SELECT answer_id, {INFO} AS info FROM claims GROUP BY answer_id, sentence) GROUP BY answer_id) r
USING (answer_id)"""
CTES["metrics"] = (("answers", "claims"), _METRICS)


def _metrics(spark, sf):
    return answer_metrics(fx.answers(spark, sf), fx.labels(spark, sf), RewardConfig())


def _round(df, names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def _rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_PLAIN = [c for c in COUNTS if not c.startswith("n_valid_") and c not in ("n_helpless", "n_statements")]
_VALID = [c for c in COUNTS if c.startswith("n_valid_")]


@check("verdict_counts", query(f"SELECT answer_id, {', '.join(_PLAIN)} FROM metrics", "metrics"))
def verdict_counts(spark, sf):
    return _metrics(spark, sf).select("answer_id", *_PLAIN)


@check("valid_verdict_counts", query(f"SELECT answer_id, {', '.join(_VALID)} FROM metrics", "metrics"))
def valid_verdict_counts(spark, sf):
    return _metrics(spark, sf).select("answer_id", *_VALID)


@check("statement_counts", query("SELECT answer_id, n_helpless, n_statements FROM metrics", "metrics"))
def statement_counts(spark, sf):
    return _metrics(spark, sf).select("answer_id", "n_helpless", "n_statements")


_RATIOS = ["accuracy", "valid_accuracy", "ground"]


@check("accuracy_and_ground", query(f"SELECT answer_id, {_rounded(_RATIOS)} FROM metrics", "metrics"))
def accuracy_and_ground(spark, sf):
    return _round(_metrics(spark, sf).select("answer_id", *_RATIOS), _RATIOS)


@check("mean_helpfulness", query("SELECT answer_id, round(info, 6) AS info FROM metrics", "metrics"))
def mean_helpfulness(spark, sf):
    return _round(_metrics(spark, sf).select("answer_id", "info"), ["info"])


@check("info_reward", query("SELECT answer_id, round(info_reward, 6) AS info_reward FROM metrics", "metrics"))
def info_reward(spark, sf):
    return _round(_metrics(spark, sf).select("answer_id", "info_reward"), ["info_reward"])


@check(
    "corpus_metrics",
    query(
        "SELECT "
        + ", ".join(f"round(coalesce(avg({m}) FILTER (n_statements > 0), 1), 6) AS {m}" for m in METRICS)
        + ", round(1 - avg((n_statements > 0)::INTEGER), 6) AS refuse FROM metrics",
        "metrics",
    ),
)
def corpus(spark, sf):
    return _round(corpus_metrics(_metrics(spark, sf)), [*METRICS, "refuse"])


@check(
    "guarded_division",
    """SELECT event_id, CASE WHEN d <> 0 THEN value / d ELSE 0 END AS ratio, CASE WHEN d <> 0 THEN value / d ELSE 1 END AS mean
FROM (SELECT *, event_id % 3 AS d FROM events)""",
)
def guarded_division(spark, sf):
    d = F.col("event_id") % 3
    rows = fx.table(spark, sf, "events")
    return rows.select("event_id", safe_div(F.col("value"), d).alias("ratio"), safe_mean(F.col("value"), d).alias("mean"))


def _flagship_sql() -> str:
    saved = CTES["labels_h"]
    CTES["labels_h"] = (("paired",), "SELECT * FROM paired")
    try:
        return query(f"SELECT answer_id, {', '.join(COUNTS)}, {_rounded(SHARES)} FROM metrics", "metrics")
    finally:
        CTES["labels_h"] = saved


@check("answer_quality", _flagship_sql())
def answer_quality(spark, sf):
    """From model texts to the quality of every answer."""
    labels = labels_from_completions(fx.extractions(spark, sf), fx.completions(spark, sf), fx.CONFIG)
    return _round(answer_metrics(fx.answers(spark, sf), labels, RewardConfig()), SHARES)
