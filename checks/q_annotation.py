"""Annotation steps."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from factfeed.config import ASSESS_TEMPLATE, EXTRACT_TEMPLATE, VERIFY_TEMPLATE
from factfeed.operators import annotation as an
from factfeed.operators.retrieval import attach_passages, retrieve
from factfeed.plans.annotate import annotate_with_model as annotate
from factfeed.plans.annotate import label_prompts, labels_from_completions
from factfeed.session import fresh_path
from factfeed.streaming.label_merge import missed_pairs, pair_stream, read_arrivals, write_pairs

from . import fixtures as fx
from .ctes import SENTENCE, digit, items, lit, query, refusal, sents, strip
from .registry import check

CONFIG = fx.CONFIG


def sql_text(text: str) -> str:
    return lit(text).replace("\n", "' || chr(10) || '")


# ---- inputs ----------------------------------------------------------------
def _records(spark, sf):
    """Answer records: the questions repeat in three rounds with other answers."""
    rows = fx.qa(spark, sf).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(2))))
    tagged = F.concat("answer", F.lit(" v"), F.col("round").cast("string"))
    return rows.select(
        (F.col("qid") * 10 + F.col("round")).alias("rid"),
        "question",
        F.array("answer", tagged, F.col("answer")).alias("answers"),
    )


@check(
    "answer_fan_out",
    query(
        """SELECT rid, question, (no - 1)::INTEGER AS answer_no, list_extract(list_value(answer, answer || ' v' || round), no) AS answer
FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY rid DESC) AS rn
      FROM (SELECT qid * 10 + round AS rid, question, answer, round FROM qa, range(3) t(round))), range(1, 3) u(no)
WHERE rn = 1""",
        "qa",
    ),
)
def answer_fan_out(spark, sf):
    return an.fan_out_answers(_records(spark, sf), "rid")


@check(
    "optional_columns",
    query(
        """SELECT qid, array_to_string(coalesce(CASE WHEN qid % 2 = 0 THEN titles END, ['ground']), '|') AS titles,
  array_to_string(coalesce(CASE WHEN qid % 3 = 0 THEN materials END, []), '|') AS materials,
  extra_materials IS NULL AS no_extra FROM (SELECT qid, titles, materials, NULL AS extra_materials FROM records)""",
        "records",
    ),
)
def optional_columns(spark, sf):
    rows = fx.question_records(spark, sf).select(
        "qid",
        F.when(F.col("qid") % 2 == 0, F.col("titles")).alias("titles"),
        F.array(F.lit("ground")).alias("ground"),
        F.when(F.col("qid") % 3 == 0, F.col("materials")).alias("materials"),
    )
    return an.fill_optional(rows).select(
        "qid",
        F.array_join("titles", "|").alias("titles"),
        F.array_join("materials", "|").alias("materials"),
        F.col("extra_materials").isNull().alias("no_extra"),
    )


# ---- prompts ---------------------------------------------------------------
@check(
    "extract_prompts",
    query(f"SELECT answer_id, replace({sql_text(EXTRACT_TEMPLATE)}, '{{response}}', answer) AS prompt FROM answers", "answers"),
)
def extract_prompts(spark, sf):
    return an.extract_prompts(fx.answers(spark, sf), CONFIG).select("answer_id", "prompt")


_VERIFY = query(
    f"""SELECT q.query_id AS task_id, replace(replace({sql_text(VERIFY_TEMPLATE)}, '{{materials}}', coalesce(e.txt, '')),
    '{{statement}}', q.statement) AS prompt
FROM queries q LEFT JOIN (SELECT p.query_id, string_agg('- ' || {strip('s.section')}, chr(10) ORDER BY p.place) AS txt
  FROM passages p JOIN secs s ON s.qid = p.qid AND s.sec_no = p.sec_no GROUP BY p.query_id) e ON e.query_id = q.query_id""",
    "queries",
    "passages",
    "secs",
)


@check("verify_prompts", _VERIFY)
def verify_prompts(spark, sf):
    tasks = fx.queries(spark, sf)
    sections = fx.sections(spark, sf)
    found = retrieve(sections, tasks, CONFIG.retrieve)
    full = an.verify_prompts(attach_passages(tasks, found, sections), CONFIG)
    return full.select(F.col("query_id").alias("task_id"), "prompt")


@check(
    "assess_prompts",
    query(
        f"""SELECT t.task_id, replace(replace(replace({sql_text(ASSESS_TEMPLATE)}, '{{question}}', a.question),
  '{{response}}', a.answer), '{{statement}}', t.statement) AS prompt
FROM tasks t JOIN answers a ON a.answer_id = t.answer_id WHERE t.task = 'assess'""",
        "tasks",
        "answers",
    ),
)
def assess_prompts(spark, sf):
    tasks = fx.tasks(spark, sf).filter("task = 'assess'").join(fx.answers(spark, sf), "answer_id")
    return an.assess_prompts(tasks, CONFIG).select("task_id", "prompt")


_PROMPTS = query(
    f"""SELECT task_id, 'assess' AS task, replace(replace(replace({sql_text(ASSESS_TEMPLATE)}, '{{question}}', a.question),
  '{{response}}', a.answer), '{{statement}}', t.statement) AS prompt
FROM tasks t JOIN answers a ON a.answer_id = t.answer_id WHERE t.task = 'assess'
UNION ALL
SELECT q.query_id, 'verify', replace(replace({sql_text(VERIFY_TEMPLATE)}, '{{materials}}', coalesce(e.txt, '')),
    '{{statement}}', q.statement)
FROM queries q LEFT JOIN (SELECT p.query_id, string_agg('- ' || {strip('s.section')}, chr(10) ORDER BY p.place) AS txt
  FROM passages p JOIN secs s ON s.qid = p.qid AND s.sec_no = p.sec_no GROUP BY p.query_id) e ON e.query_id = q.query_id""",
    "tasks",
    "answers",
    "queries",
    "passages",
    "secs",
).replace("CASE WHEN " + digit("t.task_id", 2) + " < 2 THEN '' ELSE t.statement END", "t.statement").replace(
    "CASE WHEN " + digit("t.task_id", 2) + " <> 0 THEN a.question END", "a.question"
)


# ---- parsing ---------------------------------------------------------------
@check("extraction_status", query("SELECT * FROM ex_status", "ex_status"))
def extraction_status(spark, sf):
    return an.parse_extractions(fx.extractions(spark, sf)).select("answer_id", "attempt", "status")


@check(
    "extraction_pairs",
    query(
        """SELECT answer_id, attempt, (row_number() OVER (PARTITION BY answer_id, attempt ORDER BY no) - 1)::INTEGER AS pos,
  sentence, statement FROM ex_pairs""",
        "ex_pairs",
    ),
)
def extraction_pairs(spark, sf):
    parsed = an.parse_extractions(fx.extractions(spark, sf))
    return parsed.select("answer_id", "attempt", F.posexplode("pairs").alias("pos", "p")).select(
        "answer_id", "attempt", "pos", "p.sentence", "p.statement"
    )


@check(
    "verdict_parse",
    query("SELECT task_id, attempt, label FROM parsed_labels WHERE task = 'verify'", "parsed_labels"),
)
def verdict_parse(spark, sf):
    rows = fx.completions(spark, sf).filter("task = 'verify'")
    return an.parse_labels(rows).select("task_id", "attempt", "label")


@check(
    "grade_parse",
    query("SELECT task_id, attempt, label FROM parsed_labels WHERE task = 'assess'", "parsed_labels"),
)
def grade_parse(spark, sf):
    rows = fx.completions(spark, sf).filter("task = 'assess'")
    return an.parse_labels(rows).select("task_id", "attempt", "label")


# ---- tasks and labels ------------------------------------------------------
@check("statement_tasks", query("SELECT task_id, answer_id, sentence, statement, task FROM tasks", "tasks"))
def statement_tasks(spark, sf):
    return fx.tasks(spark, sf)


@check(
    "attempt_resolution",
    query("SELECT task_id, task, label FROM resolved", "resolved"),
)
def attempt_resolution(spark, sf):
    return an.resolve_labels(fx.tasks(spark, sf), fx.completions(spark, sf), CONFIG).select("task_id", "task", "label")


@check(
    "extraction_resolution",
    query(
        """SELECT f.answer_id, count(p.no) AS n_pairs FROM (SELECT answer_id, min(attempt) AS attempt FROM ex_status
  WHERE status <> 'malformed' AND attempt < 4 GROUP BY answer_id) f
LEFT JOIN ex_pairs p ON p.answer_id = f.answer_id AND p.attempt = f.attempt GROUP BY f.answer_id""",
        "ex_status",
        "ex_pairs",
    ),
)
def extraction_resolution(spark, sf):
    parsed = an.parse_extractions(fx.extractions(spark, sf))
    done = an.resolve_extractions(parsed, CONFIG.retry_times)
    return done.select("answer_id", F.size("pairs").cast("long").alias("n_pairs"))


@check("label_pairs", query("SELECT * FROM paired", "paired"))
def label_pairs(spark, sf):
    return an.pair_labels(an.resolve_labels(fx.tasks(spark, sf), fx.completions(spark, sf), CONFIG))


@check(
    "nested_labels",
    query(
        """SELECT a.answer_id, count(DISTINCT l.sentence) AS n_sentences, count(l.statement) AS n_statements
FROM answers a LEFT JOIN labels_h l ON l.answer_id = a.answer_id GROUP BY a.answer_id""",
        "answers",
        "labels_h",
    ),
)
def nested_labels(spark, sf):
    nested = an.nest_labels(fx.answers(spark, sf), fx.labels(spark, sf))
    inner = F.aggregate(F.map_values("labels"), F.lit(0), lambda a, m: a + F.size(m))
    return nested.select(
        "answer_id",
        F.size("labels").cast("long").alias("n_sentences"),
        inner.cast("long").alias("n_statements"),
    )


@check("refusal_filter", query(f"SELECT * FROM labels_h WHERE NOT {refusal('sentence')}", "labels_h"))
def refusal_filter(spark, sf):
    return an.drop_refusals(fx.labels(spark, sf))


@check(
    "refusal_filter_any_case",
    query(f"SELECT * FROM labels_h WHERE NOT {refusal('lower(sentence)')}", "labels_h"),
)
def refusal_filter_any_case(spark, sf):
    return an.drop_refusals(fx.labels(spark, sf), ignore_case=True)


# ---- the job with a model --------------------------------------------------
def _spoken(prompt: str, settings: dict) -> str:
    """Stands for a model: a text that follows from the prompt's digest alone, and
    for one prompt in sixteen from the temperature as well."""
    d = int(hashlib.md5(prompt.encode()).hexdigest()[0], 16)
    begin, end = EXTRACT_TEMPLATE.split("{response}")
    if not prompt.startswith(begin):
        verify = prompt.startswith(VERIFY_TEMPLATE.split("{")[0])
        return (fx.VERIFY_TEXTS if verify else fx.ASSESS_TEXTS)[d]
    if d == 0:
        return "No statements"
    if d == 2 or (d == 1 and settings["temperature"] == 1):
        return "???"
    found = [s.strip() for s in re.findall(SENTENCE, prompt[len(begin) : len(prompt) - len(end)])]
    claims = [(i, s) for i, s in enumerate(filter(None, found), 1)]
    return "".join(f">> Sentence {i}: {s}\n* {s}\n" + (f"* {s.split(',')[0]}\n" if "," in s else "") for i, s in claims)


def _speaker():
    return lambda prompts, settings: [_spoken(p, s) for p, s in zip(prompts, settings, strict=True)]


_NL = "chr(10)"
_claims = f"""array_to_string(list_transform(ss, lambda s, i: '>> Sentence ' || i || ': ' || s || {_NL} || '* ' || s || {_NL}
  || CASE WHEN contains(s, ',') THEN '* ' || split_part(s, ',', 1) || {_NL} ELSE '' END), '')"""
_MODEL = query(
    "SELECT * FROM paired",
    "paired",
    extractions=(
        ("answers",),
        f"""SELECT answer_id, attempt::INTEGER AS attempt,
  CASE WHEN d = 0 THEN 'No statements' WHEN d = 2 OR (d = 1 AND attempt = 0) THEN '???' ELSE {_claims} END AS text
FROM (SELECT answer_id, {sents('answer')} AS ss, unnest(range(4)) AS attempt,
        {digit(f"md5(replace({sql_text(EXTRACT_TEMPLATE)}, '{{response}}', answer))", 1)} AS d FROM answers)""",
    ),
    queries=(
        ("tasks", "answers"),
        """SELECT a.qid, t.task_id AS query_id, t.statement, a.question
FROM tasks t JOIN answers a ON a.answer_id = t.answer_id WHERE t.task = 'verify'""",
    ),
    asked=(
        ("tasks", "answers", "queries", "passages", "secs"),
        f"""SELECT t.task_id, 'assess' AS task, replace(replace(replace({sql_text(ASSESS_TEMPLATE)}, '{{question}}', a.question),
  '{{response}}', a.answer), '{{statement}}', t.statement) AS prompt
FROM tasks t JOIN answers a ON a.answer_id = t.answer_id WHERE t.task = 'assess'
UNION ALL
SELECT q.query_id, 'verify', replace(replace({sql_text(VERIFY_TEMPLATE)}, '{{materials}}', coalesce(e.txt, '')), '{{statement}}', q.statement)
FROM queries q LEFT JOIN (SELECT p.query_id, string_agg('- ' || {strip('s.section')}, chr(10) ORDER BY p.place) AS txt
  FROM passages p JOIN secs s ON s.qid = p.qid AND s.sec_no = p.sec_no GROUP BY p.query_id) e ON e.query_id = q.query_id""",
    ),
    completions=(
        ("asked",),
        f"""SELECT task_id, task, 0 AS attempt, CASE WHEN task = 'verify' THEN ({items(fx.VERIFY_TEXTS)})[d + 1]
  ELSE ({items(fx.ASSESS_TEXTS)})[d + 1] END AS text FROM (SELECT *, {digit('md5(prompt)', 1)} AS d FROM asked)""",
    ),
)


@check("annotate_with_model", _MODEL)
def annotate_with_model(spark, sf):
    """Prompts, model, readings and second asks in one job, in waves of 4 x 2000."""
    return annotate(
        fx.answers(spark, sf), fx.evidence(spark, sf), _speaker, CONFIG, workers=4, sampling=True, rows_per_task=2000
    )


@check("annotation_job", query("SELECT * FROM paired", "paired"))
def annotation_job(spark, sf):
    return labels_from_completions(fx.extractions(spark, sf), fx.completions(spark, sf), CONFIG)


@check("label_task_prompts", _PROMPTS)
def label_task_prompts(spark, sf):
    """Both kinds of prompts of the annotation job in one table."""
    return label_prompts(fx.tasks(spark, sf), fx.answers(spark, sf), fx.evidence(spark, sf), CONFIG)


@check(
    "label_stream_merge",
    query(
        """SELECT answer_id, sentence, statement, verify, assess FROM paired""",
        "paired",
    ),
)
def label_stream_merge(spark, sf):
    """Labels written as files in scattered order, hours apart, paired by a stream
    join; pairs beyond its time bounds are added at the end."""
    done = an.resolve_labels(fx.tasks(spark, sf), fx.completions(spark, sf), CONFIG)
    hours = fx.hex_digit(F.col("task_id"), 3) * 1200
    arrivals = done.select(
        *an.STATEMENT_KEYS, "task", "label", F.timestamp_seconds(F.lit(1_700_000_000) + hours).alias("done_at")
    )
    source, out = fresh_path(spark, "arrivals"), fresh_path(spark, "pairs")
    arrivals.repartition(4, "label").write.parquet(source)
    run = write_pairs(pair_stream(read_arrivals(spark, source, 2)), out, fresh_path(spark, "stream"))
    run.awaitTermination()
    paired = spark.read.parquet(out).select(*an.STATEMENT_KEYS, "verify", "assess")
    return paired.unionByName(missed_pairs(spark.read.parquet(source), paired))
