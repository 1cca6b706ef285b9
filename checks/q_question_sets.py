"""Preparation of question sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from factfeed.config import ChatTemplate, SourceSpec
from factfeed.functions.text import escape_html, unescape_html
from factfeed.operators import questions as qs
from factfeed.operators.ordering import first_n, split_test, train_test_split
from factfeed.plans.build_questions import Source, build_question_sets
from factfeed.sources.adapters import load_questions

from . import fixtures as fx
from .ctes import ASKS, FACT, SPAN_FACT, _paragraphs, query, strip
from .registry import check

TEST_SIZE, SEED = 64, 7
CHAT = ChatTemplate()
_HASH = f"md5('{SEED}:' || qid)"
_TEST = f"(SELECT qid FROM ready_context ORDER BY {_HASH}, qid LIMIT {TEST_SIZE})"


@check(
    "split_union",
    "SELECT doc_id AS qid, text FROM documents UNION ALL SELECT item_id, text FROM benchmark",
)
def split_union(spark, sf):
    train = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "text")
    validation = fx.table(spark, sf, "benchmark").select("text", F.col("item_id").alias("qid"))
    return qs.union_splits(train, validation)


@check("question_filter", query(f"SELECT qid, question FROM qa_span WHERE {ASKS}", "qa_span"))
def question_filter(spark, sf):
    return qs.keep_questions(fx.qa_span(spark, sf)).select("qid", "question")


@check(
    "first_per_title",
    query(
        f"""SELECT title, qid, question FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY qid) AS rn
  FROM (SELECT regexp_extract(context, '^([^\\s]+)', 1) AS title, qid, question FROM qa_span WHERE {ASKS}))
WHERE rn = 1""",
        "qa_span",
    ),
)
def first_per_title(spark, sf):
    """Titles are the first words here, so some are very frequent."""
    rows = qs.keep_questions(fx.qa_span(spark, sf)).select(
        F.regexp_extract("context", r"^([^\s]+)", 1).alias("title"), "qid", "question"
    )
    return qs.first_per_title(rows, "qid")


@check(
    "supporting_titles",
    query("SELECT qid, array_to_string(list_sort(list_distinct(facts)), '|') AS titles FROM qa_context", "qa_context"),
)
def supporting_titles(spark, sf):
    rows = fx.qa_context(spark, sf)
    return rows.select("qid", F.array_join(qs.supporting_titles(F.col("supporting_facts.title")), "|").alias("titles"))


@check(
    "gold_paragraphs",
    query(
        f"""SELECT qid, unnest(titles) AS title, unnest({_paragraphs}) AS paragraph
FROM (SELECT *, list_sort(list_distinct(facts)) AS titles FROM qa_context)""",
        "qa_context",
    ),
)
def gold_paragraphs(spark, sf):
    rows = fx.qa_context(spark, sf).withColumn("titles", qs.supporting_titles(F.col("supporting_facts.title")))
    both = F.arrays_zip(F.col("titles").alias("title"), qs.gold_paragraphs(F.col("context"), F.col("titles")).alias("paragraph"))
    return rows.select("qid", F.inline(both)).toDF("qid", "title", "paragraph")


@check("answer_fact", query(f"SELECT qid, {FACT.format(answer='answer')} AS fact FROM qa_context", "qa_context"))
def answer_fact(spark, sf):
    rows = fx.qa_context(spark, sf)
    return rows.select("qid", qs.answer_fact(F.col("question"), F.col("answer")).alias("fact"))


@check(
    "span_materials",
    query(f"SELECT qid, {strip('context')} AS passage, {SPAN_FACT} AS fact FROM qa_span", "qa_span"),
)
def span_materials(spark, sf):
    rows = fx.qa_span(spark, sf).withColumn(
        "m", qs.span_materials(F.col("context"), F.col("question"), F.col("answers.text"))
    )
    return rows.select("qid", F.get("m", F.lit(0)).alias("passage"), F.get("m", F.lit(1)).alias("fact"))


def _unescape(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@check("html_unescape", query(f"SELECT page_id, {_unescape('topic')} AS title FROM page_titles", "page_titles"))
def html_unescape(spark, sf):
    return fx.page_titles(spark, sf).select("page_id", unescape_html(F.col("topic")).alias("title"))


@check(
    "html_escape",
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""",
)
def html_escape(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", escape_html(F.col("html")).alias("escaped"))


_FOUND = "coalesce(array_to_string(extra_materials, '|'), '')"


@check(
    "attach_documents",
    query(
        f"""SELECT a.qid, coalesce(len(extra_materials), 0)::INTEGER AS n_found, {_FOUND} AS extra
FROM ctx_asked a LEFT JOIN ctx_found f ON f.qid = a.qid""",
        "ctx_asked",
        "ctx_found",
    ),
)
def attach_documents(spark, sf):
    rows = qs.attach_documents(_asked(spark, sf), fx.docs(spark, sf))
    return rows.select("qid", F.size("extra_materials").alias("n_found"), F.array_join("extra_materials", "|").alias("extra"))


def _asked(spark, sf):
    rows = qs.keep_questions(fx.qa_context(spark, sf))
    return rows.withColumn("titles", qs.supporting_titles(F.col("supporting_facts.title")))


@check("resolved_questions", query("SELECT qid, question FROM ready_context", "ready_context"))
def resolved_questions(spark, sf):
    rows = qs.attach_documents(_asked(spark, sf), fx.docs(spark, sf))
    return qs.keep_resolved(rows).select("qid", "question")


@check(
    "topic_records",
    query(
        "SELECT qid, question, titles[1] AS title, array_to_string(extra_materials, '|') AS extra FROM ready_topic",
        "ready_topic",
    ),
)
def topic_records(spark, sf):
    rows = load_questions(fx.topics(spark, sf), fx.docs(spark, sf), SourceSpec(kind="topic"))
    return rows.select("qid", "question", F.get("titles", F.lit(0)).alias("title"), F.array_join("extra_materials", "|").alias("extra"))


@check(
    "first_questions",
    query("SELECT qid, question FROM qa ORDER BY qid LIMIT 100", "qa"),
)
def first_questions(spark, sf):
    return first_n(fx.qa(spark, sf), 100, "qid").select("qid", "question")


def _chat(x: str, answer: str | None) -> str:
    from .ctes import lit

    nl = CHAT
    esc = lambda t: lit(t).replace("\n", "' || chr(10) || '")
    user = f"{esc(nl.user_prefix)} || {x} || {esc(nl.turn_end)}"
    if answer is None:
        return f"{user} || {esc(nl.generation_prefix)}"
    return f"{user} || {esc(nl.answer_prefix)} || {answer} || {esc(nl.turn_end)}"


@check(
    "chat_prompt",
    query(f"SELECT qid, {_chat('question', None)} AS prompt, {_chat('question', 'answer')} AS pair FROM qa", "qa"),
)
def chat_prompt(spark, sf):
    q, a = F.col("question"), F.col("answer")
    return fx.qa(spark, sf).select("qid", qs.chat_prompt(CHAT, q).alias("prompt"), qs.chat_prompt(CHAT, q, a).alias("pair"))


@check(
    "train_test_split",
    query(
        f"""SELECT qid, CASE WHEN row_number() OVER (ORDER BY {_HASH}, qid) <= {TEST_SIZE} THEN 'test' ELSE 'train' END AS side
FROM qa""",
        "qa",
    ),
)
def split_sides(spark, sf):
    rows = fx.qa(spark, sf).select("qid")
    sides = [train_test_split(rows, TEST_SIZE, SEED, s).withColumn("side", F.lit(s)) for s in ("train", "test")]
    return sides[0].unionByName(sides[1])


@check(
    "decontaminated_train",
    query(
        f"""SELECT qid, question FROM qa_span WHERE question IS NOT NULL AND question NOT IN
  (SELECT question FROM qa_span WHERE question IS NOT NULL AND qid IN
    (SELECT qid FROM qa_span ORDER BY {_HASH}, qid LIMIT {TEST_SIZE}))""",
        "qa_span",
    ),
)
def decontaminated_train(spark, sf):
    """Copies of test documents carry the same question and go as well."""
    rows = fx.qa_span(spark, sf).filter("question IS NOT NULL").select("qid", "question")
    test = rows.join(split_test(fx.qa_span(spark, sf), TEST_SIZE, SEED), "qid", "left_semi")
    return qs.decontaminate(rows, test).select("qid", "question")


@check(
    "training_cap",
    "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 10000",
)
def training_cap(spark, sf):
    return first_n(fx.table(spark, sf, "documents").select("doc_id", "n_chars"), 10_000, "doc_id")


@check(
    "build_question_sets",
    query(
        f"""SELECT 'span' AS source, qid, question, array_to_string(materials, '|') AS materials FROM ready_span
UNION ALL SELECT 'topic', qid, question, NULL FROM ready_topic
UNION ALL SELECT 'context', qid, question, array_to_string(materials, '|') FROM ready_context WHERE qid IN {_TEST.replace('ready_context', 'head')}
UNION ALL SELECT * FROM (SELECT 'context_train', qid, question, array_to_string(materials, '|') FROM ready_context
  WHERE question NOT IN (SELECT question FROM ready_context WHERE qid IN {_TEST.replace('ready_context', 'head')})
  ORDER BY qid LIMIT 10000)""",
        "ready_span",
        "ready_topic",
        "ready_context",
    ).replace("\nSELECT 'span'", ",\nhead AS (SELECT qid FROM ready_context ORDER BY qid LIMIT 20064)\nSELECT 'span'", 1),
)
def question_sets(spark, sf):
    """All sources, the test split and the decontaminated training set."""
    docs = fx.docs(spark, sf)
    sources = {
        "context": Source(
            fx.qa_context(spark, sf),
            docs,
            SourceSpec(kind="qa_context", n_questions=20_000, test_size=TEST_SIZE, split="test", seed=SEED),
        ),
        "span": Source(fx.qa_span(spark, sf), docs, SourceSpec(kind="qa_span")),
        "topic": Source(fx.topics(spark, sf), docs, SourceSpec(kind="topic")),
    }
    out = None
    for name, rows in build_question_sets(sources, "context").items():
        part = rows.select(F.lit(name).alias("source"), "qid", "question", F.array_join("materials", "|").alias("materials"))
        out = part if out is None else out.unionByName(part)
    return out
