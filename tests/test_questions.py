from __future__ import annotations

import html
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from factfeed.config import ChatTemplate, SourceSpec
from factfeed.functions.text import escape_html, sentences, unescape_html, word_tokens
from factfeed.operators import questions as qs
from factfeed.plans.build_questions import Source, build_question_sets, head_size, select_questions, write_question_sets
from factfeed.session import fresh_path
from factfeed.sources.adapters import load_questions
from factfeed.sources.docstore import lookup_titles
from factfeed.sources.jsonl import count_records, read_jsonl, target_path, write_counted, write_jsonl

TITLES = ["A &amp; B", "x &lt;y&gt; &quot;z&quot; &#39;w&#39; &#x27;", "&eacute;t&eacute; &notit; &amp;lt;", "plain", "", None]


def one(spark, col):
    return spark.range(1).select(col.alias("c")).first()["c"]


def test_html(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "t string")
    got = df.select("t", unescape_html(F.col("t")).alias("u"), escape_html(F.col("t")).alias("e")).collect()
    for r in got:
        assert r["u"] == (None if r["t"] is None else html.unescape(r["t"]))
        assert r["e"] == (None if r["t"] is None else html.escape(r["t"]))


REFERENCES = [
    "&notit; &notin; &not &amp;lt; &ampx &AMP;&gt&lt", "&#65;&#x41;&#X1F600;&#128512", "&#0;&#x0;&#13;&#128;&#x9f;&#x81;",
    "&#xD800;&#1114112;&#99999999999999999999;&#x1;&#11;&#127;&#xFFFE;&#x10FFFF;&#xFDD0;", "&; & &# &#x; &#xg; &&amp;&",
    "&NotEqualTilde;&ThickSpace;x&NewLine;y&Tab;z", "&unknown; &" + "a" * 40 + ";", "&eacute&Eacute;té &hellip;",
    "&#x27;&quot;\n&lt\n", "&copy2026 &para;graph &parax", "&#0000000000065;&#x00000000000041;", "\U0001F600&amp;\U0001F600", "",
]


def test_character_references(spark):
    df = spark.createDataFrame([(t,) for t in REFERENCES * 2], "t string").repartition(3)
    out = df.select("t", unescape_html(F.col("t")).alias("u"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert r["u"] == html.unescape(r["t"]), r["t"]


def test_every_name(spark):
    texts = [f"<{f}>" for n in html5 for f in (f"&{n}", f"&{n}b")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape_html(F.col("t")).alias("u"))
    assert [r for r in df.collect() if r["u"] != html.unescape(r["t"])] == []


def test_text_rules(spark):
    assert one(spark, sentences(F.lit("A b.  C d!? \n\n E\tf "))) == ["A b.", "C d!?", "E\tf"]
    assert one(spark, sentences(F.lit("...\n?"))) == []
    assert one(spark, word_tokens(F.lit("Été 3.5, l'an"))) == ["Été", "3", ".", "5", ",", "l", "'", "an"]
    assert one(spark, word_tokens(F.lit("The the a The"), ("the",))) == ["The", "a", "The"]


def test_question_filter(spark):
    rows = ["one two three four?", "one two three?", "one two three four five", "a b c d e ?"]
    df = spark.createDataFrame([(q,) for q in rows], "question string")
    assert [r[0] for r in qs.keep_questions(df).collect()] == [rows[0], rows[3]]
    assert [r[0] for r in qs.keep_questions(df, end="e", min_words=3).collect()] == [rows[2]]


def test_facts(spark):
    assert one(spark, qs.answer_fact(F.lit("Who? me?"), F.lit("x"))) == 'The correct answer for "Who me" is "x".'
    none = qs.span_materials(F.lit(" c "), F.lit("Who?"), F.array().cast("array<string>"))
    assert one(spark, none) == ["c", '"Who?" has no correct answer.']
    some = qs.span_materials(F.lit("c"), F.lit("Who?"), F.array(F.lit("x"), F.lit("y")))
    assert one(spark, some) == ["c", 'The correct answer for "Who" is "x".']


def docs(spark):
    sep = "####SPECIAL####SEPARATOR####"
    rows = [("A &amp; B", f"<s>one{sep} two</s>"), ("C", "three"), ("D", "four"), ("D", "five")]
    return spark.createDataFrame(rows, "title string, text string")


def test_documents(spark):
    df = spark.createDataFrame(
        [(1, ["C", "A & B"]), (2, ["D"]), (3, ["C", "gone"]), (4, []), (5, ["C", "C"])], "qid long, titles array<string>"
    )
    got = {r["qid"]: r["extra_materials"] for r in qs.attach_documents(df, docs(spark)).collect()}
    assert got == {1: ["three", "one two"], 2: [], 3: ["three"], 4: [], 5: ["three", "three"]}
    kept = qs.keep_resolved(qs.attach_documents(df, docs(spark))).collect()
    assert sorted(r["qid"] for r in kept) == [1, 4, 5]
    found = lookup_titles(docs(spark), docs(spark)).collect()
    assert {r["title"]: r["paragraphs"] for r in found} == {"A &amp; B": ["<s>one", " two</s>"], "C": ["three"]}


def test_documents_are_counted_without_their_texts(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/docs")
    df = spark.createDataFrame([(1, ["C"]), (2, ["D"]), (3, None), (None, ["C"])], "qid long, titles array<string>")
    rows = qs.keep_resolved(qs.attach_documents(df, spark.read.parquet(f"{tmp_path}/docs"))).select("qid")
    assert [r["qid"] for r in rows.collect()] == [1]
    assert "text:string" not in rows._jdf.queryExecution().executedPlan().toString()


def test_first_per_title_and_gold(spark):
    df = spark.createDataFrame([("t", 3, "c"), ("t", 1, "a"), ("u", 2, "b"), (None, 5, "n")], "title string, qid long, x string")
    assert sorted(r["x"] for r in qs.first_per_title(df, "qid").collect()) == ["a", "b", "n"]
    row = spark.sql(
        "SELECT named_struct('title', array('p', 'q'), 'sentences', array(array(' a.', ' b. '), array('c.'))) AS c, array('q', 'p', 'z') AS t"
    )
    assert row.select(qs.gold_paragraphs(F.col("c"), F.col("t")).alias("g")).first()["g"] == ["c.", "a. b.", None]
    assert one(spark, qs.supporting_titles(F.array(*[F.lit(x) for x in "bab"]))) == ["a", "b"]


def test_chat(spark):
    t = ChatTemplate("U:", "S:", ";", "G")
    assert one(spark, qs.chat_prompt(t, F.lit("q"))) == "U:q;G"
    assert one(spark, qs.chat_prompt(t, F.lit("q"), F.lit("a"))) == "U:q;S:a;"
    assert one(spark, qs.chat_prompt(t, F.lit("q"), F.lit(None).cast("string"))) == "U:q;G"


def test_decontaminate_beyond_broadcast_limit(spark):
    train = spark.createDataFrame([(i, f"q{i % 5}") for i in range(20)], "qid long, question string")
    test = train.filter("qid < 2")
    for limit in (100, 0):
        rows = qs.decontaminate(train, test, limit)
        assert sorted({r["question"] for r in rows.collect()}) == ["q2", "q3", "q4"]


def contexts(spark, n=30):
    rows = [
        (
            i,
            f"Which one is number {i} here?" if i % 10 else "No question",
            f"a{i}",
            (["C", "A & B"], [[" x.", f" {i}."], ["y."]]),
            (["C", "A & B", "C"],) if i % 7 else (["gone"],),
        )
        for i in range(n)
    ]
    schema = (
        "qid long, question string, answer string, context struct<title:array<string>,sentences:array<array<string>>>, "
        "supporting_facts struct<title:array<string>>"
    )
    return spark.createDataFrame(rows, schema)


def test_context_source(spark):
    got = {r["qid"]: r for r in load_questions(contexts(spark), docs(spark), SourceSpec(kind="qa_context")).collect()}
    assert sorted(got) == [i for i in range(30) if i % 10 and i % 7]
    assert got[1]["titles"] == ["A & B", "C"] and got[1]["extra_materials"] == ["one two", "three"]
    assert got[1]["materials"] == ["y.", "x. 1.", 'The correct answer for "Which one is number 1 here" is "a1".']


def test_context_source_is_written_before_its_documents_are_looked_up(spark, tmp_path):
    """Paragraphs that no title asks for are not shuffled with the documents."""
    contexts(spark).write.parquet(f"{tmp_path}/rows")
    rows = load_questions(spark.read.parquet(f"{tmp_path}/rows"), docs(spark), SourceSpec(kind="qa_context"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "/asked-" in plan and "sentences" not in plan and rows.count() > 0


def test_build_job(spark):
    spec = SourceSpec(kind="qa_context", n_questions=15, test_size=4, split="test", chat_template=ChatTemplate())
    topic = spark.createDataFrame([(1, "Tell me.", "A &amp; B"), (2, "And?", "gone")], "qid long, input string, topic string")
    sets = build_question_sets(
        {"ctx": Source(contexts(spark), docs(spark), spec), "bio": Source(topic, docs(spark), SourceSpec(kind="topic"))}, "ctx", cap=10
    )
    assert head_size(spec) == 19
    assert set(sets) == {"ctx", "bio", "ctx_train"}
    test, train = sets["ctx"].collect(), sets["ctx_train"].collect()
    assert len(test) == 4 and all(r["prompt"].startswith("<|user|>") for r in test)
    assert len(train) == 10 and not {r["question"] for r in test} & {r["question"] for r in train}
    assert [r["titles"] for r in sets["bio"].collect()] == [["A & B"]]
    paths = write_question_sets(sets, fresh_path(spark, "sets"))
    assert count_records(spark, paths["ctx"]).first()["n"] == 4
    assert read_jsonl(spark, paths["bio"], "qid long, question string").first()["question"] == "Tell me."


def test_split_sides_of_a_source(spark):
    df = spark.range(20).selectExpr("id AS qid", "concat('q', id) AS question")
    spec = SourceSpec(test_size=5, split="train")
    assert select_questions(df, spec).count() == 15
    assert load_questions(df, None, spec) is df
    with pytest.raises(ValueError):
        load_questions(df, None, SourceSpec(kind="other"))


def test_folder_target_gets_a_file_name(spark):
    folder = fresh_path(spark, "folder")
    path = write_jsonl(spark.range(3), f"{folder}/")
    assert path == target_path(f"{folder}/") == f"{folder}/qa.jsonl"
    assert count_records(spark, path).first()["n"] == 3


def test_second_write_replaces_or_raises(spark):
    path = write_jsonl(spark.range(5), fresh_path(spark, "twice"))
    with pytest.raises(Exception, match="(?i)already.exists"):
        write_jsonl(spark.range(3), path)
    assert write_jsonl(spark.range(3), path, mode="overwrite") == path
    assert count_records(spark, path).first()["n"] == 3


def test_count_of_the_writing_job(spark):
    df = spark.range(1234).withColumnRenamed("id", "qid").repartition(5)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        path, n = write_counted(df, fresh_path(spark, "counted"))
        jobs = len(tracker.getJobIdsForGroup("counted"))
        write_jsonl(df, fresh_path(spark, "plain"))
        assert len(tracker.getJobIdsForGroup("counted")) == 2 * jobs  # no job of its own
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n == 1234 == count_records(spark, path).first()["n"]
    assert write_counted(df, path, mode="overwrite") == (path, 1234)
    assert write_counted(df.limit(0), fresh_path(spark, "none"))[1] == 0
