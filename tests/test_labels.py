"""Annotation, rewards and metrics on hand-made labels."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from factfeed.config import AnnotateConfig, RetrieveConfig, RewardConfig
from factfeed.operators import annotation as an
from factfeed.operators import rewards as rw
from factfeed.operators.inference import batch_predict, fan_out_samples
from factfeed.operators.metrics import answer_metrics, corpus_metrics, with_report_names
from factfeed.plans.annotate import annotate_with_model
from factfeed.plans.score import score_answers, score_with_model, strip_texts
from factfeed.session import ship

ship(__name__)

LABELS = "answer_id long, sentence string, statement string, verify string, assess string"
TEXT = "Ann was born in Rome. She is a painter, and rich."
S1, S2 = "Ann was born in Rome.", "She is a painter, and rich."
ROWS = [
    (1, S1, "Ann was born in Rome.", "Correct", "5"),
    (1, S2, "She is a painter", "Wrong", "3"),
    (1, S2, "She is rich", "Vague", "1"),
    (2, "Is it so?", "It is so", "Correct", "5"),
]


def labels(spark):
    return spark.createDataFrame(ROWS, LABELS)


def outputs(spark):
    rows = []
    for i, text in ((1, TEXT), (2, "Is it so?"), (3, "")):
        toks = re.findall(r" *[^ ]+", text) + ["</s>"]
        rows.append((i, toks, [t == "</s>" for t in toks]))
    return spark.createDataFrame(rows, "answer_id long, tokens array<string>, special array<boolean>")


def info(*grades):
    values = {"5": 1.3, "4": 1.2, "3": 1.1, "2": 1.0, "1": -0.1}
    return math.log(max(-0.9, sum(values[g] for g in grades)) + 1)


def scores(df):
    return {r["answer_id"]: r["scores"] for r in df.collect()}


def test_token_rewards(spark):
    got = scores(rw.labels_to_rewards(outputs(spark), labels(spark)))
    want = [0.0] * 11
    # tokens: Ann was born in Rome. She is a painter, and rich. </s>
    want[4] += info("5") + 1.0 * 1.3
    want[10] += info("3", "1")  # last character of the second sentence
    want[8] += -2.0 * 1.1  # "painter"
    want[10] += -1.0 * 0.1  # "rich"
    want.append(0.0)
    want = want[:12]
    assert [round(x, 9) for x in got[1]] == [round(x, 9) for x in want]
    assert got[2] == [0.0] * 4 and got[3] == [0.0]


def test_token_rewards_add_up(spark):
    got = scores(rw.labels_to_rewards(outputs(spark), labels(spark)))
    total = info("5") + info("3", "1") + 1.3 - 2.2 - 0.1
    assert sum(got[1]) == pytest.approx(total)


def test_sentence_and_answer_rewards(spark):
    got = scores(rw.labels_to_rewards(outputs(spark), labels(spark), RewardConfig(granularity="sentence")))
    assert got[1][4] == pytest.approx(info("5") + 1.3)
    assert got[1][10] == pytest.approx(info("3", "1") - 2.2 - 0.1)
    assert sum(map(abs, got[1])) == pytest.approx(abs(got[1][4]) + abs(got[1][10]))
    config = RewardConfig(granularity="answer", default_for_none=0.5)
    got = scores(rw.labels_to_rewards(outputs(spark), labels(spark), config))
    assert got[1][:-1] == [0.5] * 11 and got[1][-1] == pytest.approx(info("5") + info("3", "1") + 1.3 - 2.2 - 0.1)
    assert got[2] == [0.5] * 3 + [0.0] and got[3] == [0.0]
    with pytest.raises(ValueError):
        rw.labels_to_rewards(outputs(spark), labels(spark), RewardConfig(granularity="other"))


def test_many_useless_statements_hit_the_floor(spark):
    rows = [(1, "s", f"x{i}", "Vague", "1") for i in range(30)]
    got = rw.sentence_info(spark.createDataFrame(rows, LABELS)).first()["info"]
    assert got == pytest.approx(math.log(0.1))


def test_metrics(spark):
    scored = score_answers(outputs(spark), labels(spark))
    got = {r["answer_id"]: r for r in scored.metrics.collect()}
    one = got[1]
    assert (one["n_correct"], one["n_wrong"], one["n_vague"], one["n_statements"], one["n_helpless"]) == (1, 1, 1, 3, 1)
    assert (one["n_valid_correct"], one["n_valid_vague"]) == (1, 0)
    assert one["accuracy"] == pytest.approx(1 / 3) and one["ground"] == pytest.approx(2 / 3)
    assert one["info"] == 3.0 and one["info_reward"] == pytest.approx(info("5") + info("3", "1"))
    for i in (2, 3):
        r = got[i]
        assert (r["n_statements"], r["accuracy"], r["ground"], r["info"], r["info_reward"]) == (0, 0.0, 1.0, 1.0, 0.0)
    total = corpus_metrics(scored.metrics).first()
    assert total["refuse"] == pytest.approx(2 / 3) and total["info"] == 3.0 and total["n_statements"] == 3.0
    none = corpus_metrics(answer_metrics(outputs(spark).filter("answer_id = 3"), labels(spark))).first()
    assert none["accuracy"] == 1.0 and none["refuse"] == 1.0
    assert corpus_metrics(scored.metrics.filter("false")).first()["refuse"] is None
    named = with_report_names(corpus_metrics(scored.metrics)).columns
    assert {"#Correct", "#Valid Hedged wrong", "#statements", "valid accuracy", "%refuse", "info"} <= set(named)


def test_nested(spark):
    ids = spark.range(1, 4).withColumnRenamed("id", "answer_id")
    got = {r["answer_id"]: r["labels"] for r in an.nest_labels(ids, labels(spark)).collect()}
    assert got[1] == {S1: {S1: ["Correct", "5"]}, S2: {"She is a painter": ["Wrong", "3"], "She is rich": ["Vague", "1"]}}
    assert got[3] == {}


def test_answers_and_optional_columns(spark):
    df = spark.createDataFrame(
        [(1, "q", ["a"]), (2, "q", ["b", "b", "c"]), (3, "r", ["d"])], "rid long, question string, answers array<string>"
    )
    got = sorted((r["question"], r["answer_no"], r["answer"]) for r in an.fan_out_answers(df, "rid").collect())
    assert got == [("q", 0, "b"), ("q", 1, "c"), ("r", 0, "d")]
    full = an.fill_optional(df.withColumn("ground", F.array(F.lit("g")))).first()
    assert (full["titles"], full["materials"], full["extra_materials"]) == (["g"], [], None)
    texts = spark.createDataFrame([(" q \n", "\t a")], "question string, answer string")
    assert tuple(strip_texts(texts).first()) == ("q", "a")


def test_attempts(spark):
    tasks = an.statement_tasks(spark.createDataFrame([(1, "s", "x"), (1, "s", "y")], "answer_id long, sentence string, statement string"))
    ids = {(r["statement"], r["task"]): r["task_id"] for r in tasks.collect()}
    rows = [
        (ids["x", "verify"], "verify", 1, "Wrong"),
        (ids["x", "verify"], "verify", 0, "???"),
        (ids["x", "verify"], "verify", 2, "Correct"),
        (ids["x", "assess"], "assess", 0, "no digit"),
        (ids["x", "assess"], "assess", 4, "5"),
        (ids["y", "verify"], "verify", 3, "vague"),
    ]
    done = spark.createDataFrame(rows, "task_id string, task string, attempt int, text string")
    paired = an.pair_labels(an.resolve_labels(tasks, done, AnnotateConfig()))
    got = {r["statement"]: (r["verify"], r["assess"]) for r in paired.collect()}
    assert got == {"x": ("Wrong", "1"), "y": ("Vague", "1")}
    other = an.resolve_labels(tasks, done, AnnotateConfig(default_grade="3", retry_times=1))
    got = {r["statement"]: (r["verify"], r["assess"]) for r in an.pair_labels(other).collect()}
    assert got == {"x": ("Vague", "3"), "y": ("Vague", "3")}


def test_prompts(spark):
    config = AnnotateConfig(
        extract_template="E {response}", verify_template="V {materials}|{statement}", assess_template="A {question}|{response}|{statement}"
    )
    df = spark.createDataFrame(
        [("q", "a {statement}", "s", [" m1 ", "m2 {statement}"])],
        "question string, answer string, statement string, passages array<string>",
    )
    assert an.extract_prompts(df, config).first()["prompt"] == "E a {statement}"
    assert an.verify_prompts(df, config).first()["prompt"] == "V - m1\n- m2 s|s"
    assert an.assess_prompts(df, config).first()["prompt"] == "A q|a s|s"


def test_batches_and_samples(spark):
    def model():
        return lambda prompts: [f"{len(prompts)}:{p}" for p in prompts]

    df = spark.range(10).selectExpr("id AS qid", "concat('p', id) AS prompt").coalesce(1)
    got = {r["qid"]: r["text"] for r in batch_predict(df, model, ["qid"], batch_size=4).collect()}
    assert got[0] == "4:p0" and got[9] == "2:p9" and len(got) == 10
    assert fan_out_samples(df, 3).count() == 30

    def short():
        return lambda prompts: prompts[:-1]

    with pytest.raises(Exception, match="one text per prompt"):
        batch_predict(df, short, ["qid"]).collect()


def scripted_model():
    """Answers by the kind of prompt; some prompts are never answered well."""

    def answer(prompt):
        kind, body = prompt.split(" ", 1)
        if kind == "E":
            return "???" if "broken" in body else f">> Sentence 1: {body}\n* {body}\n* other\n"
        if kind == "V":
            return "Correct" if "- " in body else "unsure"
        return str(1 + int(hashlib.md5(body.encode()).hexdigest(), 16) % 5)

    return lambda prompts: [answer(p) for p in prompts]


def test_annotation_with_a_model(spark):
    config = AnnotateConfig(
        retry_times=2,
        extract_template="E {response}",
        verify_template="V {materials}|{statement}",
        assess_template="A {question}|{response}|{statement}",
        retrieve=RetrieveConfig(max_words_per_section=3),
    )
    answers = spark.createDataFrame(
        [(1, 10, "q?", "red fox"), (2, 10, "q?", "broken"), (3, 11, "q?", "sky")],
        "answer_id long, qid long, question string, answer string",
    )
    evidence = spark.createDataFrame(
        [(10, 0, "", "A red fox lives here. Tea is hot today. War is over now."), (11, 0, "", "tea")],
        "qid long, mat_no int, title string, material string",
    )
    got = annotate_with_model(answers, evidence, scripted_model, config, workers=2)
    rows = {(r["answer_id"], r["statement"]): (r["sentence"], r["verify"], r["assess"]) for r in got.collect()}
    assert set(rows) == {(1, "red fox"), (1, "other"), (3, "sky"), (3, "other")}
    assert rows[1, "red fox"][:2] == ("red fox", "Correct")
    # without evidence the answer never parses, so the default counts
    assert rows[1, "other"][1] == "Vague" and rows[3, "sky"][1] == "Vague"
    assert all(r[2] in "12345" for r in rows.values())

    def heated():
        """Reads its settings: the first attempts are too cold to answer."""

        def predict(prompts, settings):
            plain = scripted_model()(prompts)
            cold = [p.startswith("E") and s["temperature"] < 1.5 for p, s in zip(prompts, settings, strict=True)]
            return ["???" if c else t for c, t in zip(cold, plain, strict=True)]

        return predict

    again = annotate_with_model(answers, evidence, heated, config, workers=2, sampling=True)
    assert again.exceptAll(got).isEmpty() and got.exceptAll(again).isEmpty()
    once = annotate_with_model(answers, evidence, heated, replace(config, retry_times=1), workers=2, sampling=True)
    assert once.isEmpty()
    wide = answers.withColumn("answer", F.concat(F.lit(" \n"), "answer", F.lit("\t ")))
    scored = score_with_model(outputs(spark), wide, evidence, scripted_model, annotate=config, workers=2)
    assert scored.labels.exceptAll(got).isEmpty() and got.exceptAll(scored.labels).isEmpty()
    assert scored.scores.count() == 3
