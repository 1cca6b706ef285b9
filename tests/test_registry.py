from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks import registry
from tools.compare import compare, connect

FAST = [
    "answer_quality",
    "extraction_pairs",
    "question_filter",
    "train_test_split",
    "dense_passages_blocked",
    "token_rewards",
    "padded_samples",
    "missing_end_token",
    "normalized_advantages",
    "corpus_metrics",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, con, sf, name):
    note, ok = compare(name, spark, con, sf)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "answer_id" in df.columns


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["answer_quality", "bm25_passages", "token_rewards", "attach_documents", "experience_tokens", "micro_batches"]
)
def test_plans_have_no_cross_product(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_score_pairs_are_not_shuffled(spark, sf, no_broadcast):
    """Between the term join and the ranking of its sums there is no exchange."""
    plan = plan_of(entry.queries()["topk_mask"](spark, sf))
    above_join = plan[: plan.index("SortMergeJoin")]
    assert "Exchange" not in above_join and "Window" in above_join


def test_rows_of_sequences_are_shuffled_once(spark, sf, no_broadcast):
    plan = plan_of(entry.queries()["gae_advantages"](spark, sf))
    wide = [x for x in plan.split("\n") if "collect_list(struct(_pos" in x and "partial" not in x]
    assert len(wide) == 1 and plan.count("Exchange") == 4


def test_token_numbers_join_the_answers_once(spark, sf, no_broadcast):
    plan = plan_of(entry.queries()["char_to_token"](spark, sf))
    assert plan.count("SortMergeJoin") == 1 and plan.count("array_min(") == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(entry.queries()["html_escape"](spark, sf))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    plan = plan_of(entry.queries()["answer_quality"](spark, sf))
    assert "LessThan(attempt,4)" in plan


@pytest.mark.parametrize("name", ["answer_quality", "token_rewards", "bm25_passages", "prompt_batches"])
def test_results_do_not_depend_on_partitions(spark, sf, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(repr, entry.queries()[name](spark, sf).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0] == found[1] and found[0]


def test_titles_are_found_without_the_texts(spark, sf):
    plan = plan_of(entry.queries()["supporting_titles"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "text:string" not in plan


def test_counts_and_scores_share_one_exchange(spark, sf, no_broadcast):
    df = entry.queries()["bm25_scores"](spark, sf)
    assert df.collect() and "ReusedExchange" in plan_of(df)


def test_evidence_is_gathered_from_the_documents(spark, con, sf):
    """Texts move once, and those that the output leaves out do not move at all."""
    plan = plan_of(entry.queries()["evidence_columns"](spark, sf))
    assert "documents.parquet" in plan and "evidence-" not in plan and "question_records-" not in plan
    assert "AS extra" not in plan
    for name in ("evidence_columns", "assemble_evidence", "prompt_batches"):
        note, ok = compare(name, spark, con, sf)
        assert ok, note
