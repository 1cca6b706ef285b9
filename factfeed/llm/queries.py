"""Registered queries of the operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfeed.session import tune

from . import (
    content_sort,
    decontamination,
    filter_audit,
    interpolation,
    language,
    lsh_forest,
    main_text,
    noisy_channel,
    packing,
    passages,
    quality_rules,
    resampling,
    token_counts,
)
from .common import fold, table

TOKEN_LIMIT = 4096


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf, "documents"))


def op3_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return main_text.extract(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Label 1 is likely from a score of 0.7 on."""
    held_out = fold(F.col("doc_id"), 3) == 1
    scored = noisy_channel.judged(table(spark, sf, "documents"), table(spark, sf, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.report(decontamination.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


def op7_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = lsh_forest.near_duplicates(table(spark, sf, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.train(docs.where(fold(F.col("doc_id"), 4) != 2), F.col("lang"))
    return language.predict(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op10_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    training = fold(F.col("doc_id"), 10) != 0
    scored = interpolation.score(docs, training, interpolation.train(docs.where(training)))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_content_sort(spark: SparkSession, sf: str) -> DataFrame:
    return content_sort.exact_duplicates(table(spark, sf, "documents"))


def op12_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_passages, op3_main_text, op4_quality_rules, op5_toxicity, op6_decontamination, op7_near_duplicates,
        op8_token_counts, op9_language, op10_interpolation, op11_content_sort, op12_resampling, op13_filter_audit,
    )
}


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def queries():
    all_queries = QUERIES | {"pipeline": pipeline}
    return {name: (lambda spark, sf, f=f: f(tune(spark), sf)) for name, f in all_queries.items()}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
