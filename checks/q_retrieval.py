"""Evidence retrieval."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from factfeed.functions.text import word_tokens
from factfeed.operators import retrieval as rt
from factfeed.operators.sections import build_sections, evidence_rows, sentence_rows

from . import fixtures as fx
from .ctes import no_stops, query, sents, tokens
from .registry import check

CONFIG = fx.CONFIG.retrieve


def _scores(spark, sf):
    return rt.bm25_scores(fx.sections(spark, sf), rt.query_sentences(fx.queries(spark, sf), CONFIG), CONFIG)


@check(
    "assemble_evidence",
    query(
        """SELECT qid, (unnest(range(0, len(texts))))::INTEGER AS mat_no, unnest(names[:len(texts)]) AS title, unnest(texts) AS material
FROM (SELECT qid, names, mats[:least(len(names), len(mats))] AS texts
  FROM (SELECT qid, CASE WHEN extra_materials IS NULL THEN titles ELSE list_concat(list_transform(materials, lambda m: ''), titles) END AS names,
    CASE WHEN extra_materials IS NULL THEN materials ELSE list_concat(materials, extra_materials) END AS mats FROM records))""",
        "records",
    ),
)
def assemble_evidence(spark, sf):
    return evidence_rows(fx.question_records(spark, sf))


@check(
    "sentence_split",
    f"""SELECT doc_id, (no - 1)::INTEGER AS sent_no, sent FROM (SELECT doc_id, unnest(ss) AS sent, unnest(range(1, len(ss) + 1)) AS no
FROM (SELECT doc_id, {sents('text')} AS ss FROM documents))""",
)
def sentence_split(spark, sf):
    return sentence_rows(fx.table(spark, sf, "documents"), "text", "doc_id")


@check(
    "word_tokens",
    f"""SELECT doc_id, len({tokens('text')})::INTEGER AS n_tokens, md5(array_to_string({tokens('text')}, ' ')) AS all_tokens,
  md5(array_to_string({no_stops(tokens('text'))}, ' ')) AS kept_tokens FROM documents""",
)
def tokenized(spark, sf):
    rows = fx.table(spark, sf, "documents").withColumn("t", word_tokens(F.col("text")))
    kept = word_tokens(F.col("text"), CONFIG.stops)
    return rows.select(
        "doc_id",
        F.size("t").alias("n_tokens"),
        F.md5(F.array_join("t", " ")).alias("all_tokens"),
        F.md5(F.array_join(kept, " ")).alias("kept_tokens"),
    )


@check(
    "sections",
    query("SELECT qid, sec_no, section, array_to_string(tokens, ' ') AS tokens FROM secs", "secs"),
)
def sections(spark, sf):
    rows = build_sections(fx.evidence(spark, sf), CONFIG)
    return rows.withColumn("tokens", F.array_join("tokens", " "))


@check(
    "sections_with_empty",
    query(
        """SELECT qid, sec_no, section FROM secs
UNION ALL
SELECT e.qid, e.mat_no::BIGINT * 4294967296 + coalesce(l.n, 0), ''
FROM evidence e
LEFT JOIN (SELECT qid, mat_no, max(i) + 1 AS n, arg_max(full_here, no) AS ends_full FROM sec_fold GROUP BY ALL) l
  ON l.qid = e.qid AND l.mat_no = e.mat_no
JOIN (SELECT qid, min(mat_no) AS first FROM mat_sents GROUP BY qid) f ON f.qid = e.qid
WHERE coalesce(l.ends_full, true) AND e.mat_no >= f.first""",
        "secs",
        "sec_fold",
        "mat_sents",
        "evidence",
    ),
)
def sections_with_empty(spark, sf):
    """Empty remainders kept as sections of their own."""
    rows = build_sections(fx.evidence(spark, sf), replace(CONFIG, keep_empty=True))
    return rows.select("qid", "sec_no", "section")


@check(
    "bm25_scores",
    query("SELECT qid, query_id, sent_no, sec_no, round(score, 6) AS score FROM dense_scores WHERE score <> 0", "dense_scores"),
)
def bm25_scores(spark, sf):
    return _scores(spark, sf).select("qid", "query_id", "sent_no", "sec_no", F.round("score", 6).alias("score"))


@check(
    "topk_mask",
    query("SELECT qid, query_id, sent_no, sec_no, round(kept, 6) AS score FROM masked WHERE kept <> 0", "masked"),
)
def topk_mask(spark, sf):
    kept = rt.keep_topk(_scores(spark, sf), CONFIG.max_sections)
    return kept.select("qid", "query_id", "sent_no", "sec_no", F.round("score", 6).alias("score"))


@check(
    "fused_scores",
    query("SELECT qid, query_id, sec_no, round(score, 6) AS score, place FROM fused", "fused"),
)
def fused_scores(spark, sf):
    k = CONFIG.max_sections
    return rt.fuse_scores(rt.keep_topk(_scores(spark, sf), k), k).withColumn("score", F.round("score", 6))


@check(
    "bm25_passages",
    query("SELECT qid, query_id, sec_no, round(score, 6) AS score, place FROM passages", "passages"),
)
def bm25_passages(spark, sf):
    found = rt.bm25_passages(fx.sections(spark, sf), fx.queries(spark, sf), CONFIG)
    return found.withColumn("score", F.round("score", 6))


_DENSE = """SELECT qid, query_id, sec_no, round(score, 6) AS score, place FROM (SELECT *,
    row_number() OVER (PARTITION BY qid, query_id ORDER BY score DESC, sec_no)::INTEGER AS place
  FROM (SELECT q.qid, q.query_id, s.vec_id AS sec_no,
      round(list_dot_product(q.vec::DOUBLE[], s.embedding::DOUBLE[]), 9) AS score
    FROM (SELECT label AS qid, vec_id // 2 AS query_id, arg_min(embedding, vec_id % 2) AS vec FROM embeddings GROUP BY ALL) q
    JOIN embeddings s ON s.label = q.qid))
WHERE place <= 3"""


@check("dense_passages", _DENSE)
def dense_passages(spark, sf):
    config = replace(CONFIG, method="dense", max_sections=3)
    return rt.dense_passages(fx.section_vectors(spark, sf), fx.query_vectors(spark, sf), config).withColumn(
        "score", F.round("score", 6)
    )


@check("dense_passages_blocked", _DENSE)
def dense_passages_blocked(spark, sf):
    """Every question cut into several blocks, as a hot one would be."""
    config = replace(CONFIG, method="dense", max_sections=3, block_rows=16)
    return rt.retrieve(fx.section_vectors(spark, sf), fx.query_vectors(spark, sf), config).withColumn(
        "score", F.round("score", 6)
    )


@check(
    "retrieve_bm25_blocked",
    query("SELECT qid, query_id, sec_no, round(score, 6) AS score, place FROM passages", "passages"),
)
def retrieve_bm25_blocked(spark, sf):
    config = replace(CONFIG, block_rows=8)
    return rt.retrieve(fx.sections(spark, sf), fx.queries(spark, sf), config).withColumn("score", F.round("score", 6))
