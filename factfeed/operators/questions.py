"""Question sets: filters, titles, evidence paragraphs, prompts, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PARAGRAPH_SENTINEL, ChatTemplate
from ..functions.text import escape_html, strip, token_count, unescape_html
from ..session import small_or_none
from ..sources.docstore import unique_documents


def union_splits(train: DataFrame, validation: DataFrame) -> DataFrame:
    return train.unionByName(validation)


def keep_questions(df: DataFrame, end: str = "?", min_words: int = 5) -> DataFrame:
    """Questions with the right last character and enough word tokens."""
    q = F.col("question")
    return df.filter(F.endswith(q, F.lit(end)) & (token_count(q) >= min_words))


def first_per_title(df: DataFrame, order: str, title: str = "title") -> DataFrame:
    """First row of every title. At most one row per title and map task is
    shuffled, however many rows a title has."""
    w = Window.partitionBy(title).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def supporting_titles(titles: Column) -> Column:
    return F.array_sort(F.array_distinct(titles))


def gold_paragraphs(context: Column, titles: Column) -> Column:
    """Paragraph of each title, its sentences joined and trimmed."""

    def paragraph(title: Column) -> Column:
        at = F.array_position(context["title"], title).cast("int")
        sents = F.when(at > 0, F.get(context["sentences"], at - 1))
        return strip(F.array_join(sents, ""))

    return F.transform(titles, paragraph)


def answer_fact(question: Column, answer: Column) -> Column:
    """The answer as one more piece of evidence."""
    body = F.replace(F.substring(question, F.lit(1), F.greatest(F.length(question) - 1, F.lit(0))), F.lit("?"), F.lit(""))
    # fixed value: wording of the fact
    return F.concat(
        F.lit('The correct answer for "'), body, F.lit('" is "'), answer, F.lit('".')
    )


def span_materials(context: Column, question: Column, answers: Column) -> Column:
    """Context plus the answer fact, or a fact saying there is no answer."""
    # fixed value: wording of the fact
    no_answer = F.concat(F.lit('"'), question, F.lit('" has no correct answer.'))
    fact = F.when(F.size(answers) > 0, answer_fact(question, F.get(answers, F.lit(0)))).otherwise(no_answer)
    return F.array(strip(context), fact)


def with_store_keys(df: DataFrame) -> DataFrame:
    """Titles in the escaped form under which the store keeps them."""
    return df.withColumn("store_keys", F.transform("titles", escape_html))


def unescape_titles(df: DataFrame, title: str) -> DataFrame:
    return df.withColumn("titles", F.array(unescape_html(F.col(title))))


def attach_documents(questions: DataFrame, docs: DataFrame, key: str = "qid") -> DataFrame:
    """Add extra_materials, the text of every title found in the store, and n_found,
    their number, for which no text moves.

    Titles are exploded and equi-joined; the texts come back in title order.
    Works on one row per (question, title), so a much-cited document is a
    skewed join key, which the optimizer may split, and never a large group.
    """
    marks = F.replace(F.col("text"), F.lit(PARAGRAPH_SENTINEL), F.lit(""))
    for mark in ("<s>", "</s>"):  # fixed values: markers dropped from texts
        marks = F.replace(marks, F.lit(mark), F.lit(""))
    store = unique_documents(docs).select(F.col("title").alias("_key"), marks.alias("_text"))
    found = (
        with_store_keys(questions)
        .select(key, F.posexplode("store_keys").alias("_pos", "_key"))
        .join(store, "_key")
        .groupBy(key)
        .agg(
            F.array_sort(F.collect_list(F.struct("_pos", "_text"))).alias("_found"),
            F.count(F.lit(1)).cast("int").alias("n_found"),
        )
        .select(key, F.col("_found._text").alias("extra_materials"), "n_found")
    )
    return (
        questions.join(found, key, "left")
        .withColumn("extra_materials", F.coalesce("extra_materials", F.array().cast("array<string>")))
        .withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    )


def keep_resolved(df: DataFrame) -> DataFrame:
    """Questions for which every title led to exactly one document."""
    return df.filter(F.col("n_found") == F.size("titles"))


def chat_prompt(
    template: ChatTemplate, question: Column, answer: Column | None = None
) -> Column:
    t = template
    user = F.concat(F.lit(t.user_prefix), question, F.lit(t.turn_end))
    if answer is None:
        return F.concat(user, F.lit(t.generation_prefix))
    closed = F.concat(user, F.lit(t.answer_prefix), answer, F.lit(t.turn_end))
    return F.when(answer.isNull(), F.concat(user, F.lit(t.generation_prefix))).otherwise(closed)


def decontaminate(train: DataFrame, test: DataFrame, limit: int = 100_000) -> DataFrame:
    """Drop training questions whose text is a test question.

    The distinct test questions are counted; up to limit they are broadcast,
    beyond it the tables are joined by shuffle.
    """
    texts = small_or_none(test.select("question").distinct(), limit)
    return train if texts is None else train.join(texts, "question", "left_anti")
