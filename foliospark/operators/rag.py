"""Context from retrieved rows, sources, and the answer record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import models

# The budget, the line between chunks and the parts of a chunk.
MAX_CHARS, SEPARATOR = 6000, "\n---\n"
TITLE, CONTENT, END = "TITLE: ", "\nCONTENT: ", "\n"
NO_CONTEXT = "No relevant context was found."
SHOWN_SOURCES = 3


def chunk(title: Column, body: Column) -> Column:
    return F.concat(F.lit(TITLE), title, F.lit(CONTENT), body, F.lit(END))


def packed_chunks(hits: DataFrame, key: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """Hits (key, similarity, title, body, pdf_url) with their chunk, those that
    begin within the budget: a row stays where the chunks before it have at most
    ``max_chars`` characters, separators not counted. Hits are a top-k result."""
    order = Window.orderBy(F.desc("similarity"), key)
    before = F.coalesce(F.sum(F.length("chunk")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = hits.withColumn("chunk", chunk(F.coalesce("title", F.lit("Untitled")), text.as_text(F.col("body"))))
    return rows.withColumns({"_place": F.row_number().over(order), "_before": before}).where(F.col("_before") <= max_chars).drop("_before")


def context(hits: DataFrame, key: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row (context, n_chunks, n_chars)."""
    in_order = F.sort_array(F.collect_list(F.struct("_place", "chunk")))
    joined = F.array_join(F.transform(in_order, lambda x: x["chunk"]), SEPARATOR)
    whole = packed_chunks(hits, key, max_chars).agg(F.substring(joined, 1, max_chars).alias("context"), F.count(F.lit(1)).alias("n_chunks"))
    return whole.select("context", "n_chunks", F.length("context").cast("bigint").alias("n_chars"))


def sources(hits: DataFrame, key: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """(title, similarity, pdf_url) of the rows in the context."""
    rows = packed_chunks(hits, key, max_chars)
    return rows.select(F.coalesce("title", F.lit("Untitled")).alias("title"), "similarity", text.as_text(F.col("pdf_url")).alias("pdf_url"))


def top_sources(hits: DataFrame, key: str, max_chars: int = MAX_CHARS, most: int = SHOWN_SOURCES) -> DataFrame:
    """The first ``most`` sources of the context: (rank, title, similarity, pdf_url)."""
    rows = packed_chunks(hits, key, max_chars).where(F.col("_place") <= most)
    return rows.select(F.col("_place").cast("bigint").alias("rank"), F.coalesce("title", F.lit("Untitled")).alias("title"), "similarity", text.as_text(F.col("pdf_url")).alias("pdf_url"))


def answer(hits: DataFrame, key: str, question: str, max_chars: int = MAX_CHARS, reader: Callable[[], models.Reader] | None = None) -> DataFrame:
    """One answer record; ``error`` is set, and the answer empty, without context.
    ``reader`` makes a reader of one's own; without one a sentence is picked."""
    listed = sources(hits, key, max_chars).select(F.struct((-F.col("similarity")).alias("o"), "title", "similarity", "pdf_url").alias("x"))
    found = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["title"].alias("title"), x["similarity"].alias("similarity"), x["pdf_url"].alias("pdf_url")))
    row = context(hits, key, max_chars).crossJoin(listed.agg(found.alias("sources")))
    row = models.read(row, "context", question, reader) if reader else row.withColumn("read", models.sentence_answer(F.col("context"), question))
    none = F.col("n_chunks") == 0
    return row.select(
        F.when(none, F.lit("")).otherwise(F.col("read.answer")).alias("answer"),
        F.when(none, F.lit(0.0)).otherwise(F.col("read.score")).alias("score"),
        "sources",
        text.preview(F.col("context")).alias("context_preview"),
        F.when(none, F.lit(NO_CONTEXT)).alias("error"),
    )
