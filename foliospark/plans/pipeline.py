"""The stages of a corpus, each reading and writing tables of a store."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import corpus, models, rag, retrieval, topics
from foliospark.session import materialise
from foliospark.sources import papers, tables

log = logging.getLogger("foliospark")


def ingest(spark: SparkSession, store: tables.Store, source: str, query: str, category: str | None = None, max_results: int = 20) -> DataFrame:
    found = papers.fetch_papers(spark, source, query, category, max_results)
    wrote = tables.write_metadata(found, store.path("metadata"))
    log.info("metadata %s", "written" if wrote else "left as it was: nothing found")
    return store.metadata() if wrote else found


def clean(store: tables.Store, strict: bool = False) -> DataFrame:
    tables.write(corpus.clean_corpus(store.metadata(), strict), store.path("corpus_clean"))
    return store.clean()


def summarise(store: tables.Store, max_length: int = models.MAX_LENGTH, min_length: int = models.MIN_LENGTH, factory: Callable | None = None) -> DataFrame:
    made = models.summarize(store.clean(), "text_unit", "summary", max_length, min_length, factory)
    tables.write(made, store.path("corpus_with_summaries"))
    return store.best_corpus()


def embed(store: tables.Store, model: str = "hashing-64", factory: Callable | None = None) -> DataFrame:
    """One table with ordinal, key, unit vector and what is shown of a row:
    nothing is aligned by place, and every row with text has a vector, also
    where its arxiv_id is missing or stands in several rows."""
    best = store.best_corpus()
    column = corpus.text_column(best)
    body = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("summary", "abstract_clean", "text_unit") if c in best.columns], F.lit(""))
    shown = [F.col("title_clean").alias("title"), body.alias("body"), *[c for c in corpus.INDEX_COLUMNS if c in best.columns and c != "title"]]
    rows = corpus.dense_index(corpus.nonempty(best, column).select("arxiv_id", F.col(column).alias("_text"), *shown), ["arxiv_id", "_text"])
    rows = rows.withColumns({"embedded_text_col": F.lit(column), "embedding_model": F.lit(model)})
    tables.write(models.embed(rows, "_text", factory=factory).drop("_text"), store.path("embeddings"))
    return store.embeddings()


def build_topics(store: tables.Store, n_topics: int = 8, top_terms: int = 10, max_features: int = 20_000, random_state: int = 42) -> tuple[DataFrame, DataFrame]:
    best = materialise(corpus.dense_index(store.best_corpus(), ["arxiv_id", "text_unit"], "_row"), "rows")
    table, placed = topics.build_topics(best, "_row", n_topics, top_terms, max_features, random_state)
    tables.write(table, store.path("topics"))
    tables.write(placed.drop("_row"), store.path("corpus_with_topics"), partition_by="topic_id")
    return store.topics(), store.corpus_with_topics()


def retrieve(store: tables.Store, query: str, k: int = 5, model: str = "hashing-64", factory: Callable | None = None) -> DataFrame:
    """(row_idx, similarity, arxiv_id, title, body, pdf_url); no rows for a blank query.

    Raises ValueError where the index was built with another model.
    """
    spark, index = store.spark, store.embeddings()
    built = index.select("embedding_model").first()
    if built and built[0] != model:
        raise ValueError(f"the index was built with {built[0]}, not {model}")
    if query.strip():
        wanted = models.embed(spark.createDataFrame([(query,)], "q string"), "q", factory=factory).first()["embedding"]
        hits = retrieval.top_k(index, "row_idx", "embedding", list(wanted), k)
    else:
        hits = index.limit(0).select("row_idx", F.lit(0.0).alias("similarity"))
    shown = index.select("row_idx", "arxiv_id", "title", "body", "pdf_url")
    return hits.join(shown, "row_idx")  # k rows; sent to the index by their size


def answer_question(store: tables.Store, question: str, query: str | None = None, k: int = 5, max_chars: int = rag.MAX_CHARS, model: str = "hashing-64", factory: Callable | None = None, reader: Callable | None = None) -> DataFrame:
    """``factory`` makes the embedder that the index was built with, ``reader`` what
    answers from the context."""
    return rag.answer(retrieve(store, query or question, k, model, factory), "row_idx", question, max_chars, reader)
