"""Named queries of the core and their SQL for DuckDB.

Every query reads whole tables. A limit stands only where it is the feature: a
top-k search, a browse page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import text, vectors
from foliospark.operators import corpus, models, packed, rag, retrieval, search, tfidf, topics
from foliospark.plans import pipeline
from foliospark.session import spread, temporary_path
from foliospark.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

QUESTION = "What is reported for the neutron star and the light curve?"
PAGE = ["arxiv_id", "run_id", "title_clean", "published", "pdf_url"]
TOPICS, TOPIC, CATEGORY = 20, 3, "cs.LG"
QUERY_EVERY = 20  # queries of a batch search: ids divisible by this


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts cost much work per row."""
    return spread(table(spark, sf_dir, name))


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "paper_metadata")


def _clean(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return corpus.clean_corpus(_papers(spark, sf_dir), strict, keep=("record_id",))


def _days_as_text(df: DataFrame) -> DataFrame:
    """Dates as yyyy-MM-dd, so that results compare alike everywhere."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


# --- cleaning and choice of columns


def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days_as_text(_clean(spark, sf_dir))


def clean_corpus_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir, strict=True).select("record_id", "title_clean", "abstract_clean")


def ingest_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).select("record_id", text.short_id(F.col("arxiv_id")).alias("short_id"), text.ingest_text(F.col("title")).alias("title"), text.ingest_text(F.col("summary")).alias("summary"))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: text.parse_day(F.col(c))
    return _days_as_text(_papers(spark, sf_dir).select("record_id", day("published").alias("published"), day("updated").alias("updated"), text.day_text(day("updated")).alias("updated_text")))


def topics_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered string aggregation: a run's topics in the order written."""
    in_order = F.sort_array(F.collect_list(F.struct("topic_row", "topic_id")))
    joined = F.array_join(F.transform(in_order, lambda x: x["topic_id"].cast("string")), ", ")
    return table(spark, sf_dir, "topics").groupBy("run_id").agg(joined.alias("topics"))


def choose_text_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "corpus_with_topics")
    return df.agg(F.lit(corpus.text_column(df)).alias("text_col"), F.count(F.lit(1)).alias("n"))


def nonempty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.nonempty(_papers(spark, sf_dir), "summary")
    return rows.select("record_id", F.length("summary").cast("bigint").alias("n_chars"))


def display_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = corpus.display_view(table(spark, sf_dir, "corpus_with_topics"))
    return df.select(
        "arxiv_id",
        "show_title",
        "show_abstract",
        "show_summary",
        text.first_filled(F.col("summary"), F.col("abstract_clean"), F.col("text_unit")).alias("body"),
        text.meta_line(F.col("authors"), F.col("published")).alias("meta"),
        (~text.is_blank(F.col("pdf_url"))).alias("has_link"),
        search.same_text("abstract_clean", "summary").alias("summary_is_abstract"),
    )


def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.embedding_index(_papers(spark, sf_dir), ["record_id"], "summary", "hashing-64")


# --- search and browsing


def newest_first_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days_as_text(search.newest_first(_clean(spark, sf_dir), "published", ["record_id"]).select("record_id", "published", "title_clean"))


def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days_as_text(search.newest_first(_clean(spark, sf_dir), "published", ["record_id"], category=CATEGORY).select("record_id", "published", "primary_category"))


def _keyword(spark: SparkSession, sf_dir: str, query: str, regex: bool = False) -> DataFrame:
    found = search.keyword_search(_papers(spark, sf_dir), query, ["title", "summary", "authors"], ["record_id"], regex=regex)
    return found.select("record_id", "title")


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir, "Neutron Star")


def keyword_search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir, "(light|yield) curve[s.,]", regex=True)


def keyword_empty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir, "")


def topic_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.topic_sizes(table(spark, sf_dir, "corpus_with_topics"), TOPICS)


def topic_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days_as_text(search.topic_rows(table(spark, sf_dir, "corpus_with_topics"), TOPIC, PAGE))


def topic_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic ids as a selector shows them: largest first."""
    df = table(spark, sf_dir, "topics")
    return df.where("topic_id is not null").groupBy("topic_id").agg(F.sum(F.greatest(F.coalesce("doc_count", F.lit(0)), F.lit(0))).cast("bigint").alias("doc_count")).orderBy(F.desc("doc_count"), "topic_id")


# --- vectors


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.unit(F.col("embedding"))).alias("p", "v"))
    return rows.select("vec_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("v", 6).alias("value"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return retrieval.vector_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0)


def dot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in _query_vector(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), wanted), 6).alias("similarity"))


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    found = retrieval.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), k)
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), F.split("text", "\n", 2)[0].alias("title"), F.get(F.split("text", "\n", 2), F.lit(1)).alias("body"), F.concat(F.lit("https://papers.example/pdf/"), "arxiv_id").alias("pdf_url")
    )
    return found.join(docs, "vec_id")


def semantic_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, 10).select(F.col("vec_id").alias("doc_id"), "similarity", "title")


def semantic_top_k_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "embeddings")
    return retrieval.top_k_batch(index, index.where(F.col("vec_id") % QUERY_EVERY == 0), "vec_id", "embedding")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")


def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "embeddings")
    return retrieval.assign_nearest(index, "vec_id", "embedding", retrieval.centroids(index, "label", "embedding"), "label")


# --- terms and topics


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tfidf.term_counts(_texts(spark, sf_dir, "documents"), "doc_id", "text", (), pairs=False)
    return counts.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokens(F.col("summary"), text.STOP_WORDS)
    pairs = _texts(spark, sf_dir, "paper_metadata").select(F.explode(text.bigrams(words)).alias("bigram"))
    return pairs.groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


def tfidf_topterms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.clean_corpus(_texts(spark, sf_dir, "paper_metadata"), keep=("record_id",))
    return tfidf.top_terms(docs, "record_id", "text_unit", "primary_category")


def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.describe_topics(_texts(spark, sf_dir, "documents"), "doc_id", "text", "section")


def kmeans_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _clean(spark, sf_dir).select("record_id", "text_unit")
    return topics.build_topics(docs, "record_id")[0]


# --- retrieval-augmented answers


def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.context(_hits(spark, sf_dir, 10), "vec_id", 2500)


def rag_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.sources(_hits(spark, sf_dir, 10), "vec_id", 2500)


def rag_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.top_sources(_hits(spark, sf_dir, 10), "vec_id", 2500)


def context_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.context(_hits(spark, sf_dir, 10), "vec_id", 2500).select(text.preview(F.col("context")).alias("context_preview"))


def answer_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rag.answer(_hits(spark, sf_dir, 10), "vec_id", QUESTION, 2500)
    return found.select("answer", "score", F.size("sources").cast("bigint").alias("n_sources"), "context_preview", "error")


def summarize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.summarize(_clean(spark, sf_dir), "text_unit", max_length=40, min_length=12).select("record_id", "model_summary")


def embed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.hashed_embedding(_texts(spark, sf_dir, "paper_metadata"), "record_id", "summary")


# --- tables between the stages, written and read again


def _store(spark: SparkSession, sf_dir: str) -> tables.Store:
    store = tables.Store(spark, temporary_path(spark, "store"))
    tables.write_metadata(_papers(spark, sf_dir).select(*schemas.METADATA.names), store.path("metadata"))
    return store


def store_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata; fetching nothing leaves it as it was."""
    store = _store(spark, sf_dir)
    tables.write_metadata(store.metadata().limit(0), store.path("metadata"))
    return store.metadata()


def store_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days_as_text(pipeline.clean(_store(spark, sf_dir)))


def store_best_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with summaries, which is better than the clean one."""
    store = _store(spark, sf_dir)
    pipeline.clean(store)
    pipeline.summarise(store, max_length=40, min_length=12)
    return _days_as_text(store.best_corpus())


def store_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index keeps of each row with text, without the vectors' values."""
    store = _store(spark, sf_dir)
    pipeline.clean(store)
    index = pipeline.embed(store)
    return _days_as_text(index.select("arxiv_id", *corpus.INDEX_COLUMNS, "embedded_text_col", "embedding_model", F.size("embedding").cast("bigint").alias("dimensions")))


def store_topics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics through CSV: types come back, cells that say "missing" are null."""
    df = table(spark, sf_dir, "topics").select("topic_row", "run_id", "topic_id", "doc_count", "keywords", "text_col")
    path = temporary_path(spark, "csv")
    tables.write_csv(df, path)
    return tables.read_csv(spark, path, df.schema)


def store_corpus_with_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic of the corpus laid out by topic: a scan of its folder only."""
    store = tables.Store(spark, temporary_path(spark, "store"))
    tables.write(table(spark, sf_dir, "corpus_with_topics"), store.path("corpus_with_topics"), partition_by="topic_id")
    return store.corpus_with_topics().where(F.col("topic_id") == TOPIC).select("arxiv_id", "run_id", "title_clean", F.col("topic_id").cast("bigint").alias("topic_id"))


# --- packed fields


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value packed in authors or keywords, with its place."""
    return packed.split_fields(_texts(spark, sf_dir, "paper_metadata"), _texts(spark, sf_dir, "topics"))


def queries() -> dict[str, Query]:
    found = (
        clean_corpus, clean_corpus_strict, ingest_clean, parse_dates, topics_per_run, choose_text_column, nonempty_filter, display_fallbacks, row_index,
        newest_first_limit, category_filter, keyword_search, keyword_search_regex, keyword_empty_query, topic_sizes, topic_browse, topic_list,
        l2_normalize, dot_all, semantic_top_k, semantic_top_k_batch, centroids, assign_nearest,
        tokenize_counts, bigrams, tfidf_topterms, topic_keywords, kmeans_topics,
        rag_context, rag_sources, rag_top_sources, context_preview, answer_question, summarize_docs, embed_docs,
        store_metadata, store_clean, store_best_corpus, store_embeddings, store_topics_csv, store_corpus_with_topics, p5_found,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from foliospark.plans.oracle import SQL

    return dict(SQL)
