"""TF-IDF as relations, and topic keywords from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text

MAX_FEATURES, TOP_TERMS = 20_000, 10


def term_counts(docs: DataFrame, key: str, column: str, stop_words: tuple[str, ...] = text.STOP_WORDS, pairs: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, term, tf) of words and, with ``pairs``, of neighbouring words."""
    found = text.terms(F.col(column), stop_words) if pairs else text.tokens(F.col(column), stop_words)
    # the filters are those a join would infer: all uses then share one exchange
    words = docs.where(F.col(key).isNotNull()).select(key, *carry, F.explode(found).alias("term")).where("term is not null")
    return words.groupBy(key, *carry, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, most: int = MAX_FEATURES) -> DataFrame:
    """(term, df) of the terms that occur most often, at most ``most``."""
    stats = counts.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))
    return stats.orderBy(F.desc("n"), "term").limit(most).select("term", "df")


def tfidf(docs: DataFrame, key: str, column: str, most: int = MAX_FEATURES, stop_words: tuple[str, ...] = text.STOP_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, term, weight): tf * (ln((1+n)/(1+df)) + 1), length 1 per document.

    The vocabulary has at most ``most`` terms, so it is broadcast; the counts are
    not shuffled again by term.
    """
    n_docs = docs.select(F.count(F.lit(1)).alias("n_docs"))
    counts = term_counts(docs, key, column, stop_words, carry=carry)
    kept = counts.join(F.broadcast(vocabulary(counts, most)), "term").crossJoin(F.broadcast(n_docs))
    raw = kept.withColumn("w", F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, *carry, "term", (F.col("w") / length).alias("weight"))


def top_terms(docs: DataFrame, key: str, column: str, group: str, top: int = TOP_TERMS, most: int = MAX_FEATURES, stop_words: tuple[str, ...] = text.STOP_WORDS) -> DataFrame:
    """(group, term, weight, rank): terms of the highest mean weight in a group's
    documents, which is the centroid of the group. A document is in one group."""
    grouped = docs.where(F.col(group).isNotNull())
    weights = tfidf(grouped, key, column, most, stop_words, (group,))
    sizes = grouped.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    means = weights.groupBy(group, "term").agg(F.sum("weight").alias("w")).join(sizes, group)
    means = means.select(group, "term", F.round(F.col("w") / F.col("size"), 6).alias("weight"))
    order = Window.partitionBy(group).orderBy(F.desc("weight"), "term")
    return means.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)


def keywords(ranked: DataFrame, group: str) -> DataFrame:
    """(group, keywords): a group's terms in order of rank, joined by ", "."""
    in_order = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return ranked.groupBy(group).agg(F.array_join(F.transform(in_order, lambda x: x["term"]), ", ").alias("keywords"))


def describe_topics(docs: DataFrame, key: str, column: str, group: str, top: int = TOP_TERMS, most: int = MAX_FEATURES) -> DataFrame:
    """(group, doc_count, keywords, text_col)."""
    sizes = docs.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("doc_count"))
    words = keywords(top_terms(docs, key, column, group, top, most), group)
    return sizes.join(words, group, "left").select(group, "doc_count", F.coalesce("keywords", F.lit("")).alias("keywords"), F.lit(column).alias("text_col"))
