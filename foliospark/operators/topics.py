"""Topic modelling: TF-IDF features and k-means of MLlib."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import corpus, search, tfidf
from foliospark.session import materialise


def features(docs: DataFrame, column: str, most: int = tfidf.MAX_FEATURES, stop_words: tuple[str, ...] = text.STOP_WORDS) -> DataFrame:
    """Adds ``features``: TF-IDF with idf + 1, length 1."""
    docs = docs.withColumn("_terms", text.terms(F.col(column), stop_words))
    counts = CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=most, minDF=1).fit(docs).transform(docs)
    idf = IDF(inputCol="_counts", outputCol="_idf").fit(counts).idf
    # MLlib's idf lacks the + 1; vectors stay sparse, for one has as many places as there are terms
    weights = Vectors.dense([w + 1 for w in idf])
    weighted = ElementwiseProduct(scalingVec=weights, inputCol="_counts", outputCol="_weighted").transform(counts)
    return Normalizer(p=2.0, inputCol="_weighted", outputCol="features").transform(weighted).drop("_terms", "_counts", "_weighted")


def build_topics(docs: DataFrame, key: str, topics: int = 8, top: int = tfidf.TOP_TERMS, most: int = tfidf.MAX_FEATURES, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(topics by size, documents with topic_id).

    Raises ValueError with fewer non-empty documents than max(5, topics).
    """
    column = corpus.text_column(docs)
    docs = corpus.nonempty(docs, column)
    least = max(5, topics)
    have = docs.limit(least).count()
    if have < least:
        raise ValueError(f"{topics} topics need at least {least} documents; there are {have}")
    featured = features(docs.select(key, column), column, most).persist()
    try:
        model = KMeans(k=topics, seed=seed, featuresCol="features", predictionCol="topic_id").fit(featured)
        labels = materialise(model.transform(featured).select(key, F.col("topic_id").cast("int").alias("topic_id")), "topics")
    finally:
        featured.unpersist()
    placed = docs.join(labels, key)
    sizes = search.topic_sizes(labels, topics)
    words = tfidf.keywords(tfidf.top_terms(placed, key, column, "topic_id", top, most), "topic_id")
    table = sizes.join(words.withColumn("topic_id", F.col("topic_id").cast("bigint")), "topic_id", "left")
    table = table.select("topic_id", "doc_count", F.coalesce("keywords", F.lit("")).alias("keywords"), F.lit(column).alias("text_col"))
    return table.orderBy(F.desc("doc_count"), "topic_id"), placed
