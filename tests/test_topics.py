import math

import pytest

from conftest import rows
from foliospark.operators import tfidf, topics


@pytest.fixture
def docs(spark):
    data = [(1, "star dust star", "a"), (2, "star ring", "a"), (3, "court ruling", "b"), (4, "", "b"), (5, None, "b")]
    return spark.createDataFrame(data, "id bigint, t string, g string")


def test_tfidf_by_hand(docs):
    got = {(r.id, r.term): r.weight for r in tfidf.tfidf(docs, "id", "t").collect()}
    idf = lambda df: math.log(6 / (1 + df)) + 1
    w = {"star": 2 * idf(2), "dust": idf(1), "star dust": idf(1), "dust star": idf(1)}
    length = math.sqrt(sum(x * x for x in w.values()))
    assert {t for i, t in got if i == 1} == set(w)
    assert all(abs(got[1, t] - x / length) < 1e-12 for t, x in w.items())


def test_vocabulary_keeps_the_most_frequent(docs):
    assert rows(tfidf.vocabulary(tfidf.term_counts(docs, "id", "t"), 1)) == [("star", 2)]


def test_top_terms_and_keywords(docs):
    out = {r.g: (r.doc_count, r.keywords, r.text_col) for r in tfidf.describe_topics(docs, "id", "t", "g", top=2).collect()}
    assert out["a"][0] == 2 and out["a"][1].split(", ")[0] == "star"
    assert out["b"][0] == 3 and len(out["b"][1].split(", ")) == 2 and out["b"][2] == "t"


def test_group_without_terms(spark):
    df = spark.createDataFrame([(1, "", "x")], "id bigint, t string, g string")
    assert rows(tfidf.describe_topics(df, "id", "t", "g")) == [("x", 1, "", "t")]


def test_build_topics_invariants(spark):
    words = ["star dust comet orbit", "court judge ruling appeal", "gene cell protein enzyme"]
    df = spark.createDataFrame([(i, f"{words[i % 3]} {words[i % 3]} item{i}") for i in range(30)], "id bigint, text_unit string")
    table, placed = topics.build_topics(df, "id", topics=3)
    got = table.collect()
    assert sum(r.doc_count for r in got) == 30 == placed.count()
    assert sorted(r.topic_id for r in got) == [0, 1, 2]
    assert [r.doc_count for r in got] == sorted((r.doc_count for r in got), reverse=True)
    assert all(len(r.keywords.split(", ")) == 10 for r in got)
    again, _ = topics.build_topics(df, "id", topics=3)
    assert rows(again) == rows(table)


def test_too_few_documents(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(4)], "id bigint, text_unit string")
    with pytest.raises(ValueError, match="need at least 5"):
        topics.build_topics(df, "id", topics=3)


def test_features_stay_sparse(spark):
    df = spark.createDataFrame([(i, f"word{i} other{i} star") for i in range(200)], "id bigint, t string")
    got = topics.features(df, "t").collect()
    assert all(type(r.features).__name__ == "SparseVector" and r.features.size > 500 and len(r.features.values) == 5 for r in got)
    idf = lambda df: math.log(201 / (1 + df)) + 1
    length = math.sqrt(idf(200) ** 2 + 4 * idf(1) ** 2)
    assert all(abs(min(r.features.values) - idf(200) / length) < 1e-12 and abs(max(r.features.values) - idf(1) / length) < 1e-12 for r in got)
