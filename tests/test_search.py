import pytest

from conftest import rows
from foliospark.operators import search


@pytest.fixture
def papers(spark):
    data = [(1, "C++ guide", None), (2, "abc", "A.C"), (3, None, "axc and ("), (4, "nan", "z")]
    return spark.createDataFrame(data, "id int, title string, summary string")


@pytest.mark.parametrize(
    ("query", "regex", "ids"),
    [("", False, [1, 2, 3, 4]), (" ", False, [1, 3]), ("c++", False, [1]), ("a.c", False, [2]), ("a.c", True, [2, 3]), ("(", False, [3]), ("nan", False, [4]), ("\\S", True, [1, 3])],
)
def test_keyword_search(papers, query, regex, ids):
    found = search.keyword_search(papers, query, ["title", "summary"], ["id"], regex=regex)
    assert [r.id for r in found.collect()] == ids


def test_keyword_search_limits_in_order(papers):
    assert [r.id for r in search.keyword_search(papers, "", ["title"], ["id"], k=2).collect()] == [1, 2]


def test_bad_pattern_is_refused_before_running(papers):
    with pytest.raises(ValueError, match="bad pattern"):
        search.keyword_search(papers, "(", ["title"], ["id"], regex=True)


def test_source_query():
    assert search.source_query("a b", "cs.CL") == "cat:cs.CL AND (a b)"
    assert search.source_query("a b", "") == search.source_query("a b") == "a b"


def test_newest_first(spark):
    df = spark.createDataFrame([(1, "2020", "x"), (2, None, "x"), (3, "2021", "y"), (4, "2020", "x")], "id int, d string, primary_category string")
    assert [r.id for r in search.newest_first(df, "d", ["id"]).collect()] == [3, 1, 4, 2]
    assert [r.id for r in search.newest_first(df, "d", ["id"], 2, "x").collect()] == [1, 4]


def test_topic_sizes_has_empty_topics(spark):
    df = spark.createDataFrame([(0,), (2,), (2,), (None,), (9,)], "topic_id int")
    assert rows(search.topic_sizes(df, 4)) == [(0, 1), (1, 0), (2, 2), (3, 0)]


def test_topic_rows(spark):
    df = spark.createDataFrame([("b", 1, "t"), ("a", 1, "t"), ("c", 2, "t")], "arxiv_id string, topic_id int, title_clean string")
    assert [r.arxiv_id for r in search.topic_rows(df, 1, ["arxiv_id"]).collect()] == ["a", "b"]
