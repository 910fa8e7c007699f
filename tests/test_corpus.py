import pytest

from conftest import rows
from foliospark.operators import corpus

META = "arxiv_id string, title string, summary string, authors string, published string, updated string, primary_category string, pdf_url string"


def test_clean_corpus_columns_and_values(spark):
    df = spark.createDataFrame([("1v1", " A\nB ", None, "X", "2020-01-02", "bad", "c", "u")], META)
    out = corpus.clean_corpus(df)
    assert tuple(out.columns) == corpus.CLEAN_COLUMNS
    r = out.first()
    assert (r.title_clean, r.abstract_clean, r.text_unit, str(r.published), r.updated) == ("A B", "", "A B. ", "2020-01-02", None)


def test_pick_falls_back(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert corpus.pick(df, ("z", "b")).columns == ["b"]
    assert corpus.pick(df, ("z",)).columns == ["a", "b"]
    assert corpus.pick(df, ("z",), ("a",)).columns == ["a"]


def test_text_column(spark):
    assert corpus.text_column(spark.createDataFrame([(None, "t")], "summary string, text_unit string")) == "text_unit"
    assert corpus.text_column(spark.createDataFrame([(None, "t"), ("s", "t")], "summary string, text_unit string")) == "summary"
    assert corpus.text_column(spark.createDataFrame([("t",)], "text_unit string")) == "text_unit"


def test_nonempty_drops_null_and_blank(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t",), ("nan",), ("x",)], "c string")
    assert rows(corpus.nonempty(df, "c")) == [("nan",), ("x",)]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_dense_index(spark, n):
    df = spark.range(n).selectExpr("(id * 7919) % 100003 as k", "id as _part_of", "id as other")
    out = corpus.dense_index(df.repartition(5), ["k"]).orderBy("k").collect()
    assert [r.row_idx for r in out] == list(range(n))


def test_display_view_chooses_by_columns(spark):
    r = corpus.display_view(spark.createDataFrame([("t", None)], "title_clean string, summary string")).first()
    assert (r.show_title, r.show_abstract, r.show_summary, r.text_unit) == ("t", "", "", "t. ")
    r = corpus.display_view(spark.createDataFrame([(1,)], "x int")).first()
    assert (r.show_title, r.show_abstract, r.show_summary) == ("Untitled", "", "")
