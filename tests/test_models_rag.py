import pytest
from pyspark.sql import functions as F

from foliospark.operators import models, rag

HITS = "id bigint, similarity double, title string, body string, pdf_url string"


def test_lead_summary_keeps_sentences(spark):
    t = "One two three. Four five six. Seven eight nine ten eleven."
    df = spark.createDataFrame([(t,), (None,), ("  ",), ("a b c d e f g h",)], "t string")
    out = [r.s for r in models.summarize(df, "t", "s", max_length=7, min_length=4).collect()]
    assert out == ["One two three. Four five six.", "", "", "a b c d e f g"]


def test_summary_bounds_are_checked(spark):
    with pytest.raises(ValueError, match="min_length"):
        models.summarize(spark.createDataFrame([("x",)], "t string"), "t", max_length=3, min_length=4)


def test_own_summarizer_is_not_asked_for_blanks(spark):
    class Upper:
        def summarize(self, texts, max_length, min_length):
            assert all(t.strip() for t in texts)
            return [t.upper() for t in texts]

    df = spark.createDataFrame([("a",), ("",), (None,), (" ",)], "t string")
    assert [r.s for r in models.summarize(df, "t", "s", factory=Upper).collect()] == ["A", "", "", ""]


def test_embedders_agree(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, ""), (3, "Über 2d _x")], "id bigint, t string")
    by_row = {r.id: list(r.embedding) for r in models.embed(df, "t").collect()}
    assert by_row[2] == []
    assert all(abs(sum(x * x for x in by_row[i]) - 1) < 1e-6 for i in (1, 3))
    for r in models.hashed_embedding(df, "id", "t").collect():
        assert abs(by_row[r.id][r.pos] - r.value) < 1e-5


def test_reader_of_ones_own(spark):
    class First:
        def answer(self, question, context):
            return context.split()[0], 1.0

    df = spark.createDataFrame([("x y",), (None,)], "c string")
    assert [tuple(r.read) for r in models.read(df, "c", "q", First).collect()] == [("x", 1.0), ("", 0.0)]


def test_budget_keeps_what_begins_within_it(spark):
    df = spark.createDataFrame([(1, 0.9, "a", "b", None), (2, 0.8, None, "c", "u"), (3, 0.7, "d", None, "")], HITS)
    first = len("TITLE: a\nCONTENT: b\n")
    kept = rag.packed_chunks(df, "id", first).collect()
    assert [r.id for r in kept] == [1, 2]  # the second begins at the budget
    out = rag.context(df, "id", first).first()
    assert out.n_chunks == 2 and out.n_chars == first and out.context == "TITLE: a\nCONTENT: b\n"
    assert [tuple(r) for r in rag.sources(df, "id", first).collect()] == [("a", 0.9, ""), ("Untitled", 0.8, "u")]


def test_answer(spark):
    df = spark.createDataFrame([(1, 0.9, "a", "Graphene is strong. Copper is red.", "u")], HITS)
    r = rag.answer(df, "id", "Which metal is red?").first()
    assert r.answer == "Copper is red" and r.error is None and [tuple(s) for s in r.sources] == [("a", 0.9, "u")] and 0 < r.score <= 1


def test_answer_of_a_reader_of_ones_own(spark):
    class Last:
        def answer(self, question, context):
            return context.split()[-1] + question, 0.25

    df = spark.createDataFrame([(1, 0.9, "a", "Graphene is strong.", "u")], HITS)
    r = rag.answer(df, "id", "?", reader=Last).first()
    assert (r.answer, r.score, r.error) == ("strong.?", 0.25, None)
    assert rag.answer(df.limit(0), "id", "?", reader=Last).first().answer == ""


def test_top_sources(spark):
    df = spark.createDataFrame([(i, 1 - i / 10, f"t{i}", "b", None) for i in range(5)], HITS)
    assert [(r.rank, r.title, r.pdf_url) for r in rag.top_sources(df, "id").collect()] == [(1, "t0", ""), (2, "t1", ""), (3, "t2", "")]


def test_answer_without_context(spark):
    r = rag.answer(spark.createDataFrame([], HITS), "id", "q").first()
    assert (r.answer, r.score, r.sources, r.context_preview, r.error) == ("", 0.0, [], "", rag.NO_CONTEXT)


def test_answer_without_shared_words(spark):
    df = spark.createDataFrame([(1, 0.9, "a", "b", "u")], HITS)
    r = rag.answer(df, "id", "zebra?").first()
    assert (r.answer, r.score, r.error) == ("", 0.0, None)


def test_question_column(spark):
    df = spark.createDataFrame([("x",)], "c string")
    assert tuple(df.select(models.sentence_answer(F.col("c"), "").alias("a")).first().a) == ("", 0.0)
