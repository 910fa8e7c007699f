import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [(None, ""), ("", ""), ("  a  b ", "a b"), ("a\nb", "a b"), ("\t x\n", "x"), ("ions+e", "ions+e"), ("\u00a0a\u00a0\u3000b\u00a0", "a b")],
)
def test_clean_text(spark, given, expected):
    assert one(spark, given, text.clean_text) == expected


@pytest.mark.parametrize(("given", "expected"), [("ions+e", "ion e"), ("a  b", "a  b"), ("s++x", "+x"), (None, "")])
def test_clean_text_strict(spark, given, expected):
    assert one(spark, given, lambda c: text.clean_text(c, strict=True)) == expected


def test_ingest_text_strips_before_replacing(spark):
    assert one(spark, "\n a\nb \n", text.ingest_text) == "a b"
    assert one(spark, "a \n b", text.ingest_text) == "a   b"


@pytest.mark.parametrize(("given", "expected"), [("https://x.example/abs/2301.00001v2", "2301.00001v2"), ("2301.00001v2", "2301.00001v2"), (None, None)])
def test_short_id(spark, given, expected):
    assert one(spark, given, text.short_id) == expected


@pytest.mark.parametrize(("given", "expected"), [("2025-12-04", datetime.date(2025, 12, 4)), ("", None), ("garbage", None), (None, None), ("2025-02-30", None), (" 2025-12-04 ", datetime.date(2025, 12, 4))])
def test_parse_day(spark, given, expected):
    assert one(spark, given, text.parse_day) == expected


def test_day_text(spark):
    assert one(spark, datetime.date(2020, 1, 2), text.day_text, "date") == "2020-01-02"
    assert one(spark, None, text.day_text, "date") == ""


def test_tokens(spark):
    assert one(spark, "Ééanon _3 2d a é über", text.tokens) == ["ééanon", "_3", "2d", "über"]
    assert one(spark, None, text.tokens) == []
    assert one(spark, "the star and the dust", lambda c: text.tokens(c, text.STOP_WORDS)) == ["star", "dust"]


def test_bigrams_after_stop_words(spark):
    assert one(spark, "star of the dust ring", text.terms) == ["star", "dust", "ring", "star dust", "dust ring"]
    assert one(spark, "star", text.terms) == ["star"]
    assert one(spark, "", text.terms) == []


def test_first_filled(spark):
    df = spark.createDataFrame([(None, "", "c"), ("a", "b", "c"), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(text.first_filled("a", "b", "c")).collect()] == ["c", "a", ""]


def test_preview(spark):
    assert one(spark, "x" * 800, text.preview) == "x" * 800
    assert one(spark, "x" * 801, text.preview) == "x" * 800 + "..."


def test_meta_line(spark):
    df = spark.createDataFrame([(None, "2020-01-02"), ("A", None), ("A", "2020")], "a string, p string")
    assert [r[0] for r in df.select(text.meta_line(F.col("a"), F.col("p"))).collect()] == ["Unknown authors | 2020-01-02", "A", "A | 2020"]


def test_blank(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("\t",), ("nan",), ("x",)], "c string")
    assert [r[0] for r in df.select(text.is_blank(F.col("c"))).collect()] == [True, True, True, True, False, False]


def test_long_inner_blanks_are_linear(spark):
    long = "a" + " " * 300_000 + "b"
    assert one(spark, long, text.strip) == long
