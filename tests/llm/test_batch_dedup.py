import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.llm import batch_dedup as bd

PAPER = "record_id bigint, batch_no int, arxiv_id string, title string, summary string, updated string, tx string, first string"
TEXT = "words of a summary that is long enough to be told apart from any other text in this small table of ours"


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("1202.00920v1", "1202.00920"), (" 1202.00920V12", "1202.00920"), ("arXiv:1202.00920v1", "1202.00920"), ("arxiv:1202.00920 v1", "1202.00920"), ("1202.00920", "1202.00920"),
        ("https://x.example/abs/1202.00920v1", "1202.00920"), ("https://x.example/pdf/1202.00920v1.pdf", "1202.00920"), ("hep-th/9901001v2", "hep-th/9901001"), ("", None), ("junk", None), (None, None),
    ],
)
def test_article_id(spark, given, expected):
    df = spark.createDataFrame([(given,)], "c string")
    assert df.select(bd.article_id(F.col("c"))).first()[0] == expected


@pytest.mark.parametrize("given", ["2021-06-05", " 2021-06-05 ", "2021-06-05T10:00:00Z", "2021/06/05", "20210605", "5 Jun 2021", "05 Jun 2021", "Jun 5, 2021", "June 5, 2021"])
def test_days(spark, given):
    df = spark.createDataFrame([(given,)], "c string")
    assert df.select(bd.day_of(F.col("c"))).first()[0] == datetime.date(2021, 6, 5)


@pytest.mark.parametrize("given", [None, "", "unknown", "n/a", "2021-02-30", "20211301", "5 Foo 2021"])
def test_unreadable_days(spark, given):
    df = spark.createDataFrame([(given,)], "c string")
    assert df.select(bd.day_of(F.col("c"))).first()[0] is None


ROWS = [
    (1, 0, "2001.00001v1", "a", None, "2020-01-01"),
    (2, 0, "arXiv:2001.00001v2", "b", None, "2020-01-02"),  # newer
    (3, 1, "2001.00001", "c", None, "2020-01-02"),  # no newer than 2
    (4, 1, "2001.00001v3", "d", None, "unknown"),
    (5, 1, "2001.00002v1", "t", TEXT, None),
    (6, 2, "2001.00003v1", "T", TEXT + "!", "2020-01-01"),  # the text of 5 under another id; the first day of the paper
    (7, 2, "2001.00003v2", "z", None, "2019-01-01"),  # through 6
    (8, 3, None, None, None, "2020-01-01"),
    (9, 3, None, None, None, "2020-01-01"),
    (10, 3, "junk", "x", " ", None),
    (11, None, "2001.00001v1", "late", None, "2020-01-03"),
]
EXPECTED = {(1, 3), (1, 4), (5, 7)}


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAPER)


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_repeats_do_not_depend_on_the_batches(spark, parts):
    got = [tuple(r) for r in bd.find_repeats(table(spark), parts).collect()]
    assert len(got) == len(set(got)) and set(got) == EXPECTED


def test_batch_by_batch_with_compaction(spark):
    history = bd.History(spark, max_runs=1)
    df = table(spark)
    for b in (0, 1, 2, 3):
        history.ingest(df.where(F.coalesce("batch_no", F.lit(0)) == b))
    assert len(history.tables["runs"]) == 1
    version = history.version
    history.ingest(df.limit(0))
    assert history.version == version
    assert {tuple(r) for r in history.repeats().collect()} == EXPECTED


def test_another_session_goes_on(spark, tmp_path):
    df = table(spark)
    bd.History(spark, f"file://{tmp_path}/h").ingest(df.where("batch_no < 2"))
    bd.History(spark, f"file://{tmp_path}/h").ingest(df.where("batch_no >= 2 or batch_no is null"))
    assert {tuple(r) for r in bd.History(spark, f"file://{tmp_path}/h").repeats().collect()} == EXPECTED


def test_what_a_batch_reads_does_not_grow_with_the_history(spark):
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    text = lambda i: " ".join(f"{word[(i + j) % 10]}{(i * 7919 + j * j) % 9973}" for j in range(30))
    read = []
    for n in (200, 2000):
        rows = [(i, 0, None, "t", text(i), None) for i in range(n)]
        history = bd.History(spark, range_rows=100)
        history.ingest(table(spark, rows))
        one = table(spark, [(9999, 1, None, "t", text(5) + " more", None)])
        before = {kind: [] for kind in ("runs", "texts")}
        plain = history._read

        def counted(kind, schema, touched=None, plain=plain, before=before):
            df = plain(kind, schema, touched)
            if touched is not None:
                before[kind].append(df.count())
            return df

        history._read = counted
        history.ingest(one)
        read.append({k: sum(v) for k, v in before.items()})
        assert (5, 9999) in {tuple(r) for r in history.repeats().collect()}
    assert all(read[1][k] < 3 * max(read[0][k], 50) for k in read[0]), read


def test_repeated_rows_and_empty_table(spark):
    assert {tuple(r) for r in bd.find_repeats(table(spark, ROWS + ROWS)).collect()} == EXPECTED
    assert bd.find_repeats(table(spark, [])).count() == 0


def test_hot_paper_crosses_chunks(spark, monkeypatch):
    monkeypatch.setattr(bd, "CHUNK", 8)
    rows = [(i, 0, "2001.00001v1", "a", None, f"2020-{1 + i // 20:02d}-{1 + i % 20:02d}" if i % 3 else "2019-01-01") for i in range(1, 101)]
    got = {r.record_id for r in bd.find_repeats(table(spark, rows)).collect()}
    assert got == {i for i in range(2, 101) if i % 3 == 0}


def test_many_copies_are_chained(spark):
    rows = [(i, i % 4, f"20{i % 90 + 10}.{i:05d}", "t", TEXT + f" {i % 3}", "2020-01-01") for i in range(1, 200)]
    got = [tuple(r) for r in bd.find_repeats(table(spark, rows)).collect()]
    assert sorted(got) == [(1, i) for i in range(2, 200)]
