import json

import pytest

from conftest import rows
from foliospark import __main__ as cli
from foliospark import schemas
from foliospark.operators.corpus import clean_corpus
from foliospark.plans import pipeline
from foliospark.sources import documents, papers, tables
from foliospark.streaming import ingest

NOUNS = ["star", "court", "gene", "glacier", "market", "pixel", "protein", "verdict"]


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    entries = [
        {"entry_id": f"http://x.example/abs/2001.0000{i}v1", "title": f" The {n}\nand more ", "summary": f"We study the {n}. It is a {n} of {NOUNS[-i]}.", "authors": [{"name": "A B"}, {"name": "C D"}], "published": f"2020-01-0{i + 1}T00:00:00", "updated": None, "primary_category": "cs.CL" if i % 2 else "cs.LG", "pdf_url": None}
        for i, n in enumerate(NOUNS)
    ]
    (source / "a.jsonl").write_text("\n".join(json.dumps(e) for e in entries[:5]) + "\n\n")
    (source / "b.jsonl").write_text("\n".join(json.dumps(e) for e in entries[5:]))
    (source / "notes.txt").write_text("not a source")
    return source


def test_papers_source(spark, folder):
    found = papers.fetch_papers(spark, str(folder), max_results=3).collect()
    assert [r.published for r in found] == ["2020-01-08", "2020-01-07", "2020-01-06"]
    assert found[0].arxiv_id == "2001.00007v1" and found[0].title == "The verdict and more" and found[0].authors == "A B, C D" and found[0].updated == ""
    assert {r.primary_category for r in papers.fetch_papers(spark, str(folder), category="cs.CL").collect()} == {"cs.CL"}
    assert [r.arxiv_id for r in papers.fetch_papers(spark, str(folder), query="the GLACIER").collect()] == ["2001.00005v1", "2001.00003v1"]
    assert papers.fetch_papers(spark, str(folder)).schema == schemas.METADATA


def test_papers_source_of_python_reads_the_search_string(spark, folder):
    spark.dataSource.register(papers.PapersSource)
    search = "cat:cs.CL AND (the glacier)"
    by_source = spark.read.format("papers").option("search", search).load(str(folder))
    assert rows(by_source) == rows(papers.fetch_papers(spark, str(folder), "the glacier", "cs.CL")) and by_source.count() == 2


def test_papers_of_csv_files_and_listed_authors(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,arxiv_id,authors,published\n"A ""b""\nc",1,"X, Y",2020-01-02T03\n')
    (tmp_path / "b.json").write_text(json.dumps({"arxiv_id": "2", "authors": ["P", "Q"], "published": "2020-01-03"}) + "\n")
    got = [(r.arxiv_id, r.title, r.authors, r.published, r.summary) for r in papers.fetch_papers(spark, str(tmp_path)).collect()]
    assert got == [("2", "", "P, Q", "2020-01-03", ""), ("1", 'A "b" c', "X, Y", "2020-01-02", "")]


def test_csv_keeps_breaks_and_quotes_and_reads_missing_cells(spark, tmp_path):
    data = [("1", 'a "b"\nc', "NA"), ("2", "x,y", "2020-01-02")]
    df = spark.createDataFrame(data, "id string, t string, d string")
    tables.write_csv(df, str(tmp_path / "t"))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("t", T.StringType()), T.StructField("d", T.DateType())])
    got = tables.read_csv(spark, str(tmp_path / "t"), schema).orderBy("id").collect()
    assert got[0].t == 'a "b"\nc' and got[0].d is None and str(got[1].d) == "2020-01-02"


def test_nothing_found_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "m")
    one = spark.createDataFrame([("x",)], "arxiv_id string")
    assert tables.write_metadata(one, path)
    assert not tables.write_metadata(one.limit(0), path)
    assert spark.read.parquet(path).count() == 1


def test_not_built(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    for load in (store.metadata, store.clean, store.best_corpus, store.embeddings, store.topics, store.corpus_with_topics):
        with pytest.raises(tables.NotBuiltError):
            load()
    assert issubclass(tables.NotBuiltError, FileNotFoundError)


def test_pipeline(spark, folder, tmp_path):
    store = tables.Store(spark, str(tmp_path / "store"))
    pipeline.ingest(spark, store, str(folder), "")
    assert pipeline.clean(store).count() == 8
    assert store.best_corpus().columns == list(schemas.CORPUS_CLEAN.names)
    assert pipeline.summarise(store).columns == list(schemas.CORPUS_WITH_SUMMARIES.names)
    index = pipeline.embed(store).orderBy("row_idx").collect()
    assert [r.row_idx for r in index] == list(range(8)) and all(r.embedded_text_col == "summary" for r in index)
    table, placed = pipeline.build_topics(store, n_topics=2)
    assert table.count() == 2 and placed.count() == 8
    hits = pipeline.retrieve(store, "a glacier", 2)
    assert hits.orderBy("similarity", ascending=False).first().title == "The glacier and more"
    assert pipeline.retrieve(store, "  ").count() == 0
    with pytest.raises(ValueError, match="built with"):
        pipeline.retrieve(store, "x", model="other")
    r = pipeline.answer_question(store, "What is the glacier?", k=3).first()
    assert "glacier" in r.answer and len(r.sources) == 3


def test_rows_with_repeated_and_missing_ids_are_kept(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "store"))
    found = [("1", "comet dust", "tail"), ("1", None, " "), ("1", "comet ice", "core"), (None, "glacier melt", "water"), (None, "desert sand", "dune"), ("2", "ocean salt", "wave")]
    tables.write(spark.createDataFrame([(*r, None, None, None, None, None) for r in found], schemas.METADATA), store.path("metadata"))
    best = pipeline.clean(store).selectExpr("*", "if(title_clean = '', ' ', text_unit) as summary")
    tables.write(best, store.path("corpus_with_summaries"))
    index = pipeline.embed(store).collect()
    assert sorted(r.title for r in index) == ["comet dust", "comet ice", "desert sand", "glacier melt", "ocean salt"]
    assert sorted(r.row_idx for r in index) == list(range(5))
    _, placed = pipeline.build_topics(store, n_topics=2)
    assert placed.count() == 5
    assert pipeline.retrieve(store, "glacier melt water", 1).first().title == "glacier melt"


def test_files_that_cannot_be_had_do_not_stop_others(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    df = spark.createDataFrame([("hep/1", str(tmp_path / "a.pdf")), ("2", "https://x.example/b.pdf"), ("3", None)], "arxiv_id string, pdf_url string")
    got = {r.key: r for r in documents.fetch_files(df, str(tmp_path / "pdfs")).collect()}
    assert got["hep/1"].status == "ok" and got["2"].status.startswith("failed") and got["3"].path is None
    assert documents.read_files(spark, str(tmp_path / "pdfs")).count() == 1


def test_stream_takes_new_files_and_drops_papers_seen(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    line = lambda i: json.dumps({"arxiv_id": i, "title": " t\n", "updated": "2020-01-02"})
    (source / "1.json").write_text("\n".join(map(line, "aab")))
    ingest.ingest_available(spark, str(source), target, state).awaitTermination()
    (source / "2.json").write_text("\n".join(map(line, "bc")))
    ingest.ingest_available(spark, str(source), target, state).awaitTermination()
    assert rows(spark.read.parquet(target).select("arxiv_id", "title_clean")) == [("a", "t"), ("b", "t"), ("c", "t")]


def test_stream_keeps_new_papers_of_any_day(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    line = lambda x: json.dumps({"arxiv_id": x[0], "title": "t", "updated": x[1]})
    for name, papers_in in (("1", [("a", "2024-06-01")]), ("2", [("b", "2024-06-02")]), ("3", [("c", "2001-01-01"), ("d", None), ("e", "1 June 2024"), ("a", "2024-09-01")])):
        (source / f"{name}.json").write_text("\n".join(map(line, papers_in)))
        ingest.ingest_available(spark, str(source), target, state).awaitTermination()
    assert rows(spark.read.parquet(target).select("arxiv_id")) == [("a",), ("b",), ("c",), ("d",), ("e",)]


def test_command_line(spark, folder, tmp_path):
    a = cli.parser().parse_args(["ingest", "--query", "q", "--source", "s"])
    assert (a.max_results, a.category, a.download_pdfs, a.output_dir) == (20, None, False, "data/papers")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["ingest", "--source", "s"])
    cli.main(["ingest", "--query", "star", "--source", str(folder), "--output_dir", str(tmp_path / "o")])
    cli.main(["clean", "--output_dir", str(tmp_path / "o")])
    assert tables.Store(spark, str(tmp_path / "o")).clean().count() == 1


def test_clean_corpus_of_metadata_schema(spark):
    got = clean_corpus(spark.createDataFrame([], schemas.METADATA)).schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in schemas.CORPUS_CLEAN]
