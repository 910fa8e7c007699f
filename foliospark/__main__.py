"""python -m foliospark: the stages of a corpus from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from foliospark.plans import pipeline
from foliospark.sources.tables import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliospark")
    sub = p.add_subparsers(dest="stage", required=True)
    ingest = sub.add_parser("ingest", help="papers that match, newest first")
    ingest.add_argument("--query", required=True)
    ingest.add_argument("--max_results", type=int, default=20)
    ingest.add_argument("--category", default=None)
    ingest.add_argument("--download_pdfs", action="store_true")
    ingest.add_argument("--source", required=True, help="files of the paper source")
    for name in ("clean", "summarise", "embed"):
        sub.add_parser(name)
    topics = sub.add_parser("topics")
    topics.add_argument("--n_topics", type=int, default=8)
    topics.add_argument("--top_terms", type=int, default=10)
    ask = sub.add_parser("ask")
    ask.add_argument("--question", required=True)
    ask.add_argument("--query", default=None)
    ask.add_argument("--k", type=int, default=5)
    for s in sub.choices.values():
        s.add_argument("--output_dir", default="data/papers")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    store = Store(spark, a.output_dir)
    if a.stage == "ingest":
        found = pipeline.ingest(spark, store, a.source, a.query, a.category, a.max_results)
        if a.download_pdfs:
            from foliospark.sources.documents import fetch_files

            fetch_files(found, f"{a.output_dir}/pdfs").show(truncate=False)
    elif a.stage == "clean":
        pipeline.clean(store)
    elif a.stage == "summarise":
        pipeline.summarise(store)
    elif a.stage == "embed":
        pipeline.embed(store)
    elif a.stage == "topics":
        pipeline.build_topics(store, a.n_topics, a.top_terms)[0].show(truncate=False)
    else:
        pipeline.answer_question(store, a.question, a.query, a.k).show(truncate=False)


if __name__ == "__main__":
    main()
