"""The paper source: ``spark.read.format("papers")``.

Options: ``path`` (files of JSON lines or CSV with the metadata's columns, or
with ``authors`` as a list), ``query`` (words that title or summary must hold),
``category``, or both as one ``search`` string, ``max_results`` (newest first;
20). This source reads files of the machines it runs on; ``read_papers`` reads the
same files from any file system of Spark, split and in parallel. A folder's files are its
partitions; each reads itself and keeps its newest rows, so no more than
``max_results`` rows per file leave a worker.
"""

from __future__ import annotations

import csv
import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from foliospark import schemas
from foliospark.functions import text
from foliospark.operators.search import newest_first, parse_source_query, source_query
from foliospark.session import matching_names

# The fields of an entry.
ENTRY = StructType([StructField(n, StringType()) for n in ("arxiv_id", "entry_id", "title", "summary", "authors", "published", "updated", "primary_category", "pdf_url")])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _cell(value: object) -> str:
    return "" if value is None else str(value).strip().replace("\n", " ")


def to_record(entry: dict) -> tuple[str, ...]:
    """An entry as the eight columns of the metadata."""
    authors = entry.get("authors") or ""
    if isinstance(authors, list):
        authors = ", ".join(a["name"] if isinstance(a, dict) else str(a) for a in authors)
    short = _cell(entry.get("arxiv_id") or entry.get("entry_id"))
    short = short.split("abs/", 1)[1] if "abs/" in short else short
    return (short, _cell(entry.get("title")), _cell(entry.get("summary")), authors, _cell(entry.get("published"))[:10], _cell(entry.get("updated"))[:10], entry.get("primary_category") or "", entry.get("pdf_url") or "")


class PapersReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        query, category = parse_source_query(options.get("search", ""))
        self.words = (options.get("query", "") or query).lower().split()
        self.category = options.get("category", "") or category
        self.most = int(options.get("max_results", "20"))

    def partitions(self) -> list[InputPartition]:
        if not self.path:
            raise ValueError("the papers source reads files; give their place as path")
        root = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(root, "*")) if os.path.isdir(root) else glob.glob(root))
        return [_File(f) for f in files if f.endswith((".jsonl", ".json", ".csv"))]

    def _entries(self, path: str) -> Iterator[dict]:
        with open(path, newline="", encoding="utf-8") as f:
            if path.endswith(".csv"):
                yield from csv.DictReader(f)
            else:
                yield from (json.loads(line) for line in f if line.strip())

    def read(self, partition: _File) -> Iterator[tuple[str, ...]]:
        rows = []
        for entry in self._entries(partition.path):
            r = to_record(entry)
            if (not self.category or r[6] == self.category) and all(w in f"{r[1]} {r[2]}".lower() for w in self.words):
                rows.append(r)
        rows.sort(key=lambda r: r[0])
        rows.sort(key=lambda r: r[4], reverse=True)
        yield from rows[: self.most]


class PapersSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> StructType:
        return schemas.METADATA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PapersReader(self.options)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """The records of JSON-line and CSV files of a folder, file or pattern on any
    file system that Spark reads; a line that is no JSON is an error."""
    wanted = [f.name for f in ENTRY]
    lines = spark.read.option("pathGlobFilter", "*.{json,jsonl}").text(path).where(F.trim("value") != "")
    entries = lines.select(F.from_json("value", ENTRY, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    if any(n.endswith(".csv") for n in matching_names(spark, path)):
        raw = spark.read.option("pathGlobFilter", "*.csv").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        entries = entries.unionByName(raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in wanted]))
    listed = F.when(F.col("authors").rlike(r"^\s*\["), F.transform(F.from_json("authors", "array<string>"), lambda a: F.coalesce(F.get_json_object(a, "$.name"), a)))
    made = {c: text.ingest_text(F.col(c)) for c in ("title", "summary")}
    made["arxiv_id"] = text.short_id(text.ingest_text(text.first_filled(F.col("arxiv_id"), F.col("entry_id"))))
    made["authors"] = text.as_text(F.coalesce(F.array_join(listed, ", "), F.col("authors")))
    made |= {c: F.substring(text.ingest_text(F.col(c)), 1, 10) for c in ("published", "updated")}
    made |= {c: text.as_text(F.col(c)) for c in ("primary_category", "pdf_url")}
    return entries.select(*[F.when(made[c].isNotNull(), made[c]).alias(c) for c in schemas.METADATA.names])


def fetch_papers(spark: SparkSession, path: str, query: str = "", category: str | None = None, max_results: int = 20) -> DataFrame:
    """The newest ``max_results`` papers of the source that match its search string."""
    asked, wanted = parse_source_query(source_query(query, category))
    found = read_papers(spark, path)
    if wanted:
        found = found.where(F.col("primary_category") == wanted)
    said = F.lower(F.concat_ws(" ", "title", "summary"))
    for word in asked.lower().split():
        found = found.where(said.contains(word))
    return newest_first(found, "published", ["arxiv_id"], max_results)
