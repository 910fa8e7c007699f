"""Tables between the stages: Parquet by default, CSV for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cells that common CSV readers take as missing.
NULL_CELLS = ("", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class NotBuiltError(FileNotFoundError):
    """A table that an earlier stage writes is not there."""


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; quoted cells may hold line breaks and doubled quotes.
    Cells that say "missing" are null; a cell that does not parse is null."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(texts).csv(path)
    return raw.select(*[F.when(~F.col(f.name).isin(*NULL_CELLS), F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_metadata(df: DataFrame, path: str) -> bool:
    """Write fetched metadata; with no rows nothing is written and what was
    there stays. Says whether it wrote."""
    if df.limit(1).isEmpty():
        return False
    write(df, path)
    return True


def _load(spark: SparkSession, path: str, what: str, made_by: str) -> DataFrame:
    if not exists(spark, path):
        raise NotBuiltError(f"no {what} at {path}; run {made_by} first")
    return spark.read.parquet(path)


class Store:
    """The tables of a corpus under one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def metadata(self) -> DataFrame:
        return _load(self.spark, self.path("metadata"), "metadata", "ingest")

    def clean(self) -> DataFrame:
        return _load(self.spark, self.path("corpus_clean"), "clean corpus", "clean")

    def best_corpus(self) -> DataFrame:
        """The corpus with summaries where it was built, else the clean corpus."""
        with_summaries = self.path("corpus_with_summaries")
        return self.spark.read.parquet(with_summaries) if exists(self.spark, with_summaries) else self.clean()

    def embeddings(self) -> DataFrame:
        return _load(self.spark, self.path("embeddings"), "embeddings", "embed")

    def topics(self) -> DataFrame:
        return _load(self.spark, self.path("topics"), "topics", "topics")

    def corpus_with_topics(self) -> DataFrame:
        return _load(self.spark, self.path("corpus_with_topics"), "corpus with topics", "topics")

