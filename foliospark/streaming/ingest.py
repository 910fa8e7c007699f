"""Metadata files as a stream: new files in, papers not seen before out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliospark import schemas
from foliospark.operators.corpus import clean_corpus


def new_papers(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of papers of a folder of JSON-line files; a paper that comes
    again, however late, is left out. The state holds every key seen."""
    stream = spark.readStream.schema(schemas.METADATA).json(folder)
    return stream.dropDuplicates(["arxiv_id"])


def ingest_available(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Clean what is new in the folder and add it to ``target``; then stop."""
    cleaned = clean_corpus(new_papers(spark, folder))
    return cleaned.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
