"""Binary files that belong to papers, copied where there is a file to copy."""

from __future__ import annotations

import os
import shutil
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fetch_files(papers: DataFrame, target: str, key: str = "arxiv_id", url: str = "pdf_url") -> DataFrame:
    """(key, path, status) of each paper: "ok", or why there is no file. A file
    that cannot be had never stops the others. Only file URLs are read here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(target, exist_ok=True)
        for pdf in batches:
            out = []
            for k, u in zip(pdf[key], pdf[url], strict=True):
                path = os.path.join(target, str(k).replace("/", "_") + ".pdf")
                try:
                    parts = urllib.parse.urlparse(u or "")
                    if parts.scheme not in ("", "file") or not parts.path:
                        raise ValueError(f"cannot read {u!r}")
                    shutil.copyfile(parts.path, path)
                    out.append((k, path, "ok"))
                except (OSError, ValueError) as e:
                    out.append((k, None, f"failed: {e}"))
            yield pd.DataFrame(out, columns=["key", "path", "status"])

    return papers.select(F.col(key).cast("string").alias(key), url).mapInPandas(run, "key string, path string, status string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
