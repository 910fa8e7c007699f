"""Keyword search and browsing by topic."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators.corpus import pick

BROWSE_COLUMNS = ("title", "title_clean", "published", "pdf_url")


def keyword_search(df: DataFrame, query: str, columns: list[str], order: list[str], k: int = 10, regex: bool = False) -> DataFrame:
    """The first ``k`` rows by ``order`` that hold the query in any column, apart
    from case. A null cell holds nothing; an empty query matches every row; a
    blank one is looked for as it is. A bad pattern is refused before running."""
    if query:
        wanted = query.lower()
        if regex:
            try:
                re.compile(wanted)
            except re.error as e:
                raise ValueError(f"bad pattern {query!r}: {e}") from None
        hit = F.lit(False)
        for c in columns:
            cell = F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
            hit = hit | (cell.rlike(wanted) if regex else cell.contains(wanted))
        df = df.where(hit)
    return df.orderBy(*order).limit(k)


def newest_first(df: DataFrame, day: str, order: list[str], k: int = 20, category: str | None = None) -> DataFrame:
    """The newest ``k`` rows, of one category where one is given."""
    if category:
        df = df.where(F.col("primary_category") == category)
    return df.orderBy(F.desc_nulls_last(day), *order).limit(k)


def source_query(query: str, category: str | None = None) -> str:
    """The search string sent to the paper source."""
    return f"cat:{category} AND ({query})" if category else query


def parse_source_query(search: str) -> tuple[str, str]:
    """(query, category) of a search string; "" where no category is asked for."""
    found = re.fullmatch(r"cat:(\S+) AND \((.*)\)", search, re.DOTALL)
    return (found[2], found[1]) if found else (search, "")


def topic_rows(df: DataFrame, topic_id: int, order: list[str], k: int = 30) -> DataFrame:
    """The first ``k`` rows of a topic, in the columns made for browsing."""
    return pick(df.where(F.col("topic_id") == topic_id).orderBy(*order).limit(k), (*order, *[c for c in BROWSE_COLUMNS if c not in order]))


def topic_sizes(df: DataFrame, topics: int) -> DataFrame:
    """(topic_id, doc_count) of the topics 0..topics-1, empty ones too."""
    ids = df.sparkSession.range(topics).select(F.col("id").alias("topic_id"))
    counts = df.where(F.col("topic_id").isNotNull()).groupBy(F.col("topic_id").cast("bigint").alias("topic_id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.join(counts, "topic_id", "left").select("topic_id", F.coalesce("n", F.lit(0)).alias("doc_count"))


def same_text(a: str, b: str):
    """Whether two cells hold the same text apart from white space at the ends."""
    return text.strip(text.as_text(F.col(a))) == text.strip(text.as_text(F.col(b)))
