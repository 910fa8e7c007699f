"""Cleaning, choice of the text column, display columns, ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import text
from foliospark.session import materialise

CLEAN_COLUMNS = tuple(schemas.CORPUS_CLEAN.names)
#: What an index keeps of a row to show it, where the table has it.
INDEX_COLUMNS = ("title", "published", "updated", "pdf_url")


def pick(df: DataFrame, wanted: tuple[str, ...], fallback: tuple[str, ...] | None = None) -> DataFrame:
    """The wanted columns that exist; the fallback, or all, where none does."""
    found = [c for c in wanted if c in df.columns]
    return df.select(*(found or fallback or df.columns))


def clean_corpus(metadata: DataFrame, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw metadata to the clean corpus; ``keep`` names further columns to carry."""
    clean = metadata.withColumns(
        {
            "published": text.parse_day(F.col("published")),
            "updated": text.parse_day(F.col("updated")),
            "title_clean": text.clean_text(F.col("title"), strict),
            "abstract_clean": text.clean_text(F.col("summary"), strict),
        }
    )
    clean = clean.withColumn("text_unit", text.text_unit(F.col("title_clean"), F.col("abstract_clean")))
    return pick(clean, (*keep, *CLEAN_COLUMNS))


def text_column(df: DataFrame) -> str:
    """"summary" where that column exists and holds any value, else "text_unit"."""
    if "summary" in df.columns and not df.where(F.col("summary").isNotNull()).limit(1).isEmpty():
        return "summary"
    return "text_unit"


def nonempty(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text holds more than white space."""
    return df.where(~text.is_blank(F.col(column)))


def dense_index(df: DataFrame, keys: list[str], name: str = "row_idx") -> DataFrame:
    """Ordinals 0..n-1 in the order of ``keys`` (unique), without one big task.

    Rows are range-partitioned and sorted; a partition's rows are numbered from
    the number of rows in the partitions before it.
    """
    ranged = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # a row per partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, (own - 1 + F.col("_before")).cast("bigint")).drop("_part", "_before")


def embedding_index(df: DataFrame, keys: list[str], column: str, model: str) -> DataFrame:
    """Non-empty rows with their ordinal, what is shown of them and how they are
    embedded."""
    shown = [c for c in INDEX_COLUMNS if c in df.columns and c not in keys]
    rows = dense_index(nonempty(df, column).select(*keys, *shown), keys)
    return rows.withColumns({"embedded_text_col": F.lit(column), "embedding_model": F.lit(model)})


def display_view(df: DataFrame) -> DataFrame:
    """Adds show_title, show_abstract, show_summary and, if missing, text_unit.

    Which column serves is decided by which columns exist, not by their values.
    """
    has = set(df.columns)
    title = next((c for c in ("title", "title_clean") if c in has), None)
    abstract = next((c for c in ("abstract_clean", "summary") if c in has), None)
    out = df.withColumns(
        {
            "show_title": text.as_text(F.col(title)) if title else F.lit("Untitled"),
            "show_abstract": text.as_text(F.col(abstract)) if abstract else F.lit(""),
            "show_summary": text.as_text(F.col("summary")) if "summary" in has else F.lit(""),
        }
    )
    if "text_unit" not in has:
        out = out.withColumn("text_unit", text.text_unit(F.col("show_title"), F.col("show_abstract")))
    return out
