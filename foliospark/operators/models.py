"""Summariser, embedder and reader behind small protocols.

The defaults are deterministic, run offline and are expressions or relations;
they stand in for neural models and do not equal them. A model of one's own is
any object with the protocol's method; it is loaded once per worker and called
with a batch.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text

MAX_LENGTH, MIN_LENGTH, DIMENSIONS, EMBED_BATCH = 128, 32, 64, 64


class Summarizer(Protocol):
    def summarize(self, texts: list[str], max_length: int, min_length: int) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reader(Protocol):
    def answer(self, question: str, context: str) -> tuple[str, float]: ...


@functools.cache
def _loaded(factory: Callable[[], object]) -> object:
    return factory()


def lead_summary(c: Column, max_length: int = MAX_LENGTH, min_length: int = MIN_LENGTH) -> Column:
    """The first words of a text: whole sentences between the two lengths where
    there are any, else as many words as are allowed. Blank texts give ""."""
    words = F.split(text.clean_text(c), " ")
    lead = F.array_join(F.slice(words, 1, max_length), " ")
    whole = F.regexp_extract(lead, rf"^((?:[^ ]+ ){{{max(0, min_length - 1)},}}[^ ]*[.!?])(?: |$)", 1)
    return F.when(whole != "", whole).otherwise(lead)


def summarize(df: DataFrame, column: str, out: str = "model_summary", max_length: int = MAX_LENGTH, min_length: int = MIN_LENGTH, factory: Callable[[], Summarizer] | None = None) -> DataFrame:
    """Adds a summary per row; blank texts give "" without asking the model."""
    if not 0 < min_length <= max_length:
        raise ValueError(f"need 0 < min_length <= max_length, not {min_length} and {max_length}")
    if factory is None:
        return df.withColumn(out, lead_summary(F.col(column), max_length, min_length))

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(factory)
        for batch in texts:
            batch = batch.fillna("")
            filled = batch.str.strip() != ""
            made = pd.Series("", index=batch.index, dtype=object)
            if filled.any():
                made[filled] = model.summarize(batch[filled].tolist(), max_length, min_length)
            yield made

    return df.withColumn(out, run(F.col(column)))


def token_slot(term: Column, dimensions: int = DIMENSIONS) -> tuple[Column, Column]:
    """A word's place in the vector and its sign, from its MD5."""
    digest = F.md5(term.cast("binary"))
    slot = F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % dimensions
    sign = F.when(F.conv(F.substring(digest, 8, 1), 16, 10).cast("int") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return slot, sign


def hashed_embedding(docs: DataFrame, key: str, column: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, pos, value): signed counts of words hashed to places, length 1."""
    words = docs.select(key, F.explode(text.tokens(F.col(column))).alias("w"))
    slot, sign = token_slot(F.col("w"), dimensions)
    sums = words.select(key, slot.alias("pos"), sign.alias("s")).groupBy(key, "pos").agg(F.sum("s").cast("double").alias("v")).where("v != 0")
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return sums.select(key, "pos", F.round(F.col("v") / length, 6).alias("value"))


def embed(df: DataFrame, column: str, out: str = "embedding", factory: Callable[[], Embedder] | None = None, dimensions: int = DIMENSIONS, batch: int = EMBED_BATCH) -> DataFrame:
    """Adds a unit vector per row; blank texts give an empty array."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(factory or functools.partial(HashingEmbedder, dimensions))
        for series in texts:
            series = series.fillna("")
            filled = series.index[series.str.strip() != ""]
            made = pd.Series([[] for _ in series], index=series.index, dtype=object)
            for i in range(0, len(filled), batch):
                at = filled[i : i + batch]
                for j, v in zip(at, model.embed(series[at].tolist()), strict=True):
                    size = sum(x * x for x in v) ** 0.5
                    made.at[j] = [x / size for x in v] if size else list(v)
            yield made

    return df.withColumn(out, run(F.col(column)))


class HashingEmbedder:
    """The words' signed counts, as ``hashed_embedding`` makes them."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        import regex

        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in regex.findall(text.TOKEN, t.lower()):
                digest = hashlib.md5(w.encode()).hexdigest()
                v[int(digest[:7], 16) % self.dimensions] += 1 if int(digest[7], 16) % 2 == 0 else -1
            out.append(v)
        return out


def sentence_answer(context: Column, question: str, most: int = 400) -> Column:
    """struct<answer, score>: the context's sentence that shares most words with
    the question, without its final stop, and the share of the question's words
    it has. Of equal ones the first; "" and 0 where none shares any."""
    sentences = F.filter(F.split(context, r"[\n]+|(?:[.!?] +)"), lambda s: s != "")
    wanted = F.array_distinct(text.tokens(F.lit(question), text.STOP_WORDS))
    size = F.greatest(F.size(wanted), F.lit(1))
    scored = F.transform(
        sentences, lambda s, i: F.struct((-F.size(F.array_intersect(wanted, text.tokens(s)))).alias("n"), i.alias("i"), F.substring(s, 1, most).alias("s"))
    )
    best = F.array_min(scored)
    found = F.coalesce(best["n"] < 0, F.lit(False))
    return F.struct(F.when(found, F.regexp_replace(best["s"], "[.!?]+$", "")).otherwise("").alias("answer"), F.when(found, F.round(-best["n"] / size, 6)).otherwise(0.0).cast("double").alias("score"))


def read(df: DataFrame, context: str, question: str, factory: Callable[[], Reader]) -> DataFrame:
    """Adds ``read``: struct<answer, score> by a reader of one's own."""

    @F.pandas_udf("answer string, score double")
    def run(contexts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _loaded(factory)
        for batch in contexts:
            yield pd.DataFrame([model.answer(question, c) if c else ("", 0.0) for c in batch.fillna("")], columns=["answer", "score"])

    return df.withColumn("read", run(F.col(context)))
