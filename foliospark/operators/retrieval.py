"""Exact vector search: one query, a block of queries, centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import vectors

#: Queries compared at once with a batch of rows; more come in further blocks.
QUERY_BLOCK = 2_000


def top_k(index: DataFrame, key: str, vector: str, query: list[float], k: int = 5, decimals: int = 6) -> DataFrame:
    """(key, similarity) of the ``k`` rows most similar to the query. The query
    is a literal; the plan keeps k rows per partition and merges those."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = index.select(key, F.round(vectors.dot(F.col(vector), wanted), decimals).alias("similarity")).where("similarity is not null")
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def vector_of(index: DataFrame, key: str, vector: str, value: int | str) -> list[float]:
    row = index.where(F.col(key) == value).select(vector).first()
    if row is None or row[0] is None:
        raise LookupError(f"no vector with {key} = {value}")
    return [float(x) for x in row[0]]


def top_k_batch(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, decimals: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, similarity, rank) for each query against all rows.

    Queries come to the driver in blocks of fixed size. A block is sent to the
    rows once; each batch of rows is one matrix product, and a task keeps the k best
    it has seen per query, so k rows per query and task are shuffled.
    """
    out: DataFrame | None = None
    pending: list[tuple[int, list[float]]] = []

    def ask(rows: list[tuple[int, list[float]]]) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        by_length = {n: np.flatnonzero([len(r[1]) == n for r in rows]) for n in {len(r[1]) for r in rows}}
        matrices = {n: np.array([rows[i][1] for i in at], np.float64) for n, at in by_length.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {n: (np.zeros((len(at), 0), np.int64), np.zeros((len(at), 0))) for n, at in by_length.items()}
            for b in batches:
                lengths = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                for n, at in by_length.items():
                    here = np.flatnonzero(lengths == n)
                    if not len(here):
                        continue
                    part = b.take(pa.array(here))
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(here), n).astype(np.float64)
                    sims = np.concatenate([best[n][1], np.round(matrices[n] @ x.T, decimals)], axis=1)
                    who = np.concatenate([best[n][0], np.broadcast_to(keys, (len(at), len(keys)))], axis=1)
                    order = np.lexsort((who, -sims), axis=1)[:, :k]
                    best[n] = np.take_along_axis(who, order, 1), np.take_along_axis(sims, order, 1)
            for n, at in by_length.items():
                who, sims = best[n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], who.shape[1])), pa.array(who.ravel()), pa.array(sims.ravel())], names=["query_id", key, "similarity"])

        return index.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), vector).mapInArrow(run, f"query_id bigint, {key} bigint, similarity double")

    for row in queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator():
        pending.append((row[0], [float(x) for x in row[1]]))
        if len(pending) == block:
            part = ask(pending)
            out, pending = part if out is None else out.unionByName(part), []
    if pending or out is None:
        part = ask(pending)
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return out.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def centroids(df: DataFrame, group: str, vector: str, decimals: int = 6) -> DataFrame:
    """(group, pos, weight): the mean vector of each group, a row per component."""
    long = df.where(F.col(group).isNotNull()).select(group, F.posexplode(vector).alias("p", "v"))
    return long.groupBy(group, (F.col("p") + 1).cast("bigint").alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), decimals).alias("weight"))


def assign_nearest(df: DataFrame, key: str, vector: str, means: DataFrame, group: str, most_groups: int = 10_000) -> DataFrame:
    """(key, topic_id): the group whose mean vector is nearest; of equally near
    ones the smaller; null for a row without a vector of the means' length.

    Means are sent to the rows as a matrix of at most ``most_groups``; where there
    are more, further passes follow and a row's best of all passes is taken.
    """
    packed = means.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "weight"))), lambda x: x["weight"]).alias("mean"))
    kinds = dict(df.select(key).dtypes) | dict(means.select(group).dtypes)
    rows = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    out, passes = None, 0

    def place(block: list[tuple[int, list[float]]]) -> DataFrame:
        of = {n: [r for r in block if len(r[1]) == n] for n in {len(r[1]) for r in block}}
        sets = {n: (np.array([r[0] for r in some]), np.array([r[1] for r in some])) for n, some in of.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lengths = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                near, far = np.zeros(b.num_rows, np.int64), np.full(b.num_rows, np.inf)
                for n, (groups, m) in sets.items():
                    here = np.flatnonzero(lengths == n)
                    x = b.column(1).take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).reshape(len(here), n)
                    for i in range(0, len(here), 1000):
                        d = np.round((x[i : i + 1000] ** 2).sum(axis=1)[:, None] + (m**2).sum(axis=1) - 2 * x[i : i + 1000] @ m.T, 6)
                        at = d.argmin(axis=1)  # groups come in order
                        near[here[i : i + 1000]], far[here[i : i + 1000]] = groups[at], d[np.arange(len(d)), at]
                none = pa.array(np.isinf(far))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(far), pc.if_else(none, None, pa.array(near))], names=["_key", "d", "g"])

        return rows.mapInArrow(run, f"_key {kinds[key]}, d double, g bigint")

    pending: list[tuple[int, list[float]]] = []
    for row in packed.orderBy(group).toLocalIterator():
        pending.append((row[0], row[1]))
        if len(pending) == most_groups:
            part, passes, pending = place(pending), passes + 1, []
            out = part if out is None else out.unionByName(part)
    if pending or out is None:
        part, passes = place(pending), passes + 1
        out = part if out is None else out.unionByName(part)
    if passes > 1:
        out = out.groupBy("_key").agg(F.min(F.struct("d", "g")).alias("x")).select("_key", "x.g")
    return out.select(F.col("_key").alias(key), F.col("g").cast(kinds[group]).alias("topic_id"))
