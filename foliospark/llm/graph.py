"""Candidate pairs from buckets, and connected components, both without
gathering a group anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import drop_table, materialise, new_table_path


#: Counters that a first count of keys is kept in; bounds what it shuffles.
COUNTERS = 1 << 18
#: Hot keys are broadcast up to this many; beyond it a salted shuffle joins them.
MAX_BROADCAST_KEYS, SALTS = 200_000, 16


def hot_keys(rows: DataFrame, key: str, block: int) -> DataFrame | None:
    """(key, _n): keys of more than ``block`` rows, or None where there is none.

    No key's rows are brought together: counts are aggregated before they are
    shuffled. Counters shared by many keys are counted first; only the rows of
    counters beyond ``block`` are counted by key. ``rows`` is read for each count,
    so it should be a table or little more.
    """
    counter = F.pmod(F.xxhash64(key), F.lit(COUNTERS)).cast("int")
    full = rows.groupBy(counter.alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    full = materialise(full.select("_c"), "counters")
    if full.isEmpty():
        return None
    some = rows.select(key).withColumn("_c", counter).join(F.broadcast(full), "_c", "left_semi")  # at most COUNTERS numbers
    hot = materialise(some.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block), "hot-keys")
    return None if hot.isEmpty() else hot


def meet_hot(rows: DataFrame, hot: DataFrame, key: str, node: str, how: str) -> DataFrame:
    """``rows`` joined with a table of one row per key, without a hot key in one task."""
    if hot.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        return rows.join(F.broadcast(hot), key, how)
    salted = hot.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int")).join(salted, [key, "_s"], how).drop("_s")


def _blocked(rows: DataFrame, node: str, block: int) -> DataFrame:
    """Adds _g, the number of blocks of the row's key, and _b, the row's own."""
    rows = rows.withColumn("_g", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    return rows.withColumn("_b", F.pmod(F.xxhash64(node), F.col("_g")).cast("int"))


def bucket_pairs(rows: DataFrame, key: str, node: str, keep: list[str], block: int = 512) -> DataFrame:
    """Pairs of rows with equal ``key``: columns ``<c>_a``, ``<c>_b`` for the
    node and ``keep``, with node_a < node_b.

    A node that stands under a key repeatedly counts once. Keys of at most
    ``block`` rows are joined where they lie. A larger key is cut into blocks; each
    pair of blocks is a join key of its own, so that no task gets a whole hot key.
    No pair is left out.
    """
    cols = [node, *keep]
    rows = rows.select(key, *cols)
    hot = hot_keys(rows, key, block)

    def side(df: DataFrame, s: str, more: list[str]) -> DataFrame:
        return df.select(*[key, *more], *[F.col(c).alias(f"{c}_{s}") for c in cols])

    cold = rows if hot is None else meet_hot(rows, hot.select(key), key, node, "left_anti")
    cold = cold.where(F.col(key).isNotNull() & F.col(node).isNotNull()).repartition(key).dropDuplicates([key, node])
    pairs = side(cold, "a", []).join(side(cold, "b", []), key).where(f"{node}_a < {node}_b")
    if hot is None:
        return pairs.drop(key)
    met = _blocked(meet_hot(rows, hot, key, node, "inner").dropDuplicates([key, node]), node, block)
    met = met.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    met = met.withColumns({"_lo": F.least("_b", "_o"), "_hi": F.greatest("_b", "_o")})
    a, b = side(met, "a", ["_lo", "_hi", "_b"]), side(met, "b", ["_lo", "_hi", "_b"]).withColumnRenamed("_b", "_c")
    # a pair of blocks meets each of its pairs of rows once
    both = a.join(b, [key, "_lo", "_hi"]).where(f"{node}_a < {node}_b").where("(_lo = _hi) or (_b != _c)")
    return pairs.select(pairs.columns).unionByName(both.select(pairs.columns)).drop(key)


def block_join(left: DataFrame, right: DataFrame, key: str, left_node: str, right_node: str, block: int = 4096) -> DataFrame:
    """The rows of ``left`` and ``right`` with equal ``key``. Keys with more than
    ``block`` rows on the right are met in pairs of blocks, one task each."""
    hot = hot_keys(right.select(key), key, block)
    if hot is None:
        return left.join(right, key)
    cold = meet_hot(left, hot.select(key), key, left_node, "left_anti").join(meet_hot(right, hot.select(key), key, right_node, "left_anti"), key)
    a = _blocked(meet_hot(left, hot, key, left_node, "inner"), left_node, block).withColumnRenamed("_b", "_i")
    b = _blocked(meet_hot(right, hot, key, right_node, "inner"), right_node, block).withColumnRenamed("_b", "_j")
    every = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    a, b = a.withColumn("_j", every).drop("_g", "_n"), b.withColumn("_i", every).drop("_g", "_n")
    return cold.unionByName(a.join(b, [key, "_i", "_j"]).drop("_i", "_j"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's edges as stars: (node, smallest node linked with it)."""
    for b in batches:
        u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(u):
            continue
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        x, y = at[: len(u)], at[len(u) :]
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        far = label != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], names=["u", "v"])


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 40) -> DataFrame:
    """(node, root): every node of an edge with the smallest node it is linked to.

    Edges are first shrunk to stars inside each batch, then large-star and
    small-star rounds run until nothing changes. Each round is written to the
    shared folder.
    """
    e = edges.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where("u != v")
    e = materialise(e.mapInArrow(_forest, "u bigint, v bigint").distinct(), "edges")
    state, path = None, None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        linked = e.join(low, "u")
        e = linked.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        before, path = path, new_table_path(e.sparkSession, "edges")
        e = materialise(e, "edges", path)
        if before:
            drop_table(e.sparkSession, before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
