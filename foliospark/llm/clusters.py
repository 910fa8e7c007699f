"""Problem 3: similarity clusters of keyword lists.

Keywords are reduced (case, hyphens, plural s) and slips of a letter mapped to
the keyword they slipped from, found through shared deletions. Distinct lists are
linked where they share more than half of the keywords of the shorter list; all
links are found: of two linked lists the shorter has a common keyword among its
rarest ``n - n/2`` ones, and so has the longer among a prefix that depends on the
shorter's length. Keywords of very many lists are met in blocks.

The graph of links is clustered by Markov clustering: the column-stochastic
matrix is squared (outer products, summed in part and then whole), inflated, and entries that are small beside
the largest of their column are pruned, until the flow has settled. The rows that
flow gathers in are the attractors; they name the clusters, and those that
gather most are a cluster's most typical rows. A cluster in this project also
holds rows linked through others only, which Markov clustering may cut apart. So
clusters become the vertices of a smaller graph, with the links that run between
them as its edges, and that graph is clustered in the same way, until no link
runs between two clusters.

Defined results: rows with null, blank or empty keywords are left out; equal
lists are one vertex; repeated rows count once in ``found_rows``; a null or
negative doc_count adds nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.graph import block_join, bucket_pairs, hot_keys
from foliospark.llm.names import one_slip
from foliospark.operators import packed
from foliospark.session import drop_table, materialise, new_table_path

#: A keyword is a slip of another that is so many times as frequent.
SLIP_RATIO = 8
#: Keywords of more letters are looked for by their halves, not by deletions.
LONG_KEYWORD = 64
#: Entries below this part of their column's largest are pruned.
PRUNE, SETTLED, MOST_ROUNDS, MOST_LEVELS = 0.02, 1e-3, 60, 40
#: Powers of the inflation, round by round; the last one from then on. The first
#: rounds are mild, so that flow reaches a whole neighbourhood before it gathers.
INFLATIONS = (1.4, 2.0, 4.0, 8.0, 16.0)
#: Vertices that may share a label; entries and products held at once by a task.
MOST_LABELLED, ENTRIES, PRODUCTS = 20_000, 200_000, 4_000_000
TYPICAL = 3


def reduced(keyword: Column) -> Column:
    c = F.trim(F.regexp_replace(F.lower(keyword), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(c, r"(?<=[\p{L}\p{N}]{3})s(?= |$)", "")


def slip_keys(word: str) -> list[str]:
    """Keys of which two words that differ by one slip share at least one."""
    n = len(word)
    keys = {word}
    if n >= LONG_KEYWORD:  # one half is the same; lengths differ by one at most
        keys |= {key for h in (n // 2 - 1, n // 2 - 2) for key in (f"<{word[:h]}", f">{word[n - h :]}")}
    if 1 < n <= LONG_KEYWORD + 1:
        keys |= {word[:i] + word[i + 1 :] for i in range(n)}
    return list(keys)


def _deletions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(cut=[slip_keys(w) for w in pdf["kw"]])


def _slips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[[one_slip(a, b) for a, b in zip(pdf["kw_a"], pdf["kw_b"], strict=True)]]


def slip_map(counts: DataFrame) -> DataFrame:
    """(kw, of): keywords and the more frequent one they slipped from.

    ``counts``: (kw, n). A keyword seen once or twice is a slip of any neighbour
    twice as frequent, others need one ``SLIP_RATIO`` times as frequent; so do
    keywords of three letters or fewer, which have many neighbours.
    """
    cut = counts.mapInPandas(_deletions, "kw string, n bigint, cut array<string>")
    rows = materialise(cut.select("kw", "n", F.explode("cut").alias("cut")).select("kw", "n", F.xxhash64("cut").alias("key")), "slip-keys")
    pairs = bucket_pairs(rows, "key", "kw", ["n"])
    rare = lambda a, b: (a <= 2) & (b >= 2 * a) & (F.least(F.length("kw_a"), F.length("kw_b")) > 3)
    slip = lambda a, b: (b >= SLIP_RATIO * a) | rare(a, b)
    pairs = pairs.where(slip(F.col("n_a"), F.col("n_b")) | slip(F.col("n_b"), F.col("n_a"))).distinct()
    pairs = pairs.mapInPandas(_slips, pairs.schema)
    a_less = F.col("n_a") < F.col("n_b")
    ordered = pairs.select(F.when(a_less, F.col("kw_a")).otherwise(F.col("kw_b")).alias("kw"), F.when(a_less, F.col("kw_b")).otherwise(F.col("kw_a")).alias("of"), F.greatest("n_a", "n_b").alias("n"))
    best = materialise(ordered.groupBy("kw").agg(F.max_by("of", F.struct("n", "of")).alias("of")), "slips")
    again = best.select(F.col("kw").alias("of"), F.col("of").alias("further"))
    return best.join(again, "of", "left").select("kw", F.coalesce("further", "of").alias("of"))


def keyword_sets(topics: DataFrame) -> DataFrame:
    """(id, kws): the numbers of a row's distinct keywords, rarest first."""
    values = packed.split_packed(topics, "keywords", "topic_row", packed.KEYWORDS)
    values = materialise(values.select(F.col("row_key").cast("bigint").alias("id"), reduced(F.col("val")).alias("kw")).where("id is not null and kw != ''"), "keywords")
    counts = materialise(values.distinct().groupBy("kw").agg(F.count(F.lit(1)).alias("n")), "keyword-counts")
    slips = slip_map(counts)
    # the number of a keyword: its place in a table written once
    of = counts.join(slips, "kw", "left").select("kw", F.coalesce("of", "kw").alias("of"))
    numbers = materialise(of.select("of").distinct().select("of", F.monotonically_increasing_id().alias("no")), "keyword-numbers")
    of = materialise(of.join(numbers, "of").select("kw", "no"), "keyword-map")
    values = values.join(of, "kw").select("id", "no").distinct()
    rarity = values.groupBy("no").agg(F.count(F.lit(1)).alias("df"))
    lists = values.join(rarity, "no").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "no"))).alias("x"))
    return lists.select("id", F.transform("x", lambda e: e["no"]).alias("kws"))


def _half(n: str | Column) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.floor(n / 2)


def links(lists: DataFrame, block: int = 4096) -> DataFrame:
    """(a, b, w): all links among distinct lists (id, kws), a < b, with the share
    of common keywords. A pair is met under each keyword of both prefixes and
    taken under its rarest common one."""
    n = F.size("kws")
    short = lists.select("id", "kws", F.posexplode(F.slice("kws", 1, n - _half(n).cast("int"))).alias("p", "kw"))
    short = short.select("kw", F.col("id").alias("a"), F.col("kws").alias("ka"))
    # the shorter list's length is not known here: its prefix ends where the pair is met
    whole = lists.select(F.posexplode("kws").alias("pb", "kw"), F.col("id").alias("b"), F.col("kws").alias("kb"))
    near = block_join(short, whole, "kw", "a", "b", block)
    na, nb = F.size("ka"), F.size("kb")
    near = near.where((na < nb) | ((na == nb) & (F.col("a") < F.col("b")))).where(F.col("pb") < nb - _half(na))
    near = near.withColumn("both", F.array_intersect("ka", "kb")).where(F.col("both")[0] == F.col("kw"))
    near = near.select("a", "b", (F.size("both") / na).alias("w")).where("w > 0.5")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")


def _labels(both: DataFrame) -> DataFrame:
    """(v, label): a number that most vertices of a neighbourhood share. It decides
    where entries meet, never what comes out; a label of very many vertices is
    given up for the vertices themselves."""
    first = both.groupBy(F.col("j").alias("v")).agg(F.least(F.min("i"), F.first("j")).alias("label"))
    second = both.join(first.withColumnRenamed("v", "i"), "i").groupBy(F.col("j").alias("v")).agg(F.min("label").alias("label"))
    second = materialise(second, "labels")
    hot = hot_keys(second, "label", MOST_LABELLED)
    if hot is None:
        return second
    return second.join(hot.select("label", F.lit(True).alias("hot")), "label", "left").select("v", F.when(F.col("hot"), F.col("v")).otherwise(F.col("label")).alias("label"))


def _multiply(k: np.ndarray, left: np.ndarray, x: np.ndarray, label: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over the inner index of products of entries sorted by it: ``left`` ones
    are (x, k), the others (k, x)."""
    at_l, at_r = np.flatnonzero(left), np.flatnonzero(~left)
    rows, row_of = np.unique(x[at_l], return_inverse=True)
    columns, column_of = np.unique(x[at_r], return_inverse=True)
    row_label, column_label = np.empty(len(rows), np.int64), np.empty(len(columns), np.int64)
    row_label[row_of], column_label[column_of] = label[at_l], label[at_r]
    low, high = np.searchsorted(k[at_r], k[at_l], "left"), np.searchsorted(k[at_r], k[at_l], "right")
    n = high - low
    ends = np.cumsum(n)
    begin = 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PRODUCTS, "right")))
        m = n[begin:end]
        mine = np.repeat(np.arange(begin, end), m)
        theirs = np.repeat(low[begin:end] - np.cumsum(m) + m, m) + np.arange(m.sum())
        cell, of = np.unique(row_of[mine] * np.int64(len(columns)) + column_of[theirs], return_inverse=True)
        total = np.bincount(of, w[at_l][mine] * w[at_r][theirs], len(cell))
        i, j = np.divmod(cell, max(1, len(columns)))
        yield pa.RecordBatch.from_arrays([pa.array(rows[i]), pa.array(row_label[i]), pa.array(columns[j]), pa.array(column_label[j]), pa.array(total)], names=["i", "li", "j", "lj", "w"])
        begin = end


def _dense(k: np.ndarray, left: np.ndarray, x: np.ndarray, label: np.ndarray, w: np.ndarray) -> list[np.ndarray] | None:
    """The same for the entries of one label as one product of two full matrices,
    if these are small."""
    rows, row_of = np.unique(x[left], return_inverse=True)
    columns, column_of = np.unique(x[~left], return_inverse=True)
    inner, at = np.unique(k, return_inverse=True)
    if max(len(rows) * len(columns), len(inner) * max(len(rows), len(columns))) > PRODUCTS:
        return None
    a, b = np.zeros((len(rows), len(inner))), np.zeros((len(inner), len(columns)))
    a[row_of, at[left]], b[at[~left], column_of] = w[left], w[~left]
    row_label, column_label = np.empty(len(rows), np.int64), np.empty(len(columns), np.int64)
    row_label[row_of], column_label[column_of] = label[left], label[~left]
    c = a @ b
    i, j = np.nonzero(c)
    return [rows[i], row_label[i], columns[j], column_label[j], c[i, j]]


def _squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of the square; rows (label of k, k, left, x, label of x, w) are
    sorted by the first two. Whole runs of a label are multiplied, many at a time;
    a run beyond ``ENTRIES`` is cut between two k."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if sum(len(h[0]) for h in held) < ENTRIES:
            continue
        parts = [np.concatenate(c) for c in zip(*held, strict=True)]
        for run in (0, 1):  # the last run may go on in the next batch
            cut = int(np.flatnonzero(np.concatenate([[True], parts[run][1:] != parts[run][:-1]]))[-1])
            if cut:
                break
        held = [[c[cut:] for c in parts]]
        yield from _by_label([c[:cut] for c in parts])
    if held:
        yield from _by_label([np.concatenate(c) for c in zip(*held, strict=True)])


def _by_label(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    found = []
    starts = np.flatnonzero(np.concatenate([[True], parts[0][1:] != parts[0][:-1]])) if len(parts[0]) else []
    for begin, end in zip(starts, [*starts[1:], len(parts[0])], strict=True):
        some = [c[begin:end] for c in parts[1:]]
        dense = _dense(*some)
        if dense is None:
            yield from _multiply(*some)
        else:
            found.append(dense)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["i", "li", "j", "lj", "w"])


def settled_flow(edges: DataFrame, inflations: tuple[float, ...] = INFLATIONS, prune: float = PRUNE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(i, j, w): the matrix of flow of Markov clustering when it has settled:
    the part of vertex j's flow that gathers in i.

    ``edges``: (a, b, w), undirected, each once. The matrix is squared, as outer
    products of its columns and rows that are summed where they arise before they
    are shuffled, and inflated by the round's power (the last one from then on).
    Settled is where no column has entries of different size; RuntimeError after
    ``most_rounds``.
    """
    spark = edges.sparkSession

    def inflated(m: DataFrame, power: float) -> DataFrame:
        column = Window.partitionBy("j")
        m = m.withColumn("w", F.pow("w", F.lit(power)))
        m = m.withColumn("w", F.round(F.col("w") / F.max("w").over(column), 9)).where(F.col("w") >= prune)
        m = m.withColumns({"w": F.col("w") / F.sum("w").over(column), "uneven": 1 - F.min("w").over(column)})
        return m.select("i", "li", "j", "lj", "w", "uneven")

    # an edge both ways, and a loop as heavy as a vertex's heaviest edge
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), "w"), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), "w"))).alias("e")).select("e.*")
    labels = materialise(_labels(both), "labels")
    whole = both.unionByName(both.groupBy("j").agg(F.max("w").alias("w")).select(F.col("j").alias("i"), "j", "w"))
    whole = whole.join(labels.select(F.col("v").alias("i"), F.col("label").alias("li")), "i").join(labels.select(F.col("v").alias("j"), F.col("label").alias("lj")), "j")
    path = new_table_path(spark, "flow")
    m = materialise(inflated(whole, 1.0), "flow", path)
    for r in range(most_rounds):
        as_left = F.struct(F.col("lj").alias("lk"), F.col("j").alias("k"), F.lit(True).alias("left"), F.col("i").alias("x"), F.col("li").alias("label"), "w")
        as_right = F.struct(F.col("li").alias("lk"), F.col("i").alias("k"), F.lit(False).alias("left"), F.col("j").alias("x"), F.col("lj").alias("label"), "w")
        entries = m.select(F.explode(F.array(as_left, as_right)).alias("e")).select("e.*")
        entries = entries.repartition("lk").sortWithinPartitions("lk", "k")
        partial = entries.mapInArrow(_squared, "i bigint, li bigint, j bigint, lj bigint, w double")
        squared = partial.repartition("j").groupBy("i", "li", "j", "lj").agg(F.sum("w").alias("w"))
        before, path = path, new_table_path(spark, "flow")
        m = materialise(inflated(squared, inflations[min(r, len(inflations) - 1)]), "flow", path)
        drop_table(spark, before)
        if m.where(F.col("uneven") > SETTLED).limit(1).isEmpty():
            return m.select("i", "j", "w")
    raise RuntimeError(f"the flow did not settle in {most_rounds} rounds")


def attractors(flow: DataFrame) -> DataFrame:
    """(node, attractor): the row that gathers most of a vertex's flow; of equal
    ones the smallest."""
    return flow.groupBy(F.col("j").alias("node")).agg(F.min(F.struct((-F.round("w", 6)).alias("w"), "i")).alias("x")).select("node", F.col("x.i").alias("attractor"))


def markov_clusters(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, cluster) of every vertex with an edge, the settled flow of the
    graph itself).

    A cluster's number is one of its attractors. Clusters with a link between
    them are clustered again, as vertices of a graph of their own.
    """
    flow = settled_flow(edges)
    placed = step = materialise(attractors(flow).withColumnRenamed("attractor", "cluster"), "clusters")
    inflations = INFLATIONS
    for _ in range(MOST_LEVELS):
        of = lambda c: step.select(F.col("node").alias(c), F.col("cluster").alias(f"{c}c"))  # noqa: E731, B023
        crossing = edges.join(of("a"), "a").join(of("b"), "b").where("ac != bc")
        edges = crossing.groupBy(F.least("ac", "bc").alias("a"), F.greatest("ac", "bc").alias("b")).agg(F.sum("w").alias("w"))
        edges = materialise(edges, "links-between")
        if edges.isEmpty():
            return placed, flow
        step = materialise(attractors(settled_flow(edges, inflations)).withColumnRenamed("attractor", "cluster"), "clusters")
        if step.where("node != cluster").isEmpty():
            inflations = tuple(1 + (x - 1) / 2 for x in inflations)  # milder ones give larger clusters
        moved = placed.join(step.select(F.col("node").alias("cluster"), F.col("cluster").alias("next")), "cluster", "left")
        placed = materialise(moved.select("node", F.coalesce("next", "cluster").alias("cluster")), "clusters")
    raise RuntimeError(f"links between clusters after {MOST_LEVELS} levels")


def _clustered(topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((first_row, topic_row, vertex), settled flow): every row with keywords
    with its cluster's smallest row and the smallest row with the same list."""
    rows = materialise(keyword_sets(topics).withColumn("same", F.array_sort("kws")), "keyword-sets")
    lists = materialise(rows.groupBy("same").agg(F.min(F.struct("id", "kws")).alias("x")).select("same", "x.id", "x.kws"), "lists")
    edges = materialise(links(lists.select("id", "kws")), "links")
    placed, flow = markov_clusters(edges)
    firsts = placed.groupBy("cluster").agg(F.min("node").alias("first"))
    placed = placed.join(firsts, "cluster").select(F.col("node").alias("id"), "first")
    vertices = lists.select("id", "same").join(placed, "id", "left").select("same", F.col("id").alias("vertex"), F.coalesce("first", "id").alias("first_row"))
    return rows.select(F.col("id").alias("topic_row"), "same").join(vertices, "same").select("first_row", "topic_row", "vertex"), flow


def found_rows(topics: DataFrame) -> DataFrame:
    """(first_row, topic_row): every row of a cluster but its smallest."""
    return _clustered(topics)[0].where("first_row != topic_row").select("first_row", "topic_row")


def describe_clusters(topics: DataFrame, typical: int = TYPICAL) -> DataFrame:
    """(first_row, n_rows, doc_count, typical_rows): clusters by size; of the rows
    that flow gathers in, those that gather most first."""
    rows, flow = _clustered(topics)
    rows = materialise(rows, "cluster-rows")
    counts = topics.select(F.col("topic_row").cast("bigint").alias("topic_row"), F.greatest(F.coalesce("doc_count", F.lit(0)), F.lit(0)).cast("bigint").alias("n")).groupBy("topic_row").agg(F.max("n").alias("n"))
    sizes = rows.join(counts, "topic_row").groupBy("first_row").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("doc_count"))
    vertices = rows.groupBy("vertex", "first_row").agg(F.count(F.lit(1)).alias("copies"))
    gathered = flow.join(vertices, F.col("j") == F.col("vertex")).groupBy("i").agg(F.sum(F.col("w") * F.col("copies")).alias("flow"))
    # a vertex without links gathers its own rows' flow
    drawn = vertices.join(gathered, F.col("i") == F.col("vertex"), "left").where("flow is not null or vertex = first_row")
    best = Window.partitionBy("first_row").orderBy(F.desc(F.round(F.coalesce("flow", F.lit(0.0)), 6)), "vertex")
    top = drawn.withColumn("r", F.row_number().over(best)).where(F.col("r") <= typical).where("flow is not null or r = 1")
    top = top.groupBy("first_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "vertex"))), lambda x: x["vertex"]).alias("typical_rows"))
    return sizes.join(top, "first_row")
