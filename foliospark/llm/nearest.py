"""Problem 4: the k most similar vectors for every vector.

p-stable (Gaussian) hashing in ``tables`` tables. A table's first hashes, as
many as the number of vectors calls for, name the *cell* a vector is kept in.
The more such hashes, the likelier a near vector is kept in another cell, so a
query is also sent to the likeliest neighbouring cells, over all tables, until a
vector at distance ``NEAR`` has at most a chance of ``MISS`` to lie in none of
its cells, however many hashes there are; the copies sent grow with the hashes.
One table is searched after the other, so only one table's copies lie on disk.
Inside a cell the table's further hashes make
buckets; a query visits its own bucket and the buckets reached by moving one or
two hash values to a neighbour, in the order of how likely they hold a near
vector (the squared distance to the slots' borders). All candidates are compared in
single precision; those that a bound on the k-th best leaves over are reranked by
exact cosine in double precision; the tables' answers are merged per query.

A cell that keeps or is visited by more than ``cell_rows`` rows is cut into blocks
of kept rows and blocks of queries; each pair of blocks is a group of its own, so
nothing is left out and no task holds a whole hot cell. A vector that stands in more than ``HEAVY`` rows is indexed by its k + 1
smallest rows; that is enough for any query, and its other rows are answered
directly.

Defined results: rows are left out whose model is null or blank, or whose vector
is null, empty, all zero, has a null, NaN or infinite element, or is not of its
model's usual length (the most frequent; of equally frequent ones the shorter).
At equal similarity (9 decimals) the smaller key wins. Repeated rows count once.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.graph import meet_hot
from foliospark.session import materialise

K = 5
TABLES = 4
CELL_TARGET = 24_000
CELL_ROWS = 40_000
#: Rows that a task of the search is given on average.
TASK_ROWS = 8_000
HEAVY = 64
COARSE_W, FINE_W = 2.5, 2.0
#: ln(1 / chance that two unlike unit vectors share a hash) at these widths
COARSE_LOG, FINE_LOG = 0.47, 0.6
#: A vector this far off (of unit vectors) is in none of a query's cells with at most this chance.
NEAR, MISS = 0.5, 0.02
BUCKET_TARGET = 128
PROBES = 24
#: Rows of a piece, similarities held at a time (of one query at least), pieces that a query's bound is read from.
PIECE, MOST_PAIRS, MOST_BOUNDS = 128, 1 << 22, 64
SEED = 20_240_101
TABLE_BITS = 63
#: The table of models is broadcast up to this many; beyond it a shuffle joins it.
MAX_BROADCAST_MODELS = 10_000


def model_name(c: Column) -> Column:
    """A model's name however it is typed: no path, case, or kind of dash."""
    c = F.regexp_replace(F.lower(c), r"(?U)^\s+|(?<!\s)\s+$", "")
    c = F.regexp_replace(F.regexp_extract(c, r"([^/]*)/*$", 1), r"[^\p{L}\p{N}]+", "-")
    return F.regexp_replace(c, "^-|-$", "")


def usable_vectors(df: DataFrame, key: str, model: str, vector: str) -> DataFrame:
    """(id, model, vec, n): rows that take part; n counts the model's vectors of
    the usual length."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), model_name(F.col(model)).alias("model"), F.col(vector).cast("array<float>").alias("vec"))
    rows = rows.where("id is not null and model != '' and size(vec) > 0")
    sizes = rows.groupBy("model", F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.groupBy("model").agg(F.max_by(F.struct("dim", "n"), F.struct("n", -F.col("dim"))).alias("u")).select("model", F.col("u.dim").alias("dim"), F.col("u.n").alias("n"))
    usual = materialise(usual, "models")
    if usual.limit(MAX_BROADCAST_MODELS + 1).count() <= MAX_BROADCAST_MODELS:
        usual = F.broadcast(usual)
    rows = rows.join(usual, "model").where(F.size("vec") == F.col("dim"))
    sound = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) & F.exists("vec", lambda x: x != 0)
    return rows.where(sound).select("id", "model", "vec", "n")


def _random(dim: int, table: int, level: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, table, level])
    a = rng.standard_normal((64, dim))[:hashes] / width
    b = rng.random(64)[:hashes]
    r = rng.integers(1 << 62, size=64, dtype=np.int64)[:hashes] * 2 + 1
    return a.astype(np.float32), b.astype(np.float32), r


def _equal_vectors(x: np.ndarray) -> np.ndarray:
    """A number per row that equal vectors share."""
    r = np.random.default_rng(SEED).integers(1 << 62, size=x.shape[1], dtype=np.int64) * 2 + 1
    with np.errstate(over="ignore"):
        return ((x + np.float32(0)).view(np.int32).astype(np.int64) * r).sum(axis=1)


def coarse_hashes(n: int, cell_target: int = CELL_TARGET) -> int:
    """Hashes that leave about ``cell_target`` of ``n`` vectors in a cell."""
    return min(64, math.ceil(math.log(n / cell_target) / COARSE_LOG)) if n > cell_target else 0


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True).astype(np.float64)
    y = x / big  # squares neither vanish nor overflow
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def _below(x: np.ndarray) -> np.ndarray:
    """The normal distribution (to 0.0003)."""
    return 0.5 * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


def _neighbour_cells(frac: np.ndarray, r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places in the slots: the chance that a vector ``NEAR`` away is in the
    same cell; the ``most`` likeliest other cells, their chances and what they
    add to the cell's number."""
    sigma = NEAR / COARSE_W
    down, up = _below(-frac / sigma), _below((frac - 1) / sigma)
    stay = 1 - down - up
    chance, move = np.ones((len(frac), 1)), np.zeros((len(frac), 1), np.int64)
    for i in range(frac.shape[1]):
        each = np.stack([stay[:, i], down[:, i], up[:, i]], axis=1)
        chance = (chance[:, :, None] * each[:, None, :]).reshape(len(frac), -1)
        with np.errstate(over="ignore"):
            move = (move[:, :, None] + np.array([0, -r[i], r[i]])).reshape(len(frac), -1)
        if chance.shape[1] > most + 1:
            top = np.argpartition(-chance, most, axis=1)[:, : most + 1]
            chance, move = np.take_along_axis(chance, top, 1), np.take_along_axis(move, top, 1)
    chance = np.where(move == 0, 0, chance)
    order = np.argsort(-chance, axis=1)
    return stay.prod(axis=1), np.take_along_axis(chance, order, 1), np.take_along_axis(move, order, 1)


def cells_to_visit(fracs: list[np.ndarray], rs: list[np.ndarray], most: int = 15) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table (rows, moves): the cells beside its own that a row visits.

    The cell that lowers the chance to miss most is taken next, of whichever
    table; rows that need more cells than were listed are done again with more.
    """
    n, h = fracs[0].shape
    if not h:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in fracs]
    listed = [_neighbour_cells(f, r, most) for f, r in zip(fracs, rs, strict=True)]
    left = np.stack([1 - x[0] for x in listed], axis=1)  # chance to miss in each table
    chance = np.stack([np.pad(x[1], ((0, 0), (0, 1))) for x in listed], axis=1)
    taken = np.zeros(left.shape, np.int64)
    rows = np.arange(n)
    while len(rows := rows[left[rows].prod(axis=1) > MISS]):
        gain = np.take_along_axis(chance[rows], taken[rows][:, :, None], 2)[:, :, 0] / np.maximum(left[rows], 1e-12)
        t = gain.argmax(axis=1)
        best = gain[np.arange(len(rows)), t]
        rows, t = rows[best > 0], t[best > 0]
        left[rows, t] -= chance[rows, t, taken[rows, t]]
        taken[rows, t] += 1
    again = np.flatnonzero(left.prod(axis=1) > MISS) if most + 1 < 3**h else rows
    taken[again] = 0
    found = []
    more = cells_to_visit([f[again] for f in fracs], rs, 4 * most) if len(again) else None
    for t, (_, _, move) in enumerate(listed):
        r, c = np.nonzero(np.arange(move.shape[1]) < taken[:, t, None])
        r, m = (r, move[r, c]) if more is None else (np.concatenate([r, again[more[t][0]]]), np.concatenate([move[r, c], more[t][1]]))
        found.append((r, m))
    return found


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of single precision as bytes: Spark then moves them whole, not number by number."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(vec: pa.Array) -> np.ndarray:
    """Vectors, packed or lists, as rows."""
    if not pa.types.is_list(vec.type):
        vec = vec.cast(pa.binary())
        ends = np.frombuffer(vec.buffers()[1], np.int32)[vec.offset : vec.offset + len(vec) + 1]
        return np.frombuffer(vec.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(len(vec), -1)
    return vec.flatten().to_numpy().reshape(len(vec), -1)


def _model_tag(name: str) -> np.int64:
    return np.int64(int.from_bytes(hashlib.blake2b(name.encode("utf-8"), digest_size=8).digest(), "little", signed=True))


def _placed(tables: int, cell_target: int = CELL_TARGET):
    """Adds to each vector the cell of each table it is kept in (``own``) and the
    other cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("model").dictionary_encode()
            for m, name in enumerate(names.dictionary.to_pylist()):
                part = batch.take(pa.array(np.flatnonzero(names.indices.to_numpy() == m)))
                size, vec, n = part.num_rows, part.column("vec"), part.column("n")[0].as_py()
                raw = _matrix(vec)
                x = _unit(raw).astype(np.float32)
                sums, fracs, rs = [], [], []
                for t in range(tables):
                    a, b, r = _random(x.shape[1], t, 0, coarse_hashes(n, cell_target), COARSE_W)
                    place = x @ a.T + b
                    code = np.floor(place)
                    with np.errstate(over="ignore"):
                        sums.append((code.astype(np.int64) * r).sum(axis=1))
                    fracs.append(place - code)
                    rs.append(r)
                tag = _model_tag(name)

                def cell(total: np.ndarray, t: int, tag: np.int64 = tag) -> np.ndarray:
                    with np.errstate(over="ignore"):
                        c = total * np.int64(0x5851F42D4C957F2D) + tag * np.int64(31) + np.int64(t)
                    return (c & ~np.int64(TABLE_BITS)) | np.int64(t)  # the table can be read off a cell

                own = np.stack([cell(sums[t], t) for t in range(tables)], axis=1)
                visits = cells_to_visit(fracs, rs)
                rows = np.concatenate([v[0] for v in visits])
                with np.errstate(over="ignore"):
                    others = np.concatenate([cell(sums[t][v[0]] + v[1], t) for t, v in enumerate(visits)])
                order = np.argsort(rows, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=size))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, tables, dtype=np.int32)), pa.array(own.ravel())), pa.ListArray.from_arrays(pa.array(ends), pa.array(others[order]))]
                yield pa.RecordBatch.from_arrays([part.column("id"), _packed(raw), *lists], names=["id", "vec", "own", "visits"])

    return run


def _probe_sets(m: int) -> tuple[np.ndarray, np.ndarray]:
    """All moves of at most two of ``m`` hash values: (which column of the 2m
    single moves, or -1) twice."""
    single = [(i, -1) for i in range(2 * m)]
    double = [(i, j) for i in range(2 * m) for j in range(i + 1, 2 * m) if i % m != j % m]
    sets = np.array([(-1, -1), *single, *double], np.int64)
    return sets[:, 0], sets[:, 1]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as counted, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _screen(u: np.ndarray, q: np.ndarray, d: np.ndarray, starts: np.ndarray, counts: np.ndarray, buckets: np.ndarray, k: int, keep: int) -> np.ndarray:
    """For each query the ``keep`` most similar rows of its buckets, or -1: in
    single precision, and only such as may be among its ``k``.

    Buckets are runs of ``d`` that begin at ``starts``; query i visits the next
    ``counts[i]`` of ``buckets``. They are compared in pieces. A query's k-th best
    of the best in each piece is at most its k-th similarity, so what is worse by
    more than rounding is not looked at again; likewise for ``keep``.
    """
    ud, slack = u[d], np.float32(2 * (u.shape[1] + 2) * 2.0**-24 + 1e-9)
    length = np.diff(np.append(starts, len(d)))
    visits = np.concatenate([[0], np.cumsum(counts)])
    pairs = np.concatenate([[0], np.cumsum(length[buckets])])[visits]
    cuts = -(-length // PIECE)
    piece_of, nth = np.cumsum(cuts) - cuts, _ranges(np.zeros_like(cuts), cuts)
    starts, length = np.repeat(starts, cuts) + PIECE * nth, np.minimum(PIECE, np.repeat(length, cuts) - PIECE * nth)
    place = np.full(len(u), -1)
    place[d] = np.arange(len(d))
    who = np.full((len(q), keep), -1, np.int64)
    low = 0
    while low < len(q):
        high = max(low + 1, int(np.searchsorted(pairs, pairs[low] + MOST_PAIRS, "right")) - 1)
        b = buckets[visits[low] : visits[high]]
        number = np.diff(np.concatenate([[0], np.cumsum(cuts[b])])[visits[low : high + 1] - visits[low]])
        piece, row, col = _ranges(piece_of[b], cuts[b]), np.repeat(np.arange(high - low), number), _ranges(np.zeros_like(number), number)
        order = np.argsort(piece, kind="stable")
        piece, row, col = piece[order], row[order], col[order]
        wide = length[piece]
        at = np.cumsum(wide) - wide
        s = np.empty(wide.sum(), np.float32)
        uq = u[q[low:high]]
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        for i, j, o, p, n in zip(*(v.tolist() for v in (first, np.append(first, len(piece))[1:], at[first], starts[piece[first]], wide[first])), strict=True):
            np.matmul(uq[row[i:j]], ud[p : p + n].T, out=s[o : o + (j - i) * n].reshape(j - i, n))
        own = place[q[low:high]][row] - starts[piece]
        inside = (own >= 0) & (own < wide)
        s[at[inside] + own[inside]] = -np.inf
        best = np.maximum.reduceat(s, at) if len(at) else s
        bound = np.full((high - low, max(keep, min(MOST_BOUNDS, number.max()))), -np.inf, np.float32)
        some = col < MOST_BOUNDS
        bound[row[some], col[some]] = best[some]
        bound = np.partition(bound, [-keep, -k], axis=1)
        bound = np.maximum(bound[:, -k] - slack, np.nextafter(bound[:, -keep], np.float32(-np.inf)))
        near = np.flatnonzero(best > bound[row])
        s, rows, row = s[_ranges(at[near], wide[near])], _ranges(starts[piece[near]], wide[near]), np.repeat(row[near], wide[near])
        hit = np.flatnonzero(s > bound[row])
        order = hit[np.argsort(4.0 * row[hit] - s[hit])]
        row, rows = row[order], rows[order]
        number = np.bincount(row, minlength=high - low)
        col = _ranges(np.zeros_like(number), number)
        top = col < keep
        who[low + row[top], col[top]] = d[rows[top]]
        low = high
    return who


def _screen_few(u: np.ndarray, q: np.ndarray, d: np.ndarray, keep: int) -> np.ndarray:
    """The same where each query is compared with the few rows ``d``."""
    who = np.full((len(q), keep), -1, np.int64)
    for i in range(0, len(q), 4096):
        rows, found = q[i : i + 4096], who[i : i + 4096, : len(d)]
        s = u[rows] @ u[d].T
        s[rows[:, None] == d] = -np.inf
        if len(d) > keep:
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            found[:] = np.where(np.isinf(np.take_along_axis(s, top, 1)), -1, d[top])
        else:
            found[:] = np.where(np.isinf(s), -1, d)
    return who


def search_cell(ids: np.ndarray, vh: np.ndarray, x: np.ndarray, data: np.ndarray, query: np.ndarray, table: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, neighbours' rows or -1, similarities) within one cell."""
    unit = _unit(x)
    u = unit.astype(np.float32)
    d, q = np.flatnonzero(data), np.flatnonzero(query)
    order = d[np.lexsort((ids[d], vh[d]))]  # of equal vectors, the k + 1 smallest rows are enough
    new = np.concatenate([[True], vh[order][1:] != vh[order][:-1]]) if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    d = order[at - np.maximum.accumulate(np.where(new, at, 0)) <= k]
    m = math.ceil(math.log(len(d) / BUCKET_TARGET) / FINE_LOG) if len(d) > 4 * BUCKET_TARGET else 0
    if not m:
        starts = np.zeros(min(len(d), 1), np.int64)
        counts, buckets = np.full(len(q), len(starts)), np.zeros(len(q) * len(starts), np.int64)
    else:
        a, b, r = _random(x.shape[1], table, 1, m, FINE_W)
        f = u @ a.T + b
        low = np.floor(f)
        frac = f - low
        with np.errstate(over="ignore"):
            home = (low.astype(np.int64) * r).sum(axis=1)
            step = np.concatenate([-r, r, [np.int64(0)]])
        near = np.concatenate([frac**2, (1 - frac) ** 2, np.zeros((len(x), 1), np.float32)], axis=1)
        one, two = _probe_sets(m)
        order = np.argsort(home[d], kind="stable")
        d = d[order]
        keys, starts = np.unique(home[d], return_index=True)
        counts, to_bucket = [], []
        for i in range(0, len(q), 4096):
            rows = q[i : i + 4096]
            cost = near[rows][:, one] + near[rows][:, two]
            probes = min(PROBES, len(one))
            first = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
            target = home[rows][:, None] + step[one[first]] + step[two[first]]
            found = np.minimum(np.searchsorted(keys, target), len(keys) - 1)
            hit = keys[found] == target
            counts.append(hit.sum(axis=1))
            to_bucket.append(found[hit])
        counts, buckets = np.concatenate(counts), np.concatenate(to_bucket)
    keep = 2 * k + 3
    few = not m and len(d) <= 4 * PIECE
    who = _screen_few(u, q, d, keep) if few else _screen(u, q, d, starts, counts, buckets, k, keep)
    exact = np.full(who.shape, -np.inf)
    for i in range(0, len(q), 4096):
        exact[i : i + 4096] = np.einsum("ij,ikj->ik", unit[q[i : i + 4096]], unit[who[i : i + 4096]])
    exact = np.where(who < 0, -np.inf, np.round(exact, 9))
    neighbour = np.where(who < 0, np.iinfo(np.int64).max, ids[who])
    top = np.lexsort((neighbour, -exact), axis=1)[:, :k]
    exact = np.take_along_axis(exact, top, 1)
    return q, np.where(np.isinf(exact), -1, np.take_along_axis(who, top, 1)), exact


#: Neighbours and their similarities in units of the ninth decimal.
FOUND = pa.schema([("q", pa.int64()), ("c", pa.list_(pa.int64())), ("s", pa.list_(pa.int32()))])
UNITS = 1_000_000_000


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = _matrix(table.column("vec").combine_chunks())
        data = table.column("own").to_numpy()
        query = np.ones(len(ids), bool)
        order = np.lexsort((~data, ids))
        first = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]  # repeated rows count once
        if len(first) < len(ids):
            table = table.take(pa.array(first))
            ids, x, data, query = ids[first], x[first], data[first], query[first]
        if "blocks" in table.column_names:
            at = {c: pc.struct_field(table.column("blocks"), c).to_numpy() for c in ("d", "q")}
            data, query = data & (at["d"] == table.column("home_d").to_numpy()), at["q"] == table.column("home_q").to_numpy()
        tab = table.column("cell")[0].as_py() & TABLE_BITS
        q, rows, sims = search_cell(ids, _equal_vectors(x), x, data, query, tab, k)
        ok = rows >= 0
        offsets = np.concatenate([[0], np.cumsum(ok.sum(axis=1))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (ids[rows[ok]], np.rint(sims[ok] * UNITS).astype(np.int32))]
        return pa.table([pa.array(ids[q]), *lists], schema=FOUND)

    return run


def nearest(df: DataFrame, key: str, model: str, vector: str, k: int = K, tables: int = TABLES, cell_rows: int = CELL_ROWS, cell_target: int = CELL_TARGET) -> DataFrame:
    """(q, c, similarity, rank): for each usable row its k most similar rows."""
    spark = df.sparkSession
    rows = usable_vectors(df, key, model, vector).withColumn("vh", F.xxhash64("model", "vec"))
    # vectors that stand in very many rows: their rows beyond the first k + 1
    ids = materialise(rows.select("id", "vh"), "vectors").distinct()
    heavy = ids.groupBy("vh").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > HEAVY)
    in_heavy = ids.join(heavy, "vh")
    first = in_heavy.withColumn("r", F.row_number().over(Window.partitionBy("vh").orderBy("id"))).where(F.col("r") <= k + 1)
    first = materialise(first.select("vh", "id", "r"), "heavy")
    rest = in_heavy.select("id", "vh").join(first.select("id"), "id", "left_anti")
    heads = first.where(F.col("r") <= k).select("vh", F.col("id").alias("c"), F.col("r").alias("rank"))
    of_rest = rest.join(heads, "vh").select(F.col("id").alias("q"), "c", F.lit(1.0).alias("similarity"), "rank")

    index = rows.join(rest.select("id"), "id", "left_anti") if not first.isEmpty() else rows
    placed = materialise(index.mapInArrow(_placed(tables, cell_target), "id bigint, vec binary, own array<bigint>, visits array<bigint>"), "placed")
    entries = placed.select(F.explode("own").alias("cell"), F.lit(1).alias("kept")).unionByName(placed.select(F.explode("visits").alias("cell"), F.lit(0).alias("kept")))
    sizes = entries.groupBy("cell").agg(F.sum("kept").alias("kept"), F.count(F.lit(1)).alias("asked")).where("kept > 0")
    blocks = lambda c: F.ceil(F.col(c) / cell_rows).cast("int")
    sizes = materialise(sizes.select("cell", blocks("kept").alias("gd"), blocks("asked").alias("gq"), "asked"), "cells")
    in_blocks = not sizes.where("gd > 1 or gq > 1").limit(1).isEmpty()
    found = None
    for t in range(tables):
        of_table = F.pmod(F.col("cell"), F.lit(TABLE_BITS + 1)) == t
        kept = F.array(F.struct(F.col("own")[t].alias("cell"), F.lit(True).alias("own")))
        asked = F.transform(F.filter("visits", lambda c: F.pmod(c, F.lit(TABLE_BITS + 1)) == t), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own")))
        cells = placed.select("id", "vec", F.explode(F.concat(kept, asked)).alias("e")).select("e.cell", "id", "vec", "e.own")
        here = sizes.where(of_table)
        tasks = max(1, math.ceil((here.agg(F.sum(F.col("asked") * F.greatest("gd", F.lit(1)))).first()[0] or 0) / TASK_ROWS))
        # a visit to a cell that keeps nothing ends here
        cells = meet_hot(cells, here.drop("asked"), "cell", "id", "inner")
        group = ["cell"]
        if in_blocks:
            group = ["cell", "blocks"]
            home = lambda g, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(g)).cast("int")
            cells = cells.withColumns({"home_d": home("gd", 1), "home_q": home("gq", 2)})
            pair = lambda d, q: F.struct(d.alias("d"), q.alias("q"))
            as_data = F.when(F.col("own"), F.transform(F.sequence(F.lit(0), F.col("gq") - 1), lambda q: pair(F.col("home_d"), q))).otherwise(F.array().cast("array<struct<d:int,q:int>>"))
            as_query = F.transform(F.sequence(F.lit(0), F.col("gd") - 1), lambda d: pair(d, F.col("home_q")))
            cells = cells.withColumn("blocks", F.explode(F.array_distinct(F.concat(as_data, as_query))))
        cells = cells.drop("gd", "gq").repartition(max(tasks, spark.sparkContext.defaultParallelism), *group)
        part = materialise(cells.groupBy(*group).applyInArrow(_search(k), "q bigint, c array<bigint>, s array<int>"), "near")
        found = part if found is None else found.unionByName(part)
        del cells
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # this table's shuffle files go before the next one's are written
    # one row per cell visited: a handful
    tables_of = F.transform(F.collect_list(F.struct("s", "c")), lambda t: F.zip_with(t["s"], t["c"], lambda s, c: F.struct((-s).alias("s"), c.alias("c"))))
    merged = found.groupBy("q").agg(tables_of.alias("near")).select("q", F.slice(F.sort_array(F.array_distinct(F.flatten("near"))), 1, k).alias("near"))
    out = merged.select("q", F.posexplode("near").alias("p", "x")).select("q", F.col("x.c").alias("c"), (-F.col("x.s") / UNITS).alias("similarity"), (F.col("p") + 1).alias("rank"))
    return out.unionByName(of_rest)


def neighbour_pairs(index: DataFrame) -> DataFrame:
    """Pairs of rows of which at least one is among the other's k nearest."""
    found = nearest(index, "row_idx", "embedding_model", "vector")
    return found.select(F.least("q", "c").alias("row_a"), F.greatest("q", "c").alias("row_b")).distinct()
