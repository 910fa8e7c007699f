import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import nearest as nn

INDEX = "row_idx bigint, embedding_model string, vector array<float>, id string, cell string, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "i", "c", "n") for r in rows], INDEX).repartition(4)


def brute(rows, k=5):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[2] for r in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -s[i]))[: min(k, len(ids) - 1)]}


def clustered(n, dim, groups, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return [(i, "m-1", [float(v) for v in centres[i % groups] + 0.2 * rng.standard_normal(dim)]) for i in range(n)]


def pairs(df):
    got = [tuple(r) for r in nn.neighbour_pairs(df).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


@pytest.mark.parametrize("name", ["LitEnc-Mini-64", " litenc_mini_64 ", "local/litenc-mini-64", "LITENC MINI 64", "a/b/litenc-mini-64/"])
def test_model_names(spark, name):
    df = spark.createDataFrame([(name,)], "c string")
    assert df.select(nn.model_name(F.col("c"))).first()[0] == "litenc-mini-64"


def test_one_small_cell_is_exact(spark):
    rows = clustered(300, 16, 20)
    assert pairs(table(spark, rows)) == brute(rows)


def test_unusable_rows_are_left_out(spark):
    rows = clustered(30, 4, 3)
    nan, inf = float("nan"), float("inf")
    bad = [(100, "m-1", None), (101, "m-1", []), (102, "m-1", [0.0] * 4), (103, "m-1", [nan, 1.0, 1.0, 1.0]), (104, "m-1", [inf, 1.0, 1.0, 1.0]), (105, "m-1", [1.0, 2.0]), (106, None, [1.0] * 4), (107, " ", [1.0] * 4), (108, "m-1", [None, 1.0, 1.0, 1.0]), (None, "m-1", [1.0] * 4)]
    assert pairs(table(spark, rows + bad)) == brute(rows)


def test_models_apart_and_spelled_alike(spark):
    a = clustered(20, 4, 2)
    b = [(i + 1000, "Wide 8", v) for i, _, v in clustered(20, 8, 2, 1)]
    a = [(i, ("M_1", "x/m-1")[i % 2], v) for i, _, v in a]
    assert pairs(table(spark, a + b)) == brute(a) | brute(b)


def test_usual_length_of_a_tie_is_the_shorter(spark):
    rows = [(1, "m", [1.0, 0.0]), (2, "m", [0.0, 1.0]), (3, "m", [1.0, 0.0, 0.0]), (4, "m", [0.0, 1.0, 0.0])]
    assert pairs(table(spark, rows)) == {(1, 2)}


def test_ties_go_to_the_smaller_row_and_repeated_rows_count_once(spark):
    rows = [(i, "m", [1.0, 1.0]) for i in range(12)]
    assert pairs(table(spark, rows)) == brute(rows)
    assert pairs(table(spark, rows + rows)) == brute(rows)


def test_scaled_vectors_are_equal(spark):
    rows = [(i, "m", [float(10.0 ** (i - 4)), 0.0, float(10.0 ** (i - 4))]) for i in range(9)]
    assert pairs(table(spark, rows)) == brute(rows)


def test_heavy_vectors(spark):
    rows = [(i, "m", [3.0, 4.0]) for i in range(200)] + [(1000 + i, "m", [3.0 + 0.01 * i, 4.0]) for i in range(1, 10)]
    assert pairs(table(spark, rows)) == brute(rows)


def test_few_rows_and_empty_table(spark):
    assert pairs(table(spark, [(1, "m", [1.0])])) == set()
    assert pairs(table(spark, [])) == set()


def test_cells_in_blocks_lose_nothing(spark):
    rows = clustered(400, 8, 400)
    df = table(spark, rows)
    got = nn.nearest(df, "row_idx", "embedding_model", "vector", cell_rows=37)
    assert {(min(r.q, r.c), max(r.q, r.c)) for r in got.collect()} == brute(rows)


def test_groups_are_bounded(spark):
    """Neither kept rows nor queries of a group go far beyond a block."""
    rows = clustered(1000, 8, 1000)
    search = nn._search

    def counting(k):
        def counted(table):
            return pa.table({"q": [table.num_rows], "c": [[table.num_rows]], "s": [[1]]}, schema=nn.FOUND)

        return counted

    nn._search = counting
    try:
        found = nn.nearest(table(spark, rows), "row_idx", "embedding_model", "vector", cell_rows=100)
        sizes = [r.q for r in found.select("q").distinct().collect()]
    finally:
        nn._search = search
    assert sizes and max(sizes) <= 2 * 100 * 1.5


def test_many_coarse_hashes_through_spark(spark):
    rows = clustered(1200, 16, 60)
    assert nn.coarse_hashes(len(rows), 1) >= 14
    got = nn.nearest(table(spark, rows), "row_idx", "embedding_model", "vector", cell_target=1, cell_rows=50)
    found, expected = {(min(r.q, r.c), max(r.q, r.c)) for r in got.collect()}, brute(rows)
    assert len(found & expected) >= 0.9 * len(expected)


def _search_locally(rows, cell_target):
    x = pa.array([r[2] for r in rows], pa.list_(pa.float32()))
    ids = pa.array([r[0] for r in rows], pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(["m"] * len(rows)), x, pa.array([len(rows)] * len(rows))], names=["id", "model", "vec", "n"])
    (placed,) = nn._placed(nn.TABLES, cell_target)(iter([batch]))
    members = {}
    for i, (own, visits) in enumerate(zip(placed.column("own").to_pylist(), placed.column("visits").to_pylist(), strict=True)):
        for c, kept in [*((c, True) for c in own), *((c, False) for c in visits)]:
            members.setdefault(c, []).append((i, kept))
    assert len(members) > nn.TABLES
    best: dict[int, set] = {}
    for c, found in members.items():
        at = pa.array([i for i, _ in found])
        group = pa.table({"cell": pa.array([c] * len(found)), "id": ids.take(at), "vec": x.take(at), "own": pa.array([kept for _, kept in found])})
        out = nn._search(5)(group)
        for q, near, sims in zip(out.column("q").to_pylist(), out.column("c").to_pylist(), out.column("s").to_pylist(), strict=True):
            best.setdefault(q, set()).update(zip([-s for s in sims], near, strict=True))
    return {(min(q, c), max(q, c)) for q, near in best.items() for _, c in sorted(near)[:5]}


def test_recall_with_cells_and_buckets(monkeypatch):
    monkeypatch.setattr(nn, "BUCKET_TARGET", 32)
    rows = clustered(4000, 24, 100)
    expected = brute(rows)
    assert len(_search_locally(rows, 600) & expected) >= 0.9 * len(expected)


@pytest.mark.parametrize("target", [2000, 300, 60])
def test_recall_does_not_fall_with_coarse_hashes(monkeypatch, target):
    monkeypatch.setattr(nn, "BUCKET_TARGET", 10_000)  # a cell is searched whole
    rows = clustered(4000, 24, 200)
    assert nn.coarse_hashes(4000, target) >= 2
    expected = brute(rows)
    assert len(_search_locally(rows, target) & expected) >= 0.985 * len(expected)


def test_long_names_of_models_have_cells_of_their_own():
    assert nn._model_tag("a" * 5000 + "b") != nn._model_tag("a" * 5000 + "c")


def _search_whole(n, dim, seed=0, equal=1):
    x = np.repeat(np.random.default_rng(seed).standard_normal((n // equal, dim)), equal, axis=0).astype(np.float32)
    ids = np.random.default_rng(seed + 1).permutation(n).astype(np.int64)
    all_rows = np.ones(n, bool)
    _, rows, sims = nn.search_cell(ids, np.arange(n), x, all_rows, all_rows, 0)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    best = -np.sort(-s, axis=1)[:, :5]
    assert all(i not in r for i, r in enumerate(rows.tolist()))
    assert np.allclose(sims, best, rtol=0, atol=2e-9) and np.allclose(np.take_along_axis(s, rows, 1), best, rtol=0, atol=2e-9)


@pytest.mark.parametrize(("piece", "pairs", "bounds"), [(128, 1 << 22, 64), (64, 1 << 22, 64), (7, 1 << 22, 64), (3, 1, 2), (1, 1000, 9), (4096, 5000, 64)])
def test_screening_loses_nothing(monkeypatch, piece, pairs, bounds):
    monkeypatch.setattr(nn, "BUCKET_TARGET", 10_000)  # a cell is searched whole
    for name, value in (("PIECE", piece), ("MOST_PAIRS", pairs), ("MOST_BOUNDS", bounds)):
        monkeypatch.setattr(nn, name, value, raising=False)
    _search_whole(403, 16)
    _search_whole(400, 3, equal=4)


def test_few_of_the_compared_pairs_are_ranked(monkeypatch):
    """ranking every pair of every bucket took most of the query's time."""
    monkeypatch.setattr(nn, "BUCKET_TARGET", 10_000)
    ranked = 0

    def counting(function):
        def counted(x, *args, **kwargs):
            nonlocal ranked
            ranked += np.size(x)
            return function(x, *args, **kwargs)

        return counted

    for name in ("argpartition", "argsort", "partition"):
        monkeypatch.setattr(nn.np, name, counting(getattr(np, name)))
    n = 2000
    x = np.random.default_rng(5).standard_normal((n, 24)).astype(np.float32)
    nn.search_cell(np.arange(n), np.arange(n), x, np.ones(n, bool), np.ones(n, bool), 0)
    assert ranked < n * n / 8


def test_packed_vectors_are_the_same_rows():
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    packed = nn._packed(x)
    for form in (packed, packed.cast(pa.large_binary()), pa.array(x.tolist(), pa.list_(pa.float32()))):
        assert (nn._matrix(form) == x).all() and (nn._matrix(form.slice(1, 2)) == x[1:3]).all()
