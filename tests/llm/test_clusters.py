import itertools

from pyspark.sql import functions as F

from foliospark.llm import clusters as cl

TOPICS = "topic_row bigint, doc_count double, keywords string, id string, kws string"
BASE = ["time heart", "scoring", "boundary", "split", "pull crowd", "imaging survey", "demand domain", "formation state"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "i", "k") for r in rows], TOPICS)


ROWS = [
    (1, 5.0, ", ".join(BASE)),
    (2, None, " | ".join(w.upper() for w in BASE)),
    (3, -1.0, "; ".join([*BASE[:5], "mountain path", "river bed", "coal seam"])),  # 5 of 8
    (4, 7.0, "; ".join([*BASE[:4], "gold leaf", "iron gate", "salt lake", "tin can"])),  # 4 of 8 is not more than half, but 4 of the 6 of row 5 is
    (5, 2.0, "time-hearts, scorings, boundry, Split, pull_crowd, other"),  # slips and hyphens; 5 of 6
    (6, 1.0, "violin, trumpet"), (7, 1.0, "trumpet, violin, cello"), (8, 1.0, "cello, lamp, chair"),
    (9, 1.0, None), (10, 1.0, ""), (11, 1.0, "[]"), (12, 1.0, "alone"),
]
EXPECTED = {(1, 2), (1, 3), (1, 4), (1, 5), (6, 7)}


def test_rows(spark):
    more = [(20 + i, 1.0, ", ".join(BASE)) for i in range(6)]  # makes "boundry" the rarer spelling
    got = [tuple(r) for r in cl.found_rows(table(spark, ROWS + more)).collect()]
    assert len(got) == len(set(got)) and set(got) == EXPECTED | {(1, r[0]) for r in more}


def test_repeated_rows_and_empty_tables(spark):
    assert {tuple(r) for r in cl.found_rows(table(spark, ROWS[:4] * 3)).collect()} == {(1, 2), (1, 3)}
    assert cl.found_rows(table(spark, [])).count() == 0
    assert cl.found_rows(table(spark, [(1, 1.0, None)])).count() == 0


def test_description(spark):
    got = {r.first_row: r for r in cl.describe_clusters(table(spark, ROWS[:3] + ROWS[5:8] + ROWS[11:])).collect()}
    assert (got[1].n_rows, got[1].doc_count) == (3, 5) and set(got[1].typical_rows) <= {1, 2, 3}
    assert (got[6].n_rows, got[8].n_rows, got[12].n_rows) == (2, 1, 1) and got[12].typical_rows == [12]


def test_links_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    lists = []
    for i in range(120):
        theme = rng.randrange(12)
        pool = list(range(theme * 10, theme * 10 + 14))
        lists.append((i, sorted(rng.sample(pool, rng.randint(1, 10)))))
    df = spark.createDataFrame(lists, "id bigint, kws array<bigint>").repartition(3)
    rarity = df.select(F.explode("kws").alias("k")).groupBy("k").count()
    order = {r.k: (r["count"], r.k) for r in rarity.collect()}
    df = spark.createDataFrame([(i, sorted(k, key=order.get)) for i, k in lists], "id bigint, kws array<bigint>")
    true = {(a[0], b[0]): len(set(a[1]) & set(b[1])) / min(len(a[1]), len(b[1])) for a, b in itertools.combinations(lists, 2)}
    true = {pair: round(w, 9) for pair, w in true.items() if w > 0.5}
    for block in (3, 4096):  # hot keywords in blocks, and none
        got = [(r.a, r.b, round(r.w, 9)) for r in cl.links(df, block).collect()]
        assert len(got) == len(true) and {(a, b): w for a, b, w in got} == true


def test_levels_join_what_links_join(spark):
    """A chain of groups is cut by one clustering and joined by the next ones."""
    edges = [(10 * g + a, 10 * g + b, 1.0) for g in range(6) for a, b in itertools.combinations(range(4), 2)]
    edges += [(10 * g + 3, 10 * g + 10, 0.55) for g in range(5)] + [(100, 101, 0.6)]
    df = spark.createDataFrame(edges, "a bigint, b bigint, w double")
    placed, flow = cl.markov_clusters(df)
    placed = {r.node: r.cluster for r in placed.collect()}
    assert len({placed[i] for i in placed if i < 100}) == 1 and placed[100] == placed[101] != placed[0]
    once = {r.node: r.attractor for r in cl.attractors(flow).collect()}
    assert len({once[i] for i in once if i < 100}) > 1
    columns = flow.groupBy("j").agg(F.sum("w").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in columns) and len(columns) == 26


def test_markov_clusters_cut_a_bridge(spark):
    edges = [(a, b, 1.0) for g in ((0, 1, 2, 3), (10, 11, 12, 13)) for a, b in itertools.combinations(g, 2)] + [(3, 10, 0.55)]
    flow = cl.settled_flow(spark.createDataFrame(edges, "a bigint, b bigint, w double"))
    out = {r.node: r.attractor for r in cl.attractors(flow).collect()}
    assert len({out[i] for i in (0, 1, 2, 3)}) == 1 and len({out[i] for i in (10, 11, 12, 13)}) == 1 and out[0] != out[13]


def test_reduced(spark):
    df = spark.createDataFrame([("Time-Hearts",), ("gas",), ("  a_b  ",), ("mass transfers",)], "c string")
    assert [r[0] for r in df.select(cl.reduced(F.col("c"))).collect()] == ["time heart", "gas", "a b", "mas transfer"]


def test_slip_keys_of_words_of_any_length():
    import random

    rng = random.Random(3)
    for n in (1, 2, 3, 5, 63, 64, 65, 66, 130, 301):
        word = "".join(rng.choice("abcde") for _ in range(n))
        for _ in range(30):
            i, c = rng.randrange(n), rng.choice("xyz")
            others = [word[:i] + c + word[i + 1 :], word[:i] + c + word[i:], word[:i] + word[i + 1 :]]
            if i + 1 < n:
                others.append(word[:i] + word[i + 1] + word[i] + word[i + 2 :])
            for other in others:
                if len(other) > 1 and n > 1:
                    assert set(cl.slip_keys(word)) & set(cl.slip_keys(other)), (word, other)


def test_squaring_in_full_and_sparse_equals_numpy(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = 30
    m = rng.random((n, n)) * (rng.random((n, n)) < 0.3)
    label = np.arange(n) // 7
    i, j = np.nonzero(m)
    left = np.stack([label[j], j, np.ones(len(i)), i, label[i], m[i, j]])
    right = np.stack([label[i], i, np.zeros(len(i)), j, label[j], m[i, j]])
    e = np.concatenate([left, right], axis=1)
    e = e[:, np.lexsort((e[1], e[0]))]

    def square(entries, products):
        monkeypatch.setattr(cl, "ENTRIES", entries)
        monkeypatch.setattr(cl, "PRODUCTS", products)
        columns = [e[0].astype(int), e[1].astype(int), e[2] > 0, e[3].astype(int), e[4].astype(int), e[5]]
        batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 50]) for c in columns], names=list("abcdef")) for k in range(0, e.shape[1], 50)]
        out = np.zeros((n, n))
        for b in cl._squared(iter(batches)):
            x = [c.to_numpy() for c in b.columns]
            assert (x[1] == label[x[0]]).all() and (x[3] == label[x[2]]).all()
            np.add.at(out, (x[0], x[2]), x[4])
        return out

    for entries, products in ((10**6, 10**6), (60, 10**6), (60, 10), (1, 1)):
        assert np.allclose(square(entries, products), m @ m)
