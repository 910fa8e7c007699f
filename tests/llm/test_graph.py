import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm.graph import bucket_pairs, connected_components


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_equal_union_find(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    got = {r.node: r.root for r in connected_components(df, "a", "b").collect()}
    assert got == components([e for e in edges if e[0] != e[1]])


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(600)]
    random.Random(1).shuffle(chain)
    star = [(10_000, i) for i in range(10_001, 12_000)]
    df = spark.createDataFrame(chain + star, "a bigint, b bigint").repartition(4)
    roots = {r.root for r in connected_components(df, "a", "b").collect()}
    assert roots == {0, 10_000}


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_bucket_pairs_of_hot_and_cold_keys(spark, block):
    rows = [("hot", i, i) for i in range(40)] + [("a", 1, 1), ("a", 2, 2), ("alone", 3, 3)]
    df = spark.createDataFrame(rows, "key string, node bigint, x bigint").repartition(3)
    got = sorted((r.node_a, r.node_b) for r in bucket_pairs(df, "key", "node", ["x"], block=block).collect())
    assert got == sorted([(i, j) for i in range(40) for j in range(i + 1, 40)] + [(1, 2)])
