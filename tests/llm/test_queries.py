"""The registered queries on the smallest test tables."""

import pytest

from foliospark.llm import queries as q

COLUMNS = {
    "p1_found": ["name_a", "name_b"],
    "p2_found": ["first_id", "record_id"],
    "p3_found": ["first_row", "topic_row"],
    "p4_found": ["row_a", "row_b"],
    "p6_found": ["record_a", "record_b"],
    "p7_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_no_repeated_rows(spark, sf_dir, name):
    df = q.queries()[name](spark, sf_dir)
    assert df.columns == COLUMNS[name]
    got = [tuple(map(str, r)) for r in df.collect()]
    assert got and len(got) == len(set(got))
    if name in ("p1_found", "p2_found", "p3_found", "p4_found", "p6_found"):
        assert all(r[0] < r[1] for r in df.collect())


def test_clusters_query(spark, sf_dir):
    got = q.queries()["p3_clusters"](spark, sf_dir).collect()
    with_keywords = spark.read.parquet(f"{sf_dir}/topics.parquet").where("trim(keywords) != '' and keywords != '[]'").count()
    assert sum(r.n_rows for r in got) == with_keywords
