import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.operators import packed
from foliospark.operators.packed import KEYWORDS, NAMES, resolve_skeleton, split_packed

AUTHORS = [
    ("A B, C D", ["A B", "C D"]),
    (" A B;C D | E F ", ["A B", "C D", "E F"]),
    ("A B and C D & E F, and G H", ["A B", "C D", "E F", "G H"]),
    ("A B AND C D et al.", ["A B", "C D"]),
    ("A B, C D, et al.", ["A B", "C D"]),
    ("Bond, James; Who, D.", ["Bond, James", "Who, D."]),
    ("A Bond, Jr., C D", ["A Bond, Jr.", "C D"]),
    ("Bond, James, Jr. ; C D", ["Bond, James, Jr.", "C D"]),
    ('"Bond, J.", C D', ["Bond, J.", "C D"]),
    ('"Kate ""K"" Bush" / C D', ['Kate "K" Bush', "C D"]),
    ('"Soils and Rivers Group";A B', ["Soils and Rivers Group", "A B"]),
    ('["A B", "C \\"X\\" D", "Ren\\u00e9 E"]', ["A B", 'C "X" D', "René E"]),
    ("['A B', 'Bond, J.', 'V \"Vic\" W', \"O'Neil P\"]", ["A B", "Bond, J.", 'V "Vic" W', "O'Neil P"]),
    ("['A \\'x\\' B']", ["A 'x' B"]),
    ("A B,\u00a0C D", ["A B", "C D"]),
    ("A B\nC D\tE F", ["A B", "C D", "E F"]),
    ("A B, , C D,", ["A B", "C D"]),
    ('A "x" B, C D', ['A "x" B', "C D"]),
    ('"never closed, C D', ['"never closed', "C D"]),
    ("O'Brien Pat, C D", ["O'Brien Pat", "C D"]),
    ("A Sand, B Land", ["A Sand", "B Land"]),
    ("A\ufdd0B X, C\ufdd5D Y and \ufdd3E Z", ["AB X", "CD Y", "E Z"]),  # noncharacters are used inside
    ("[]", []), ("", []), ("  ", []), (None, []), ("[ ]", []), (", ;", []), ('""', []), ("et al.", []),
]
WORDS = [
    ("a b, c and d; e & f", ["a b", "c and d", "e & f"]),
    ('x | "0.5,1 y" | z', ["x", "0.5,1 y", "z"]),
    ('"a";"b"', ["a", "b"]),
    ("['x', '1,2 y']", ["x", "1,2 y"]),
    ("one", ["one"]),
    ("a · b • c / d", ["a", "b", "c", "d"]),
]


def split(spark, cases, kind, **more):
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "key bigint, f string, skeleton string")
    got: dict[int, list] = {i: [] for i in range(len(cases))}
    for r in split_packed(df, "f", "key", kind, **more).orderBy("row_key", "pos").collect():
        got[r.row_key].append((r.pos, r.val))
    return got


@pytest.mark.parametrize(("cases", "kind"), [(AUTHORS, NAMES), (WORDS, KEYWORDS)])
@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_cases(spark, cases, kind, broadcast):
    got = split(spark, cases, kind, max_broadcast=broadcast)
    for i, (field, values) in enumerate(cases):
        assert got[i] == list(enumerate(values, 1)), field


def test_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d")], "key bigint, f string")
    got = sorted((tuple(r) for r in split_packed(df, "f", "key", NAMES).collect()), key=repr)
    assert got == [(1, 1, "a b"), (1, 1, "a b"), (None, 1, "c d")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "key bigint, f string")
    out = split_packed(df, "f", "key", NAMES)
    assert out.count() == 0 and out.dtypes == [("row_key", "bigint"), ("pos", "bigint"), ("val", "string")]


def test_very_long_field(spark):
    names = [f"A{i} B{i}" for i in range(20_000)]
    got = split(spark, [("; ".join(names), None), ("x" * 1_000_000, None), ('"' + '""' * 20_000 + '"', None)], NAMES)
    assert [v for _, v in got[0]] == names
    assert got[1] == [(1, "x" * 1_000_000)] and got[2] == [(1, '"' * 20_000)]


value = st.text(st.sampled_from("abc ,;|/'\"\\é&"), min_size=1, max_size=8).map(str.strip).filter(lambda v: v and v.strip('"'))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(value, min_size=1, max_size=5), min_size=1, max_size=8))
def test_round_trip_of_quoted_lists(spark, fields):
    import json

    quoted = [(";".join('"' + v.replace('"', '""') + '"' for v in f), None) for f in fields]
    as_json = [(json.dumps(f), None) for f in fields]
    for cases in (quoted, as_json):
        got = split(spark, cases, KEYWORDS)
        assert [[v for _, v in got[i]] for i in range(len(fields))] == fields


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("wsj ,;|/\"'\\&\n﷐﷓"), max_size=25), st.sampled_from(["nP", "nL", "kP", "kL"]))
def test_any_skeleton_gives_ranges_in_order(body, head):
    past = 0
    for first, n, style in resolve_skeleton(head + body):
        assert first > past and n >= 0 and first + n - 1 <= len(body) and style in (0, 1, 2, 3)
        past = first + n - 1


def test_split_fields(spark, sf_dir):
    out = packed.split_fields(spark.read.parquet(f"{sf_dir}/paper_metadata.parquet"), spark.read.parquet(f"{sf_dir}/topics.parquet"))
    assert out.columns == ["src_field", "row_key", "pos", "val"]
    assert {r[0] for r in out.select("src_field").distinct().collect()} == {"authors", "keywords"}
