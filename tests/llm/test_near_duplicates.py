import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import align, omh
from foliospark.llm import near_duplicates as nd

PAPER = "record_id bigint, title string, summary string, id string, tx string, words string"


def lines(texts):
    flat = np.array([w for t in texts for w in t], np.int32)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def share(a, b, k=3):
    grams = [{tuple(t[i : i + k]) for i in range(len(t) - k + 1)} or ({tuple(t)} if t else set()) for t in (a, b)]
    return len(grams[0] & grams[1]) / max(1, len(grams[0] | grams[1]))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


words = st.lists(st.integers(1, 6), max_size=14)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=6))
def test_share_and_alignment_equal_brute_force(pairs):
    wa, oa = lines([p[0] for p in pairs])
    wb, ob = lines([p[1] for p in pairs])
    assert np.allclose(align.common_share(wa, oa, wb, ob), [share(a, b) for a, b in pairs])
    got = align.banded_edits(wa, oa, wb, ob, band=20)
    assert got.tolist() == [edits(a, b) if a and b else max(len(a), len(b)) for a, b in pairs]


def test_narrow_band_never_says_less():
    rng = np.random.default_rng(0)
    a = [list(rng.integers(1, 9, 30)) for _ in range(20)]
    b = [[*x[3:], *x[:3]] for x in a]
    wa, oa = lines(a)
    wb, ob = lines(b)
    assert all(n >= edits(x, y) for n, x, y in zip(align.banded_edits(wa, oa, wb, ob, band=2), a, b, strict=True))


def test_equal_texts_have_equal_sketches_in_any_company():
    rng = np.random.default_rng(0)
    texts = [list(rng.integers(1, 50, n)) for n in (1, 2, 3, 5, 80, 80, 400, 7)]
    alone = [omh.sketch(*lines([t])) for t in texts]
    keys, prints = omh.sketch(*lines(texts))
    for i, (k, p) in enumerate(alone):
        assert (keys[i] == k[0]).all() and prints[i] == p[0]
    assert (omh.sketch(*lines([[]]))[0] == 0).all()


def test_repeated_grams_are_labelled():
    keys, _ = omh.sketch(*lines([[1, 2] * 20, [1, 2] * 30]))
    assert (keys[0] != keys[1]).any()


@pytest.fixture
def papers(spark):
    base = [f"w{i} v{i * 7 % 31} u{i * 3 % 17}" for i in range(12)]
    text = ". ".join(base)
    rows = [
        (1, "A title", text), (2, "a TITLE", text.upper()), (3, "A title", text + " extra words here"), (4, "A title", "<i>" + text.replace(". ", " .\n ") + "</i>"),
        (5, "A title", ". ".join([*base[6:], *base[:6]])), (6, "Other", "something else entirely about stars and dust"), (7, None, text), (8, "A title", None), (9, "A title", " \n"),
        (10, "", "--"), (11, "", "!!"), (12, "x", "y"), (13, "X", "y."), (1, "A title", text),
    ]
    return spark.createDataFrame([(*r, "i", "t", "w") for r in rows], PAPER)


def test_pairs_equal_brute_force(papers):
    got = [tuple(r) for r in nd.find_similar_papers(papers).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    import re

    texts = {r.record_id: re.findall(r"[^\W_]+", re.sub("<[^>]*>", " ", f"{r.title} {r.summary}".lower())) for r in papers.collect() if r.title is not None and (r.summary or "").strip()}
    texts = {k: v for k, v in texts.items() if v}
    expected = {p for p in itertools.combinations(sorted(texts), 2) if share(texts[p[0]], texts[p[1]]) >= 0.6}
    assert set(got) == expected and (1, 4) in expected and (12, 13) in expected


def test_classes_equal_brute_force(papers):
    pairs = {tuple(r) for r in nd.find_similar_papers(papers).collect()}
    got = {r.record_id: r for r in nd.classes_of_papers(papers).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 12, 13}
    root = {i: i for i in got}
    for a, b in sorted(pairs) * 3:
        root[a] = root[b] = min(root[a], root[b])
    assert {i: r.class_id for i, r in got.items()} == root
    assert got[6].n_links == 0 and got[6].edit_similarity is None and got[12].n_links == 0
    assert got[1].n_links == 2 and 0.9 < got[3].edit_similarity < 1


@settings(max_examples=40, deadline=None)
@given(words.filter(len), words)
def test_edits_prove_a_share(a, b):
    wa, oa = lines([a])
    wb, ob = lines([b])
    most = max(align.distinct_grams(wa, oa)[0], align.distinct_grams(wb, ob)[0])
    assert align.distinct_grams(wa, oa)[0] == len({tuple(a[i : i + 3]) for i in range(len(a) - 2)} or {tuple(a)})
    assert 1 - 6 * align.banded_edits(wa, oa, wb, ob)[0] / most <= share(a, b) + 1e-9


def test_empty_table(spark):
    assert nd.find_similar_papers(spark.createDataFrame([], PAPER)).count() == 0


def test_many_copies_and_long_text(spark):
    long = " ".join(f"q{i}" for i in range(30_000))
    rows = [(i, "t", "the same words stand here again and again") for i in range(60)] + [(100, "t", long), (101, "t", long + " end")]
    got = {tuple(r) for r in nd.find_similar_papers(spark.createDataFrame([(*r, "", "", "") for r in rows], PAPER)).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60)} | {(100, 101)}


def test_recall_on_edited_texts(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], set()
    for d in range(150):
        words = [f"w{x}" for x in rng.integers(0, 4000, 80)]
        edited = list(words)
        for at in rng.choice(80, 4, replace=False):
            edited[at] = "changed"
        rows += [(2 * d, "t", " ".join(words)), (2 * d + 1, "t", " ".join(edited))]
        if share(["t", *words], ["t", *edited]) >= 0.6:
            expected.add((2 * d, 2 * d + 1))
    got = {tuple(r) for r in nd.find_similar_papers(spark.createDataFrame([(*r, "", "", "") for r in rows], PAPER)).collect()}
    assert got <= expected and len(got) >= 0.98 * len(expected) > 100
