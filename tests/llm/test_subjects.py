import random

import numpy as np
import pytest

from foliospark.llm import subjects as sj

AREAS = ["biology", "law", "sport"]
NOUNS = {"biology": ["gene", "cell membrane", "protein", "enzyme", "yeast"], "law": ["court", "patent", "plaintiff", "appeal", "tribunal"], "sport": ["goalkeeper", "marathon", "referee", "sprint", "stadium"]}
FRAMES = ["We compare the {} with the {} over time.", "The {} limits the {} in most cases.", "Results show that the {} follows the {}."]
PLAIN = ["This work is shared with all who read it.", "Readers may turn the page when they like."]
DOCS = "doc_id bigint, text string, source string, section string, n string"


def document(rng, areas, n=10, plain=0):
    out = [rng.choice(FRAMES).format(*rng.sample(NOUNS[areas[i % len(areas)]], 2)) for i in range(n)] + [rng.choice(PLAIN) for _ in range(plain)]
    return "A heading\n" + " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(300):
        areas = rng.sample(AREAS, rng.choice([1, 1, 2]))
        rows.append((i, document(rng, areas), rng.choice(["s1", "s2", None]), rng.choice(["notes", None]), "x"))
        truth[i] = set(areas)
    for i in range(300, 330):
        rows.append((i, " ".join(PLAIN * 4), "s1", "boilerplate", "x"))
        truth[i] = set()
    return rows, truth


@pytest.fixture(scope="module")
def tables(spark, corpus):
    rows, truth = corpus
    labels = [(i, a.upper() if i % 7 == 0 else a + " ") for i in range(0, 200) for a in truth[i]] + [(None, "law"), (3, "nothing"), (5, None)]
    labels += labels[:9]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([(a, "about") for a in AREAS], "subject string, about string")


def test_held_out_accuracy(tables, corpus):
    _, truth = corpus
    docs, labels, subjects = tables
    got = [tuple(r) for r in sj.find_subjects(docs, labels, subjects).collect()]
    assert len(got) == len(set(got)) and {a for _, a in got} <= set(AREAS)
    held = {(i, a) for i, a in got if i >= 200}
    expected = {(i, a) for i in range(200, 330) for a in truth[i]}
    assert len(held & expected) >= 0.95 * len(expected) and len(held & expected) >= 0.95 * len(held)


def test_passing_mention_is_no_case(tables):
    docs, labels, subjects = tables
    rng = random.Random(4)
    text = document(rng, ["law"], 9) + " " + FRAMES[0].format("gene", "yeast")
    one = docs.sparkSession.createDataFrame([(9000, text, None, None, "x"), (9001, None, None, None, "x"), (9002, "", None, None, "x"), (9003, " \n", None, None, "x")], DOCS)
    got = {tuple(r) for r in sj.find_subjects(docs.unionByName(one).unionByName(one), labels, subjects).collect() if r.doc_id >= 9000}
    assert got == {(9000, "law")}


def test_without_labels_nothing_is_found(tables):
    docs, labels, subjects = tables
    assert sj.find_subjects(docs, labels.limit(0), subjects).count() == 0
    assert sj.find_subjects(docs.limit(0), labels, subjects).count() == 0


def test_labels_are_bounded(tables):
    docs, labels, _ = tables
    assert len(sj.labelled_rows(docs, labels, AREAS, most=10)) == 10
    some = sj.labelled_rows(docs, labels, AREAS, most=10, letters=2000)
    assert 0 < len(some) < 10 and sum(len(r[0]) for r in some) <= 2000


@pytest.mark.parametrize(("label", "area"), [("LAW", "law"), ("la", "law"), ("biolgy", "biology"), (" sport ", "sport"), ("spotr", "sport"), ("cooking", None), (None, None), ("", None)])
def test_clean_label(label, area):
    assert sj.clean_label(label, AREAS) == area


def test_sentences():
    got = sj.sentences("# Heading here now\n\n1. Introduction\n- One two three four.\n* Five six seven eight. Nine ten eleven!\nTITLE: a b c d.\nQ: why is it so?\nA: Because it is so.")
    assert [len(s) for s in got] == [4, 4, 3, 4]
    assert sj.sentences("") == [] and sj.sentences("two words") == []


def test_beam_search_is_exact_for_few_areas():
    rng = np.random.default_rng(0)
    model = sj.Model(AREAS, {}, np.zeros((0, 3)), {}, [0, 1, 2], [rng.standard_normal(4 + i) for i in range(3)], [(1.0, 0.0)] * 3)
    import itertools
    import math

    for _ in range(30):
        x = rng.standard_normal(4)

        def cost(bits, x=x):
            return sum(math.log1p(math.exp(-float(model.logit(s, x, np.array(bits[:s]))) * (1 if b else -1))) for s, b in enumerate(bits))

        best = min(itertools.product([0.0, 1.0], repeat=3), key=cost)
        rows = np.stack([x, -x, x])  # rows do not mix
        assert model.decode(rows)[0].tolist() == [bool(b) for b in best] == model.decode(rows)[2].tolist()
