import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import leaks as lk

PASSAGE = "The Vozijer athlete recovery outweighs the Sutar match outcome in 3.2e-6 cases. Both the nehon-like injury prevention and the Fubir panel point to a Roluhor playoff series near the old harbour wall."
ITEM = f"Read the text: what holds? {PASSAGE} Which sample is reported for Molijir?"
WORDS = PASSAGE.split()


def exchanged(every):
    return " ".join("other" if i % every == every - 1 else w for i, w in enumerate(WORDS))


DOCS = {
    1: f"Before. {PASSAGE} After.",
    2: "Some words. " + " ".join(WORDS[5:20]) + " and more words.",
    3: "Some words. " + " ".join(WORDS[5:19]) + " and more words.",  # fourteen
    4: exchanged(8),
    5: exchanged(2),
    6: "Read the text: what holds? Something else. Which sample is reported for Molijir?",
    7: "<b>" + PASSAGE.upper().replace(" ", "\n", 7) + "</b>",
    8: PASSAGE.replace("o", "о").replace("a", "а"),  # Cyrillic
    9: "​".join(PASSAGE.replace("fi", "ﬁ")),
    10: None,
    11: "",
    12: "word " * 200_000 + PASSAGE,
}
EXPECTED = {1, 2, 4, 7, 8, 9, 12}


def find(spark, docs, items, **more):
    d = spark.createDataFrame([(k, v, "x") for k, v in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(k, v, "x") for k, v in items], "item_id bigint, text string, grams string")
    got = [tuple(r) for r in lk.find_leaks(d, i, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [1, 4000])
def test_leaks(spark, block):
    items = [(7, ITEM), (8, "One sentence only."), (9, None), (10, ""), (11, "Do it. Short one. Why?"), (7, ITEM)]
    assert find(spark, [*DOCS.items(), *DOCS.items()], items, block_items=block) == {(d, 7) for d in EXPECTED}


def test_item_in_most_documents_is_still_found(spark):
    docs = [(i, f"Row {i}. {PASSAGE}") for i in range(300)]
    assert find(spark, docs, [(1, ITEM)]) == {(i, 1) for i in range(300)}


def test_empty_tables(spark):
    assert find(spark, [], [(1, ITEM)]) == set()
    assert find(spark, list(DOCS.items()), []) == set()


def test_passage_between_instruction_and_question():
    assert lk.passage_of(ITEM).strip() == PASSAGE
    assert lk.passage_of("A. B?") == "" and lk.passage_of("") == ""


def test_every_long_enough_run_holds_a_seed():
    block = lk.make_block([(1, ITEM)])
    rng = np.random.default_rng(0)
    for _ in range(20):
        lk.choose_seeds(block, rng.integers(0, 1000, len(block.grams)))
        places = np.sort(block.seeds[2])
        assert places[0] < lk.STRETCH and (np.diff(places) <= lk.STRETCH).all() and places[-1] >= len(block.words[0]) - lk.SEED_WORDS + 1 - lk.STRETCH


def smith_waterman(doc, passage):
    best, rows = 0, [[0] * (len(doc) + 1)]
    for p in passage:
        row = [0]
        for j, w in enumerate(doc, 1):
            row.append(max(0, rows[-1][j - 1] + (lk.MATCH if w == p else lk.MISMATCH), rows[-1][j] + lk.GAP, row[-1] + lk.GAP))
        rows.append(row)
        best = max(best, *row)
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=15), st.lists(st.integers(0, 4), min_size=1, max_size=10))
def test_alignment_score_equals_brute_force(doc, passage):
    score, first, past = lk.align(np.array(doc, np.int32), np.array(passage, np.int32))
    assert score == smith_waterman(doc, passage) and 0 <= first <= past <= len(passage)


@pytest.mark.parametrize("every", [4, 5, 8, 11])
def test_single_edited_copy_is_found(spark, every):
    """No other document raises the counts of the sequences that are left."""
    assert find(spark, [(1, f"Some words. {exchanged(every)} And more."), (2, "Nothing of it.")], [(7, ITEM)]) == {(1, 7)}


def test_edited_copy_without_intact_sequences_and_too_much_edited(spark):
    with_more = " ".join(w + (" extra" if i % 3 == 2 else "") for i, w in enumerate(WORDS))  # a word after every third
    assert find(spark, [(1, with_more), (2, exchanged(3))], [(7, ITEM)]) == {(1, 7)}
