"""Problem 8: passages of evaluation items inside training text.

Items are a stated query set: every text is read once for ``LEXICON_ITEMS`` items
and written as numbers of the words that these items have. Items are then taken
in blocks of ``BLOCK``, and each block is compared with the numbers of every
document where they lie, so nothing is shuffled but counts. One pass counts in how many documents each four-word
sequence of the items occurs. Of each ``STRETCH`` successive sequences of a
passage the one in the fewest documents is a seed, so any quotation of fifteen
words holds a seed however often it leaked. A second pass looks the seeds up;
where one is found, the run of equal words around it is measured. Edited copies
may lack every seed, as exchanged words spoil the sequences over them, so they
are looked for by all sequences of a passage: where enough words of the document
stand in the passage's order to make an edited copy possible, the neighbourhood
is aligned with the passage (Smith-Waterman over words).

Defined results: null and empty texts and items give nothing; an item without a
passage between its first and last sentence gives nothing; repeated rows give a
pair once; texts are searched whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import flat, grams
from foliospark.session import materialise

SEED_WORDS, STRETCH, RUN = 4, 8, 15
#: An edited copy aligns with so much of the passage, with so many equal words.
COVER, EQUAL = 0.9, 0.75
BLOCK, LEXICON_ITEMS = 4000, 40_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: What an edited copy scores for each word of the passage. Every place of the
#: alignment that is no match costs 1, so of n words at least SAME * n are
#: matched, and the copy spans at most SPAN * n words of the document.
LEAST_SCORE = MATCH * EQUAL + MISMATCH * (1 - EQUAL)
SAME, SPAN = (LEAST_SCORE + COVER) / (MATCH + 1), MATCH + 1 - LEAST_SCORE

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    "АВЕКМНОРСТУХІЈЅԚԜаеорсухіјѕԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαıɑɡ",
    "ABEKMHOPCTYXIJSQWaeopcyxijsdqwhlABEZHIKMNOPTYXoaiag",
)
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|\\[A-Za-z]+(?=\{)|&[A-Za-z]{2,8};")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case, without markup, marks, invisible and look-alike characters."""
    text = _MARKUP.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(LOOK_ALIKES))
        text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return text.lower()


class Lexicon:
    """Words as numbers: those of the items; any other word is -1."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def learn(self, words: list[str]) -> np.ndarray:
        return np.array([self.known.setdefault(w, len(self.known)) for w in words], np.int32)

    def read(self, text: str) -> np.ndarray:
        get = self.known.get
        return np.array([get(w, -1) for w in _WORD.findall(plain(text))], np.int32)


def passage_of(item: str) -> str:
    """What stands between the first sentence and the closing question."""
    ends = [m.end() for m in re.finditer(r"[.!?][\"')\]]*\s+", item.strip())]
    return item.strip()[ends[0] : ends[-1]] if len(ends) > 1 else ""


@dataclass
class Block:
    """A block of items, ready to be looked for."""

    items: np.ndarray  # their keys
    words: list[np.ndarray]
    typed: list[np.ndarray]  # for each word, the number of the typed word it is of
    lexicon: Lexicon | None
    grams: np.ndarray  # distinct sequences of the block, sorted
    need: np.ndarray  # for each item, the words that an edited copy has at least
    holders: tuple[np.ndarray, np.ndarray, np.ndarray]  # first entry of each word; items and times of the entries
    seeds: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # sequence, item, place


def make_block(rows: list[tuple[int, str]], lexicon: Lexicon | None = None) -> Block:
    lexicon = Lexicon() if lexicon is None else lexicon
    keys, words, typed = [], [], []
    for key, text in rows:
        pieces = [_WORD.findall(x) for x in plain(passage_of(text or "")).split()]
        of = [i for i, p in enumerate(pieces) for _ in p]
        if len(of) >= SEED_WORDS:
            keys.append(key)
            words.append(lexicon.learn([w for p in pieces for w in p]))
            typed.append(np.array(of, np.int32))
    every = [grams(w, SEED_WORDS) for w in words]
    need = np.array([math.ceil(SAME * len(w) - 1e-9) for w in words], np.int64)
    return Block(np.array(keys, np.int64), words, typed, lexicon, np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64), need, _holders(words, len(lexicon.known)))


def _holders(words: list[np.ndarray], known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not words:
        return np.zeros(known + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    item = np.repeat(np.arange(len(words)), [len(w) for w in words])
    entries, times = np.unique(np.concatenate(words).astype(np.int64) * len(words) + item, return_counts=True)
    word, item = np.divmod(entries, len(words))
    return np.searchsorted(word, np.arange(known + 1)), item, times


def choose_seeds(block: Block, documents: np.ndarray) -> None:
    """Of each stretch of sequences the one in the fewest documents."""
    seq, item, place = [], [], []
    for i, w in enumerate(block.words):
        g = grams(w, SEED_WORDS)
        df = documents[np.searchsorted(block.grams, g)]
        width = min(STRETCH, len(g))
        windows = np.lib.stride_tricks.sliding_window_view(df, width)
        at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
        seq.append(g[at])
        item.append(np.full(len(at), i))
        place.append(at)
    if seq:
        seq, item, place = np.concatenate(seq), np.concatenate(item), np.concatenate(place)
        order = np.argsort(seq, kind="stable")
        block.seeds = seq[order], item[order], place[order]


def longest_run(doc: np.ndarray, passage: np.ndarray, typed: np.ndarray, at: int, place: int) -> int:
    """Typed words of the passage in the run of equal words through a seed."""
    back = min(at, place)
    same = doc[at - back : at] == passage[place - back : place]
    start = place - (back if same.all() else int(same[::-1].argmin()))
    ahead = min(len(doc) - at, len(passage) - place)
    same = doc[at : at + ahead] == passage[place : place + ahead]
    end = place + (ahead if same.all() else int(same.argmin()))
    inside = set(typed[start:end].tolist())
    if start and typed[start - 1] == typed[start]:
        inside.discard(int(typed[start]))
    if end < len(typed) and typed[end] == typed[end - 1]:
        inside.discard(int(typed[end - 1]))
    return len(inside)


def align(doc: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first and past word of the passage)."""
    n = len(doc)
    j = np.arange(n, dtype=np.int64)
    above = np.zeros(n, np.int64)
    above_start = np.zeros(n, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(passage):
        diagonal = np.concatenate([[0], above[:-1]]) + np.where(doc == word, MATCH, MISMATCH)
        start = np.concatenate([[i], np.where(above[:-1] > 0, above_start[:-1], i)])
        down = above + GAP
        take = down > diagonal
        score, start = np.where(take, down, diagonal), np.where(take, above_start, start)
        score = np.maximum(score, 0)
        run = np.maximum.accumulate((score - GAP * j) * (1 << 24) + j)
        source = run & ((1 << 24) - 1)
        above, above_start = (run >> 24) + GAP * j, start[source]
        top = int(above.argmax())
        if above[top] > best[0]:
            best = (int(above[top]), int(above_start[top]), i + 1)
    return best


def leaked_items(doc: np.ndarray, block: Block) -> list[int]:
    """Places in the block of the items that a document holds."""
    if not len(doc) or block.seeds is None:
        return []
    g = grams(doc, SEED_WORDS)
    seq, item, place = block.seeds
    low, high = np.searchsorted(seq, g, "left"), np.searchsorted(seq, g, "right")
    hits = np.flatnonzero(high > low)
    meets: dict[int, list[tuple[int, int]]] = {}
    for at in hits:
        for s in range(low[at], high[at]):
            meets.setdefault(int(item[s]), []).append((int(at), int(place[s])))
    found = {i for i, seeds in meets.items() if any(longest_run(doc, block.words[i], block.typed[i], at, p) >= RUN for at, p in seeds)}
    for i in _with_enough_words(doc, block):
        if i not in found and _edited_copy(doc, block.words[i], int(block.need[i])):
            found.add(i)
    return sorted(found)


def _with_enough_words(doc: np.ndarray, block: Block) -> list[int]:
    """Items of which the document has as many words as an edited copy has."""
    starts, item, times = block.holders
    words, n = np.unique(doc[(doc >= 0) & (doc < len(starts) - 1)], return_counts=True)  # later blocks have more words
    low, count = starts[words], starts[words + 1] - starts[words]
    at = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
    same = np.bincount(item[at], np.minimum(times[at], np.repeat(n, count)), minlength=len(block.need))
    return np.flatnonzero(same >= block.need).tolist()


def _edited_copy(doc: np.ndarray, passage: np.ndarray, need: int) -> bool:
    n = len(passage)
    span = int(SPAN * n)
    before = np.concatenate([[0], np.cumsum(np.isin(doc, passage))])
    first = np.arange(max(1, len(doc) - span + 1))
    starts = first[before[np.minimum(first + span, len(doc))] - before[first] >= need]
    done = -1
    for begin in starts.tolist():
        if begin <= done:  # within the neighbourhood aligned last
            continue
        done = begin + span
        score, start, past = align(doc[begin : done + span], passage)
        if past - start >= COVER * n and score >= n * LEAST_SCORE:
            return True
    return False


def _read(lexicon: Lexicon):
    """(doc_id, words): texts as numbers; a text with too few known words for any
    sequence is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = lexicon.read(text)
                if np.count_nonzero(words >= 0) >= SEED_WORDS:
                    keys.append(key)
                    found.append(words)
            ends = np.concatenate([[0], np.cumsum([len(w) for w in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "words"])

    return run


def _count(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.grams), np.int64)
        for b in batches:
            words, ends = flat(b.column(0))
            for begin, end in zip(ends, ends[1:], strict=False):
                g = np.unique(grams(words[begin:end], SEED_WORDS))
                at = np.minimum(np.searchsorted(block.grams, g), len(total) - 1)
                total[at[block.grams[at] == g]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "documents"])

    return run


def _find(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, ends = flat(b.column(1))
            docs, items = [], []
            for key, begin, end in zip(b.column(0).to_pylist(), ends, ends[1:], strict=False):
                for i in leaked_items(words[begin:end], block):
                    docs.append(key)
                    items.append(int(block.items[i]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, block_items: int = BLOCK, lexicon_items: int = LEXICON_ITEMS) -> DataFrame:
    """(doc_id, item_id): documents that hold an item's passage."""
    spark = docs.sparkSession
    text = docs.where("doc_id is not null and text != ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.make_valid_utf8("text").alias("text"))
    asked = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    found, pending = spark.createDataFrame([], "doc_id bigint, item_id bigint"), []

    def look_for(rows: list[tuple[int, str]]) -> None:
        nonlocal found
        lexicon = Lexicon()
        blocks = [make_block(rows[i : i + block_items], lexicon) for i in range(0, len(rows), block_items)]
        blocks = [b for b in blocks if len(b.items)]
        if not blocks:
            return
        for block in blocks:
            block.lexicon = None  # words are numbers from here on
        words = materialise(text.mapInArrow(_read(lexicon), "doc_id bigint, words array<int>"), "words")
        part = None
        for block in blocks:
            counts = words.select("words").mapInArrow(_count(block), "gram bigint, documents bigint").groupBy("gram").agg(F.sum("documents").alias("n"))
            documents = np.zeros(len(block.grams), np.int64)
            for row in counts.toLocalIterator():  # as many as the block has sequences
                documents[row["gram"]] = row["n"]
            choose_seeds(block, documents)
            here = words.mapInArrow(_find(block), "doc_id bigint, item_id bigint")
            part = here if part is None else part.unionByName(here)
        found = found.unionByName(materialise(part, "leaks"))

    for row in asked.toLocalIterator():
        pending.append((row["item_id"], row["text"]))
        if len(pending) == lexicon_items:
            look_for(pending)
            pending = []
    look_for(pending)
    return found.distinct()
