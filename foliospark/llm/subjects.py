"""Problem 9: the subject areas of each document.

A model is fitted on labelled documents, at most ``MAX_LABELLED`` of them with at
most ``MAX_LETTERS`` letters together, and applied to every document where it
lies, a batch of documents at a time. What the areas are said to cover counts as
one more text of each area where terms are weighed.

Terms (words and pairs of neighbouring words) get weights per area from the
sentences of labelled documents, by expectation maximisation: a document's
labels say which areas its sentences may treat, the terms say which of them each
sentence does treat. The shares of a document's sentences per area, with its
source and structure, are the features of a classifier chain: one logistic
model per area, each seeing the decisions of those before it, fitted on shares
that come from terms of other folds, and calibrated (Platt) on held-out folds.
The labels of a document are decoded by beam search over the chain.

Defined results: null, empty and sentence-less texts have no area; labels that
name no area, or have a null document, are left out; repeated rows give an area
once; without any usable label nothing is found.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import materialise

#: The sample that the model is fitted on: documents, and letters of them all.
MAX_LABELLED, MAX_LETTERS = 20_000, 64_000_000
FOLDS, ROUNDS, BEAM = 4, 4, 8
ROWS_AT_ONCE = 500
#: Term evidence below which a sentence treats no area.
LEAST = 1.0
SECTIONS = ("abstract", "context", "fulltext", "notes", "answer", "boilerplate")  # any other counts as none of these

_LABEL = re.compile(r"^(?:#+\s|title:|q:)", re.I)
_LEAD = re.compile(r"^(?:content:|a:|[-*•]\s|\d+[.)]\s)\s*", re.I)
_BREAK = re.compile(r"(?<=[.!?。])[\"')\]]*\s+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence; titles and headings aside."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or _LABEL.match(line):
            continue
        for piece in _BREAK.split(_LEAD.sub("", line)):
            if piece.rstrip("\"')] ")[-1:] in {".", "!", "?", "。"}:
                words = _WORD.findall(piece.lower())
                if len(words) >= 3:
                    out.append(words)
    if not out:  # a text of one unpunctuated piece
        words = _WORD.findall(text.lower())
        return [words] if len(words) >= 8 else []
    return out


def terms_of(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def clean_label(label: str | None, areas: list[str]) -> str | None:
    """The area a label names, however it is typed."""
    label = re.sub(r"[\W\d_]+", "", (label or "").lower())
    if label in areas or not label:
        return label or None
    near = [a for a in areas if (len(label) >= 2 and a.startswith(label)) or _one_off(a, label)]
    return near[0] if len(near) == 1 else None


def _one_off(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def fit_terms(docs: list[list[list[str]]], labels: list[set[int]], n: int) -> tuple[dict[str, int], np.ndarray]:
    """(term -> row, weights: terms x areas)."""
    seen: Counter[str] = Counter()
    for d in docs:
        seen.update({t for s in d for t in terms_of(s)})
    kept = sorted(t for t, c in seen.items() if c > 1)
    index = {t: i for i, t in enumerate(kept)}
    ids = [[np.array([index[t] for t in terms_of(s) if t in index], np.int64) for s in d] for d in docs]
    flat = [s for d in ids for s in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in ids])
    if not flat:
        return index, np.zeros((len(index), n))
    terms = np.concatenate(flat)
    at = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    prior = np.full((len(docs), n), 1e-3)
    for i, ls in enumerate(labels):
        for a in ls:
            prior[i, a] = 1.0
    prior /= prior.sum(axis=1, keepdims=True)
    share = prior[owner]
    weights = np.zeros((len(index), n))
    for step in range(ROUNDS):
        counts = np.zeros((len(index), n))
        for a in range(n):
            counts[:, a] = np.bincount(terms, share[at, a], len(index))
        total = counts.sum(axis=1, keepdims=True)
        rate = counts.sum(axis=0, keepdims=True) / counts.sum()
        weights = np.log((counts + 2 * rate) / ((total + 2) * rate))
        # a term spread over areas says nothing, however often it occurs
        weights *= (np.abs(weights).max(axis=1) > 0.7)[:, None]
        score = np.zeros((len(flat), n))
        for a in range(n):
            score[:, a] = np.bincount(at, weights[terms, a], len(flat))
        score = np.log(prior[owner] + (1e-3 if step == 0 else 2e-2)) + score
        score -= score.max(axis=1, keepdims=True)
        share = np.exp(score)
        share /= share.sum(axis=1, keepdims=True)
    return index, weights


def shares(docs: list[list[list[str]]], index: dict[str, int], weights: np.ndarray) -> np.ndarray:
    """A row per document: the share of its sentences that treat each area, and of
    those that treat none."""
    n = weights.shape[1]
    sizes = np.array([len(d) for d in docs], np.int64)
    get = index.get
    ids = [[i for t in terms_of(s) if (i := get(t)) is not None] for d in docs for s in d]
    at = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    terms = np.fromiter((i for x in ids for i in x), np.int64, len(at))
    score = np.stack([np.bincount(at, weights[terms, a], len(ids)) for a in range(n)], axis=1) if n else np.zeros((len(ids), 0))
    top = score.argmax(axis=1) if len(ids) else np.zeros(0, np.int64)
    top = np.where(score[np.arange(len(ids)), top] >= LEAST, top, n)
    counts = np.bincount(np.repeat(np.arange(len(docs)), sizes) * (n + 1) + top, minlength=len(docs) * (n + 1))
    return counts.reshape(len(docs), n + 1) / np.maximum(1, sizes)[:, None]


def features(share: np.ndarray, docs: list[list[list[str]]], sources: list[str | None], sections: list[str | None], known: dict[str, np.ndarray]) -> np.ndarray:
    """Term, source and structure features, a row per document."""
    n = share.shape[1] - 1
    none = np.zeros(n)
    prior = np.array([known.get(s or "", none) for s in sources]).reshape(len(docs), n)
    kind = np.array([[float((x or "") == s) for s in SECTIONS] for x in sections]).reshape(len(docs), len(SECTIONS))
    length = np.log1p([len(d) for d in docs])
    return np.concatenate([share, np.tanh(20 * (share[:, :n] - 0.25)), share[:, :n].max(axis=1, keepdims=True), length[:, None], prior, kind, np.ones((len(docs), 1))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; last column free."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    areas: list[str]
    index: dict[str, int]
    weights: np.ndarray
    sources: dict[str, np.ndarray]
    order: list[int]
    chain: list[np.ndarray]
    platt: list[tuple[float, float]]

    def logit(self, step: int, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of rows of features, or of any decisions before for each row."""
        slope, offset = self.platt[step]
        own = x @ self.chain[step][step:]
        earlier = before @ self.chain[step][:step]
        return slope * (earlier + own[..., None] if earlier.ndim > own.ndim else earlier + own) + offset

    def decode(self, x: np.ndarray) -> np.ndarray:
        """For each row of features the most likely set of areas, as a row of
        booleans, by beam search along the chain."""
        rows = np.arange(len(x))[:, None]
        cost, before = np.zeros((len(x), 1)), np.zeros((len(x), 1, 0))
        for step in range(len(self.order)):
            z = self.logit(step, x, before)
            width = z.shape[1]
            grown = np.concatenate([cost + np.logaddexp(0, z), cost + np.logaddexp(0, -z)], axis=1)
            best = np.argsort(grown, axis=1, kind="stable")[:, :BEAM]
            cost = np.take_along_axis(grown, best, 1)
            before = np.concatenate([before[rows, best % width], (best >= width)[:, :, None].astype(float)], axis=2)
        found = np.zeros((len(x), len(self.order)), bool)
        found[:, self.order] = before[:, 0] > 0
        return found

    def areas_of(self, texts: list[str], sources: list[str | None], sections: list[str | None]) -> np.ndarray:
        """(text, area) booleans; a text without sentences has no area."""
        docs = [sentences(t) for t in texts]
        found = self.decode(features(shares(docs, self.index, self.weights), docs, sources, sections, self.sources))
        return found & np.array([bool(d) for d in docs], bool)[:, None]


def _source_table(sources: list[str | None], y: np.ndarray) -> dict[str, np.ndarray]:
    """Smoothed lift of each area per source."""
    base = y.mean(axis=0)
    groups: dict[str, list[int]] = defaultdict(list)
    for i, s in enumerate(sources):
        if s:
            groups[s].append(i)
    return {s: (y[at].sum(axis=0) + 20 * base) / (len(at) + 20) - base for s, at in groups.items() if len(at) > 4}


def fit(rows: list[tuple[str, str | None, str | None, set[int]]], areas: list[str], about: list[str | None] | None = None) -> Model | None:
    """Fit on (text, source, section, areas) of labelled documents, and on what
    the areas are about."""
    told = [(i, words) for i, t in enumerate(about or []) if len(words := _WORD.findall((t or "").lower())) >= 3]
    more, of = [[words] for _, words in told], [{i} for i, _ in told]
    docs = [sentences(r[0]) for r in rows]
    keep = [i for i, d in enumerate(docs) if d and rows[i][3]]
    if len(keep) < 2 * FOLDS:
        return None
    docs, rows, n = [docs[i] for i in keep], [rows[i] for i in keep], len(areas)
    y = np.zeros((len(rows), n))
    for i, r in enumerate(rows):
        y[i, list(r[3])] = 1
    fold = np.arange(len(rows)) * 7919 % FOLDS
    x = np.zeros((len(rows), 0))
    for f in range(FOLDS):
        here, there = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        index, weights = fit_terms([*(docs[i] for i in there), *more], [*(rows[i][3] for i in there), *of], n)
        table = _source_table([rows[i][1] for i in there], y[there])
        some = [docs[i] for i in here]
        part = features(shares(some, index, weights), some, [rows[i][1] for i in here], [rows[i][2] for i in here], table)
        if not x.shape[1]:
            x = np.zeros((len(rows), part.shape[1]))
        x[here] = part
    order = [int(a) for a in np.argsort(-y.sum(axis=0), kind="stable")]
    chain, platt = [], []
    for step, a in enumerate(order):
        z = np.concatenate([y[:, order[:step]], x], axis=1)
        held = np.zeros(len(rows))
        for f in range(FOLDS):
            held[fold == f] = z[fold == f] @ _logistic(z[fold != f], y[fold != f, a])
        slope, offset = _logistic(np.stack([held, np.ones(len(rows))], axis=1), y[:, a], ridge=1e-3)
        chain.append(_logistic(z, y[:, a]))
        platt.append((max(0.05, float(slope)), float(offset)))
    index, weights = fit_terms([*docs, *more], [*(r[3] for r in rows), *of], n)
    return Model(areas, index, weights.astype(np.float32), _source_table([r[1] for r in rows], y), order, chain, platt)


def labelled_rows(docs: DataFrame, labels: DataFrame, areas: list[str], most: int = MAX_LABELLED, letters: int = MAX_LETTERS) -> list[tuple[str, str | None, str | None, set[int]]]:
    """Whole texts of labelled documents in the order of a hash of the key: at most
    ``most``, and as many as have at most ``letters`` letters together."""
    ours = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.collect_set("subject").alias("subjects"))
    ours = ours.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.make_valid_utf8("text").alias("text"), "source", "section").dropDuplicates(["doc_id"])
    rows = materialise(texts.join(ours, "doc_id"), "labelled")
    so_far = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of at most ``most`` numbers
    kept = rows.select("doc_id", "h", F.sum(F.length("text")).over(so_far).alias("n")).where(F.col("n") <= letters).select("doc_id")
    place = {a: i for i, a in enumerate(areas)}
    found = rows.join(kept, "doc_id").orderBy("doc_id").collect()
    return [(r["text"], r["source"], r["section"], {place[a] for s in r["subjects"] if (a := clean_label(s, areas)) in place}) for r in found]


def find_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, subject): the areas that each document treats."""
    told = subjects.where("subject is not null").groupBy("subject").agg(F.min("about").alias("about")).orderBy("subject").collect()  # the stated areas
    areas = [r["subject"] for r in told]
    model = fit(labelled_rows(docs, labels, areas, most), areas, [r["about"] for r in told])
    if model is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, subject string")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many terms as the bounded sample has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.areas, pa.string())
        for batch in batches:
            for b in (batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
                found = model.areas_of(*[c.to_pylist() for c in b.columns[1:]])
                at, area = np.nonzero(found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), names.take(pa.array(area))], names=["doc_id", "subject"])

    rows = docs.where("doc_id is not null and text != ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.make_valid_utf8("text").alias("text"), "source", "section")
    return rows.mapInArrow(run, "doc_id bigint, subject string").distinct()
