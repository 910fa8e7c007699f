"""Problem 6: near-duplicate records with small edits.

Order MinHash keys bring candidates together, a fingerprint turns away chance
meetings, and banded alignment gives the word edits of each candidate. An edit
changes three sequences of three words at most on either side, so few edits prove
the share of common sequences; where they do not (texts whose sentences changed
places), the exact share decides. Equal normalised texts are one
class from the start; only one text of a class is sketched and compared, and
classes are spread out to pairs of rows at the end, as the result asks for.

Defined results: rows with a null title or a null or blank summary are left out;
rows whose normalised text has no word, or whose key is null, match nothing;
repeated rows of the same key count once; a text of one or two words is a single sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import align, omh
from foliospark.llm.graph import bucket_pairs, connected_components
from foliospark.llm.words import flat, normalised, word_hashes
from foliospark.session import materialise

THRESHOLD = 0.6
GRAM, ELL = 4, 3
#: Of the 20 three-bit fields of two fingerprints, so many must agree.
LEAST_FIELDS = 6
FIELD_BITS = 0x0249249249249249

SKETCH_SCHEMA = "id bigint, tx bigint, fp bigint, n3 int, keys array<bigint>, words array<int>"


def record_text(title: Column, summary: Column) -> Column:
    """Title followed by summary; null where the record has no usable text."""
    usable = title.isNotNull() & summary.rlike(r"(?U)\S")
    return F.when(usable, F.concat_ws("\n", title, summary))


def texts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(id, tx, words): the key, a hash of the normalised text, its word hashes."""
    norm = df.select(F.col(key).cast("bigint").alias("id"), normalised(text).alias("norm")).where("id is not null and norm != ''")
    return norm.select("id", F.xxhash64("norm").alias("tx"), word_hashes(F.col("norm")).alias("words"))


def sketcher(gram: int, ell: int, keys: int, carry: list[str], count: bool = True):
    """For mapInArrow over rows with tx and words: the columns of ``carry``, then
    fp, with ``count`` n3 (distinct three-word sequences), keys and words; the last
    two are null for texts that the partition has had already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            rows = np.flatnonzero(b.column("tx").is_valid().to_numpy(zero_copy_only=False))
            tx = b.column("tx").fill_null(0).to_numpy()
            _, at = np.unique(tx[rows], return_index=True)
            first = np.sort(rows[at])
            first = first[np.array([t not in seen for t in tx[first].tolist()], bool)]
            seen.update(tx[first].tolist())
            words, offsets = flat(b.column("words").take(pa.array(first)))
            sketched, prints = omh.sketch(words, offsets, gram, ell)
            fp = np.zeros(n, np.int64)
            fp[first] = prints
            n3 = np.zeros(n, np.int32)
            if count:
                n3[first] = align.distinct_grams(words, offsets)
            made = {"fp": pa.array(fp)} | ({"n3": pa.array(n3)} if count else {})
            lists = [_spread(n, first, sketched[:, :keys].ravel(), np.full(len(first), keys)), _spread(n, first, words, np.diff(offsets))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], *made.values(), *lists], names=[*carry, *made, "keys", "words"])

    return run


def _spread(n: int, rows: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Lists at ``rows`` of ``n``, null elsewhere."""
    of = np.zeros(n, np.int64)
    of[rows] = lengths
    none = np.ones(n + 1, bool)
    none[rows] = none[-1] = False
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(of)]).astype(np.int32), mask=none), pa.array(values))


def sketch_table(df: DataFrame, key: str, text: Column) -> DataFrame:
    return texts(df, key, text).mapInArrow(sketcher(GRAM, ELL, omh.SKETCHES, ["id", "tx"]), SKETCH_SCHEMA)


def agreeing_fields(x: Column, y: Column) -> Column:
    d = x.bitwiseXOR(y)
    d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2))
    return F.lit(omh.SKETCHES) - F.bit_count(d.bitwiseAND(F.lit(FIELD_BITS)))


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (wa, oa), (wb, ob) = flat(b.column("wa")), flat(b.column("wb"))
            edits = align.banded_edits(wa, oa, wb, ob)
            longest = np.maximum(np.maximum(np.diff(oa), np.diff(ob)), 1)
            most = np.maximum(b.column("na").to_numpy(), b.column("nb").to_numpy())
            share = 1 - 6 * edits / np.maximum(most, 1)  # proven by the edits
            open_ = np.flatnonzero((share < threshold) | (most == 0))
            some = b.take(pa.array(open_))
            share[open_] = align.common_share(*flat(some.column("wa")), *flat(some.column("wb")))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(share), pa.array(1 - edits / longest)], names=["a", "b", "share", "edit_similarity"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        share = align.common_share(*flat(b.column("wa")), *flat(b.column("wb")))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(share)], names=["a", "b", "share"])


def _with_words(pairs: DataFrame, docs: DataFrame, more: dict[str, str]) -> DataFrame:
    """Pairs with the words, and ``more``, of both texts; any row of a text serves."""
    one = docs.dropDuplicates(["tx"])
    for s in ("a", "b"):
        pairs = pairs.join(one.select(F.col("tx").alias(s), F.col("words").alias(f"w{s}"), *[F.col(c).alias(f"{short}{s}") for c, short in more.items()]), s)
    return pairs


def verify(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, share) of the pairs of texts that reach the threshold; ``docs``: (tx, words)."""
    return _with_words(pairs, docs, {}).mapInArrow(_shared, "a bigint, b bigint, share double").where(F.col("share") >= threshold)


def align_pairs(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, share, edit_similarity) of the pairs of texts that reach the
    threshold; ``share`` is what the edits prove, or exact where that is too little.
    ``docs``: (tx, words, n3)."""
    full = _with_words(pairs, docs, {"n3": "n"})
    return full.mapInArrow(_verified(threshold), "a bigint, b bigint, share double, edit_similarity double").where(F.col("share") >= threshold)


def similar_texts(df: DataFrame, key: str, text: Column, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members: id, tx; links between different texts: a, b, share, edit_similarity)."""
    table = materialise(sketch_table(df, key, text), "sketches")
    rows = table.where("keys is not null").select("tx", "fp", F.explode("keys").alias("key"))
    pairs = bucket_pairs(rows, "key", "tx", ["fp"])
    pairs = pairs.where(agreeing_fields(F.col("fp_a"), F.col("fp_b")) >= LEAST_FIELDS)
    pairs = pairs.select(F.col("tx_a").alias("a"), F.col("tx_b").alias("b")).distinct()
    links = align_pairs(pairs, table.where("words is not null").select("tx", "words", "n3"), threshold)
    return table.select("id", "tx").distinct(), links


def similar_records(df: DataFrame, key: str, text: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of rows (record_a < record_b) whose texts reach the threshold."""
    members, links = similar_texts(df, key, text, threshold)
    links = materialise(links, "links")
    mine = lambda s: members.select(F.col("id").alias(f"i{s}"), F.col("tx").alias(s))
    linked = links.select("a", "b").join(mine("a"), "a").join(mine("b"), "b").select("ia", "ib")
    # copies of one text are pairs too
    copies = bucket_pairs(members, "tx", "id", []).select(F.col("id_a").alias("ia"), F.col("id_b").alias("ib"))
    both = linked.unionByName(copies)
    return both.select(F.least("ia", "ib").alias("record_a"), F.greatest("ia", "ib").alias("record_b"))


def similar_classes(df: DataFrame, key: str, text: Column, threshold: float = THRESHOLD) -> DataFrame:
    """(record_id, class_id, n_links, edit_similarity): every row with a text with
    the smallest row of its class, the number of other texts its text is linked
    with and the highest edit similarity among these (null without a link).
    Rows linked through others are in one class; copies are not spread to pairs."""
    members, links = similar_texts(df, key, text, threshold)
    links, members = materialise(links, "links"), materialise(members, "members")
    of = connected_components(links, "a", "b")
    both = links.select(F.explode(F.array("a", "b")).alias("tx"), "edit_similarity").groupBy("tx").agg(F.count(F.lit(1)).alias("n_links"), F.max("edit_similarity").alias("edit_similarity"))
    texts_of = members.groupBy("tx").agg(F.min("id").alias("first")).join(of, F.col("tx") == F.col("node"), "left").withColumn("root", F.coalesce("root", "tx"))
    first = texts_of.groupBy("root").agg(F.min("first").alias("class_id"))
    placed = texts_of.join(first, "root").join(both, "tx", "left").select("tx", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.round("edit_similarity", 6).alias("edit_similarity"))
    return members.join(placed, "tx").select(F.col("id").alias("record_id"), "class_id", "n_links", "edit_similarity")


def classes_of_papers(papers: DataFrame) -> DataFrame:
    return similar_classes(papers, "record_id", record_text(F.col("title"), F.col("summary")))


def find_similar_papers(papers: DataFrame) -> DataFrame:
    return similar_records(papers, "record_id", record_text(F.col("title"), F.col("summary")))
