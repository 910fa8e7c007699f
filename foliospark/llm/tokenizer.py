"""Problem 7: the whole corpus as ids of a public byte-level BPE tokenizer.

A text is cut by the tokenizer's pattern; each piece is encoded once per worker
and remembered. Encoding walks a piece from left to right with the longest token
that starts there, going back to shorter ones where a token cannot stand next to
the one before it. Whether two tokens can stand side by side (that merging their
bytes by rank gives just these two) is found by taking both apart along their
last merges, and remembered. Tokens at all places come from one Aho-Corasick
pass over the piece's bytes as Latin-1 text. The result is that of the merges.

Defined results: an empty and a null text give an empty list; a null key gives a
row with a null key; repeated rows stay repeated; bytes that are no UTF-8 become
U+FFFD first; one very long piece costs time in proportion to its length.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces kept in a worker's memory.
REMEMBERED = 1 << 18

# Fixed value: the pattern that cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BytePairEncoder:
    """Encoder over ranks: ``{token bytes: id}``, ids in the order of merging."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        import regex

        self._cut = regex.compile(PATTERN).findall
        self._bytes: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self._finder = ahocorasick.Automaton()
        for b, i in ranks.items():
            self._finder.add_word(b.decode("latin-1"), i)
        self._finder.make_automaton()
        self._length = {i: len(b) for i, b in self._bytes.items()}
        #: next shorter token that a token begins with
        self._shorter: dict[int, int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._merged: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}
        for i in sorted(self._bytes):
            b = self._bytes[i]
            for n in range(len(b) - 1, 0, -1):
                if (s := ranks.get(b[:n])) is not None:
                    self._shorter[i] = s
                    break
        for i in sorted(self._bytes):
            if self._length[i] > 1:
                self._take_apart(i, self._bytes[i], ranks)
        self._fits.clear()  # what was found before all merges were known

    def _take_apart(self, i: int, b: bytes, ranks: dict[bytes, int]) -> None:
        """Find the last merge of token ``i``."""
        left = self._shorter.get(i)
        while left is not None:
            right = ranks.get(b[self._length[left] :])
            if left < i and right is not None and right < i and self._adjacent(left, right):
                self._parts[i] = (left, right)
                self._merged[left, right] = i
                return
            left = self._shorter.get(left)

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether merging bytes(a) + bytes(b) by rank can end with a, b.

        The merges inside a and inside b are undone from the latest back; if a
        merge across the border exists at some stage and ranks before the step
        undone last, it would have come first, and a, b is impossible.
        """
        before = 1 << 62
        while True:
            m = self._merged.get((a, b))
            if m is not None and m < before:
                return False
            if a > b:  # undo the later merge of the two; of equals the right one
                before = a
                if a in self._parts:
                    a = self._parts[a][1]
                    continue
                if b not in self._parts:
                    return True
                before, b = b + 1, self._parts[b][0]
            else:
                before = b + 1
                if b in self._parts:
                    b = self._parts[b][0]
                    continue
                if a not in self._parts:
                    return True
                before, a = a, self._parts[a][1]

    def _can_follow(self, a: int, b: int) -> bool:
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= 4 * REMEMBERED:
                self._fits.clear()
            known = self._fits[a, b] = self._adjacent(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        n, length = len(piece), self._length
        longest = [0] * n
        best = [-1] * n
        for end, token in self._finder.iter(piece.decode("latin-1")):
            start = end + 1 - length[token]
            if length[token] > longest[start]:
                longest[start], best[start] = length[token], token
        open_ends = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, best[0] if n else -1
        while at < n:
            while token >= 0 and not (open_ends[at + length[token]] and (not out or self._can_follow(out[-1], token))):
                token = self._shorter.get(token, -1)
            if token >= 0:
                out.append(token)
                at += length[token]
                token = best[at] if at < n else -1
            else:
                open_ends[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self._pieces
        for piece in self._cut(text):
            found = known.get(piece)
            if found is None:
                found = self.encode_piece(piece.encode("utf-8"))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = found
            ids += found
        return ids


@functools.lru_cache(maxsize=2)
def load_encoder(path: str) -> BytePairEncoder:
    """The encoder of a file of lines "base64 id", once per worker."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer file at {path}; give its place as vocabulary_path")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(i) for a, i in (line.split() for line in lines if line.strip())}
    return BytePairEncoder(ranks)


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, ids): the ids of each text, without special tokens."""

    name = os.path.basename(vocabulary_path)
    if os.path.exists(vocabulary_path):  # the driver's file goes to all workers
        docs.sparkSession.sparkContext.addFile(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = SparkFiles.get(name)
        encode = load_encoder(sent if os.path.exists(sent) else vocabulary_path).encode
        for b in batches:
            ids = [encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.make_valid_utf8(F.col(text)).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")
