"""Order MinHash sketches of word sequences.

Each of ``sketches`` hash orders samples the ``ell`` smallest occurrence-labelled
k-grams of a text and keeps them in the order of the text (two sketches of five:
of the hashes); the hash of that sequence is a key. Two texts share a key with a probability that rises with
their edit similarity. A fingerprint has three bits of each order's smallest
gram, to turn away unlike texts that share a key by chance.
"""

from __future__ import annotations

import numpy as np

from foliospark.llm.words import gram_rows, mix

SKETCHES = 20  # three bits each fill a long
#: Of five sketches so many keep the order of the text. The others keep the order
#: of the hashes and so also meet where whole sentences have changed places.
ORDERED_OF_FIVE = 3
CELLS = 400_000


def _labelled(h: np.ndarray) -> None:
    """Repeated grams of a row get different values, by occurrence."""
    s = np.sort(h, axis=1)
    for r in np.flatnonzero((s[:, 1:] == s[:, :-1]).any(axis=1)):
        row = h[r]
        order = np.argsort(row, kind="stable")
        first = np.concatenate([[True], row[order][1:] != row[order][:-1]])
        at = np.arange(len(row))
        nth = at - np.maximum.accumulate(np.where(first, at, 0))
        labelled = row[order] + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h[r, order] = labelled


def sketch(words: np.ndarray, offsets: np.ndarray, k: int = 4, ell: int = 3, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """(keys: texts x sketches as int64, fingerprints as int64). Texts without
    words get key 0 everywhere; the caller leaves them out."""
    g, starts = gram_rows(words, offsets, k)
    n = np.diff(starts)
    keys = np.zeros((len(n), sketches), np.uint64)
    prints = np.zeros(len(n), np.uint64)
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * n[order[j]] <= CELLS and n[order[j]] <= 1.15 * n[order[i]] + 4:
            j += 1
        rows = order[i:j]
        width = int(n[rows[-1]])
        at = starts[rows][:, None] + np.arange(width)
        inside = np.arange(width) < n[rows][:, None]
        h = np.where(inside, g[np.minimum(at, len(g) - 1)], np.uint64(0))
        # padding differs by place, so that it is no repeated gram
        h = np.where(inside, h, np.arange(width, dtype=np.uint64) + np.uint64(1))
        _labelled(h)
        lane = np.arange(len(rows))
        for s in range(sketches):
            x = mix(h ^ seeds[s])
            x[~inside] = np.iinfo(np.uint64).max
            picked = np.empty((len(rows), ell), np.int64)
            for e in range(ell):
                p = x.argmin(axis=1)
                picked[:, e] = p
                if e == 0:
                    prints[rows] |= ((x[lane, p] >> np.uint64(20)) & np.uint64(7)) << np.uint64(3 * s)
                x[lane, p] = np.iinfo(np.uint64).max
            if s % 5 < ORDERED_OF_FIVE:
                picked.sort(axis=1)
            key = np.full(len(rows), seeds[s])
            for e in range(ell):
                key = mix((key * np.uint64(0x9E3779B97F4A7C15)) ^ h[lane, picked[:, e]])
            keys[rows, s] = key
        i = j
    return keys.view(np.int64), prints.view(np.int64)
