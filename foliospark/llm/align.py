"""Verification of candidate pairs of word sequences, many pairs at a time."""

from __future__ import annotations

import numpy as np

from foliospark.llm.words import gram_rows


def distinct_grams(words: np.ndarray, offsets: np.ndarray, k: int = 3) -> np.ndarray:
    """Distinct sequences of ``k`` successive words of each text."""
    g, starts = gram_rows(words, offsets, k)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    order = np.lexsort((g, row))
    r, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return np.bincount(r[new], minlength=len(offsets) - 1).astype(np.int32)


def common_share(wa: np.ndarray, oa: np.ndarray, wb: np.ndarray, ob: np.ndarray, k: int = 3) -> np.ndarray:
    """Share of common sequences of ``k`` successive words in all distinct ones,
    exactly, for each pair of rows. Two empty texts have share 0."""
    n = len(oa) - 1
    ga, sa = gram_rows(wa, oa, k)
    gb, sb = gram_rows(wb, ob, k)
    pair = np.concatenate([np.repeat(np.arange(n), np.diff(sa)), np.repeat(np.arange(n), np.diff(sb))])
    side = np.concatenate([np.zeros(len(ga), np.int8), np.ones(len(gb), np.int8)])
    g = np.concatenate([ga, gb])
    order = np.lexsort((side, g, pair))
    p, g, side = pair[order], g[order], side[order]
    if not len(p):
        return np.zeros(n)
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (g[1:] != g[:-1])])
    distinct = np.bincount(p[new], minlength=n)
    first_b = np.concatenate([[False], (side[1:] == 1) & (side[:-1] == 0) & ~new[1:]])
    common = np.bincount(p[first_b], minlength=n)
    return common / np.maximum(distinct, 1)


def banded_edits(wa: np.ndarray, oa: np.ndarray, wb: np.ndarray, ob: np.ndarray, band: int = 12) -> np.ndarray:
    """Fewest word edits (insert, delete, exchange) of each pair within a band
    around the diagonal; pairs are lanes of one dynamic program. Where the
    lengths differ by more than the band, the longer length."""
    n = len(oa) - 1
    la, lb = np.diff(oa), np.diff(ob)
    out = np.maximum(la, lb).astype(np.int64)
    lanes = np.flatnonzero((np.abs(la - lb) <= band) & (la > 0) & (lb > 0))
    for chunk in _by_length(lanes, la):
        out[chunk] = _band(wa, oa[chunk], la[chunk], wb, ob[chunk], lb[chunk], band)
    return out


def _by_length(lanes: np.ndarray, la: np.ndarray, lanes_at_once: int = 2000):
    order = lanes[np.argsort(la[lanes], kind="stable")]
    for i in range(0, len(order), lanes_at_once):
        yield order[i : i + lanes_at_once]


def _band(wa, oa, la, wb, ob, lb, band):
    big = np.int32(1 << 20)
    width, n, rows = 2 * band + 1, len(la), int(la.max())
    d = np.arange(width) - band  # column j = i + d
    prev = np.where(d >= 0, d, big).astype(np.int32)[:, None] + np.zeros((1, n), np.int32)
    done = np.where(la == 0, lb, 0).astype(np.int32)
    for i in range(1, rows + 1):
        a = wa[np.minimum(oa + i - 1, len(wa) - 1)]
        cur = np.full((width, n), big, np.int32)
        for c in range(width):
            j = i + c - band
            if j < 0:
                continue
            if j == 0:
                cur[c] = i
                continue
            b = wb[np.minimum(ob + j - 1, len(wb) - 1)]
            best = prev[c] + (a != b)
            if c + 1 < width:
                best = np.minimum(best, prev[c + 1] + 1)
            if c:
                best = np.minimum(best, cur[c - 1] + 1)
            cur[c] = np.where(j <= lb, best, big)
        ends = np.flatnonzero(la == i)
        done[ends] = cur[(lb - i + band)[ends], ends]
        prev = cur
    return done
