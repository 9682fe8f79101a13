"""Suffix arrays by induced sorting, and permuted common prefixes, on arrays."""

from __future__ import annotations

import numpy as np

# Strings of more symbols are ranked by doubling: the reduced strings of the recursion have
# nearly as many names as places, and going through them bucket by bucket gains nothing.
LARGE_ALPHABET = 1 << 10


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes in order, for numbers below ``symbols``; a prefix comes first.

    Suffixes are classed as smaller (S) or larger (L) than their successor. The leftmost S
    of each run are sorted by their substrings, which are named and sorted recursively where
    names repeat; from them all L, and from those all S, are induced. Buckets are worked
    through in order, a whole bucket's suffixes at a time.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    if symbols > LARGE_ALPHABET:
        return by_doubling(s)
    s = s.astype(np.uint8 if symbols <= 256 else np.uint16)
    is_s = _smaller(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        first = lms[np.argsort(s[lms], kind="stable")]
        marked = np.zeros(n, bool)
        marked[lms] = True
        induced = _induce(s, symbols, is_s, first)
        ordered = induced[marked[induced]]
        names, count = _names(s, lms, ordered)
        if count < len(lms):
            ordered = lms[suffix_array(names, count)]
    else:
        ordered = lms
    return _induce(s, symbols, is_s, ordered)


def _smaller(s: np.ndarray) -> np.ndarray:
    """S types: the next different symbol is larger. The end counts as smallest."""
    n = len(s)
    differs = np.append(s[1:] != s[:-1], False)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    known = at < n
    up = np.zeros(n, bool)
    up[known] = s[at[known] + 1] > s[at[known]]
    return up


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the substrings from each leftmost S to the next, in text order."""
    size = np.zeros(len(s), np.int64)
    size[lms[:-1]] = np.diff(lms) + 1  # the last one ends with the text and equals no other
    a, b = ordered[:-1], ordered[1:]
    open_ = np.flatnonzero((size[a] == size[b]) & (size[a] > 0))
    same = np.zeros(len(a), bool)
    step = 0
    while len(open_):
        done = size[a[open_]] == step
        same[open_[done]] = True
        open_ = open_[~done]
        open_ = open_[s[a[open_] + step] == s[b[open_] + step]]
        step += 1
    name = np.zeros(len(s), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms], int(name[ordered[-1]]) + 1


def _induce(s: np.ndarray, symbols: int, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(s)
    counts = np.bincount(s, minlength=symbols)
    end = np.cumsum(counts)
    begin = end - counts
    present = np.flatnonzero(counts).tolist()
    sa = np.empty(n, np.int64)
    bounds = np.searchsorted(s[lms], np.arange(symbols + 1))
    head = begin.copy()

    def runs(p: np.ndarray) -> tuple:
        symbol = s[p]
        order = np.argsort(symbol, kind="stable")
        p, symbol = p[order], symbol[order]
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        size = np.diff(np.append(first, len(p)))
        return p, symbol, np.arange(len(p)) - np.repeat(first, size), symbol[first], size

    def larger(batch: np.ndarray) -> None:
        p = batch[batch > 0] - 1
        p = p[~is_s[p]]
        if len(p):
            p, symbol, place, own, size = runs(p)
            sa[head[symbol] + place] = p
            head[own] += size

    sa[head[s[n - 1]]] = n - 1
    head[s[n - 1]] += 1
    for c in present:
        at = begin[c]
        while at < head[c]:
            upto = head[c]
            larger(sa[at:upto])
            at = upto
        larger(lms[bounds[c] : bounds[c + 1]])
    tail = end.copy()

    def smaller(batch: np.ndarray) -> None:
        p = batch[batch > 0] - 1
        p = p[is_s[p]]
        if len(p):
            p, symbol, place, own, size = runs(p)
            sa[tail[symbol] - 1 - place] = p
            tail[own] -= size

    for c in reversed(present):
        at = end[c]
        while tail[c] < at:
            down = tail[c]
            smaller(sa[down:at][::-1])
            at = down
        smaller(sa[begin[c] : head[c]][::-1])
    return sa


def by_doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array by ranks of pairs of ranks."""
    n, step = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:]
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[1], (np.diff(pair[order]) != 0).astype(np.int64)])
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n:
            return order
        step *= 2


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each place, how many symbols (up to ``limit``) it shares with the suffix before it.

    In text order, eight symbols of one byte at a time.
    """
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([s.astype(np.uint8), np.zeros(limit + 16, np.uint8)])
    eight = padded.astype(np.uint64)
    for size in (1, 2, 4):
        eight = (eight[:-size] << np.uint64(8 * size)) | eight[size:]
    common = np.zeros(n, np.int64)
    at = np.flatnonzero(before >= 0)
    while len(at):
        i, j = at + common[at], before[at] + common[at]
        differ = eight[i] ^ eight[j]
        equal = differ == 0
        rest = differ[~equal]
        partly = np.zeros(len(rest), np.int64)
        for k in range(1, 8):
            partly += (rest >> np.uint64(8 * (8 - k))) == 0
        common[at[~equal]] += partly
        at = at[equal]
        common[at] += 8
        at = at[common[at] < limit]
    return np.minimum(np.minimum(common, limit), np.minimum(n - np.arange(n), n - before))
