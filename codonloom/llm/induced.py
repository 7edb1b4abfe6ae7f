"""Suffix arrays by induced sorting, with whole buckets as vectors.

Suffixes are larger (L) or smaller (S) than their right neighbour. Once the leftmost S
suffixes are in order, one sweep up over the symbols places all L suffixes and one sweep
down all S suffixes. A sweep handles a symbol's bucket in waves: a wave's left neighbours
that fall into the same bucket are the next wave.
"""

from __future__ import annotations

import numpy as np

# Reduced strings with more symbols than this are ranked by doubling, as a sweep would
# spend its time on going from symbol to symbol.
_SWEPT_SYMBOLS = 1024


def _smaller(s: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S; the last symbol is a unique smallest one."""
    step = np.sign(np.diff(s))
    known = np.where(step != 0, np.arange(len(step)), len(s))
    following = np.minimum.accumulate(known[::-1])[::-1]
    result = np.ones(len(s), bool)
    inside = following < len(s)
    result[:-1][inside] = step[following[inside]] > 0
    return result


def _deal(found: np.ndarray, s: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    symbols = s[found]
    order = np.argsort(symbols, kind="stable")
    found, symbols = found[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part in np.split(found, cuts):
        if len(part):
            buckets[s[part[0]]].append(part)


def _sweep(s: np.ndarray, smaller: np.ndarray, seeds: list[np.ndarray], symbols: int, up: bool) -> list[np.ndarray]:
    """Per symbol the suffixes of one type in the order met, induced from `seeds` of the other."""
    waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    met = []
    none = np.zeros(0, np.int64)
    for c in range(symbols) if up else range(symbols - 1, -1, -1):
        own, queue = [], np.concatenate(waiting[c]) if waiting[c] else none
        while len(queue):
            own.append(queue)
            left = queue[queue > 0] - 1
            left = left[smaller[left] != up]
            same = s[left] == c
            _deal(left[~same], s, waiting)
            queue = left[same]
        met.append(np.concatenate(own) if own else none)
        left = seeds[c][seeds[c] > 0] - 1
        _deal(left[smaller[left] != up], s, waiting)
    return met if up else met[::-1]


def _induce(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    seeds: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _deal(leftmost, s, seeds)
    none = np.zeros(0, np.int64)
    large = _sweep(s, smaller, [np.concatenate(x) if x else none for x in seeds], symbols, True)
    small = _sweep(s, smaller, [x[::-1] for x in large], symbols, False)
    small[0] = np.array([len(s) - 1])
    return np.concatenate([x for c in range(symbols) for x in (large[c], small[c][::-1])])


def _by_doubling(s: np.ndarray) -> np.ndarray:
    rank, span = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (len(s) + 1)
        key[:-span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(s), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if rank[order[-1]] == len(s) - 1 or span >= len(s):
            return order
        span *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of `s` in order; `s` ends with its only, smallest 0."""
    if len(s) < 3:
        return np.arange(len(s))[::-1].copy()
    symbols, smaller = int(s.max()) + 1, _smaller(s)
    if symbols > _SWEPT_SYMBOLS:
        return _by_doubling(s)
    starts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = _induce(s, smaller, starts, symbols)
    is_start = np.zeros(len(s), bool)
    is_start[starts] = True
    order = order[is_start[order]]
    # Name the substrings from one leftmost S suffix to the next.
    length = np.zeros(len(s), np.int64)
    length[starts] = np.append(np.diff(starts) + 1, 1)
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        left = left[length[a[left]] > k]
        unequal = s[a[left] + k] != s[b[left] + k]
        same[left[unequal]] = False
        left, k = left[~unequal], k + 1
    name = np.zeros(len(s), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    reduced = name[starts]
    if same.any():
        order = starts[suffix_array(reduced)]
    return _induce(s, smaller, order, symbols)


def _words(s: np.ndarray) -> np.ndarray:
    """The eight symbols from each position on, each below 256; zeros behind the end."""
    words = s.astype(np.uint64)
    for shift in (1, 2, 4):
        later = np.zeros(len(s), np.uint64)
        later[:-shift] = words[shift:]
        words = words | later << np.uint64(8 * shift)
    return words


def permuted_lcp(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """At each position, the length of the prefix its suffix shares with the one before it in order.

    Where the symbols left of both suffixes agree, the value is one less than the position
    before has; only the other positions are compared symbol by symbol. Symbols are below 256.
    """
    n = len(s)
    before = np.full(n, n - 1)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] > 0) & (s[:-1] == s[before[1:] - 1]) & (before[:-1] == before[1:] - 1)
    heads = np.flatnonzero(~chained)
    shared, left = np.zeros(n, np.int64), heads[before[heads] != heads]
    for step, values in ((8, _words(s)), (1, s)):  # symbols are compared by eights, then one by one
        going = left
        while len(going):
            a, b = going + shared[going], before[going] + shared[going]
            inside = np.maximum(a, b) + step <= n
            going = going[inside & (values[np.minimum(a, n - 1)] == values[np.minimum(b, n - 1)])]
            shared[going] += step
    base = np.maximum.accumulate(np.where(chained, 0, place))
    return np.maximum(shared[base] - (place - base), 0)
