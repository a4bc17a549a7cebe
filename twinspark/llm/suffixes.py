"""Suffix arrays by induced sorting, and permuted common prefixes, in NumPy."""

from __future__ import annotations

import numpy as np

from .batches import powers

#: Alphabets up to this are induced bucket by bucket in NumPy, larger ones position by position.
SMALL = 1024


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last symbol is the only least one."""
    n = len(s)
    out = np.ones(n, bool)
    change = np.flatnonzero(s[:-1] != s[1:])
    out[:-1] = (s[change] < s[change + 1])[np.searchsorted(change, np.arange(n - 1))]
    return out


def _induced_waves(s, smaller, lms, size):
    n = len(s)
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int32)
    lms = lms[np.argsort(s[lms], kind="stable")]
    c = s[lms]
    own = np.bincount(c, minlength=size)
    sa[ends[c] - own[c] + np.arange(len(lms)) - (np.cumsum(own) - own)[c]] = lms
    used = np.flatnonzero(counts)

    def grouped(p):
        ch = s[p]
        order = np.argsort(ch, kind="stable")
        p, ch = p[order], ch[order]
        new = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
        return p, ch, np.arange(len(p)) - np.repeat(new, np.diff(np.append(new, len(p)))), ch[new], np.diff(np.append(new, len(p)))

    at = starts.copy()

    def larger(block):
        p = block[block > 0] - 1
        p = p[~smaller[p]]
        if len(p):
            p, ch, rank, chars, k = grouped(p)
            sa[at[ch] + rank] = p
            at[chars] += k

    for b in used:
        done = starts[b]
        while done < at[b]:
            block, done = sa[done : at[b]], at[b]
            larger(block)
        if own[b]:
            larger(sa[ends[b] - own[b] : ends[b]])
    left = at.copy()
    at = ends.copy()

    def lesser(block):
        p = block[block > 0] - 1
        p = p[smaller[p]]
        if len(p):
            p, ch, rank, chars, k = grouped(p)
            sa[at[ch] - 1 - rank] = p
            at[chars] -= k

    for b in used[::-1]:
        done = ends[b]
        while at[b] < done:
            block, done = sa[at[b] : done][::-1], at[b]
            lesser(block)
        if left[b] > starts[b]:
            lesser(sa[starts[b] : left[b]][::-1])
    return sa


def _induced_steps(s, smaller, lms, size):
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    head, tail = (ends - counts).tolist(), ends.tolist()
    s, small = s.tolist(), smaller.tolist()
    sa = [-1] * len(s)
    at = list(tail)
    for p in reversed(lms.tolist()):
        at[s[p]] -= 1
        sa[at[s[p]]] = p
    for i in range(len(sa)):
        p = sa[i] - 1
        if p >= 0 and not small[p]:
            c = s[p]
            sa[head[c]] = p
            head[c] += 1
    at = list(tail)
    for i in range(len(sa) - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and small[p]:
            c = s[p]
            at[c] -= 1
            sa[at[c]] = p
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Of s (int64) whose last symbol, 0, occurs nowhere else; symbols are below size."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = smaller_types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induced = _induced_waves if size <= SMALL else _induced_steps
    sa = induced(s, smaller, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # names: substrings from one leftmost-smaller place to the next are equal if their hashes and lengths are
    base = 0xD1342543DE82EF95
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * powers(base, n), out=total[1:])
    end = np.append(lms[1:] + 1, n)
    h = (total[end] - total[lms]) * powers(pow(base, -1, 1 << 64), n)[lms]
    rank = np.searchsorted(lms, order)
    h, width = h[rank], (end - lms)[rank]
    name = np.concatenate([[0], np.cumsum((h[1:] != h[:-1]) | (width[1:] != width[:-1]))])
    if name[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[rank] = name
        order = lms[suffix_array(reduced, int(name[-1]) + 1)]
    return induced(s, smaller, order, size)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix, by position, with the suffix before it in order.

    Where the symbols before both are equal it is one less than that of the position before (reducible);
    only the others are compared.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    hard = (at == 0) | (before <= 0) | (s[at - 1] != s[before - 1])
    i = np.flatnonzero(hard & (before >= 0))
    plcp = np.zeros(n, np.int64)
    a, b = i.copy(), before[i].copy()
    live = np.arange(len(i))
    while len(live):
        live = live[(a[live] < n) & (b[live] < n)]
        live = live[s[a[live]] == s[b[live]]]
        a[live] += 1
        b[live] += 1
    plcp[i] = a - i
    last = np.maximum.accumulate(np.where(hard, at, 0))
    return np.maximum(plcp[last] - (at - last), 0)
