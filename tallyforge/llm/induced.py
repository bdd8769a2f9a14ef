"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy.

Suffixes are classified as smaller or larger than their successors; the leftmost smaller ones are sorted by their substrings, named,
and the string of names is sorted recursively; all others are induced from them in one pass from the left and one from the right.
The passes go bucket by bucket: what a bucket induces into later ones moves as one array, what it induces into itself (runs of a
symbol) in rounds. Where names need so many buckets that arrays would be tiny, the same passes go place by place over plain arrays.
All steps are linear, at every level of the recursion."""

from __future__ import annotations

from array import array

import numpy as np

#: With more symbols than this the passes go place by place.
WIDE = 1024


def smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last is larger: it is followed by the end)."""
    n = len(s)
    out = np.zeros(n, bool)
    if n > 1:
        step = np.sign(s[1:].astype(np.int64) - s[:-1])
        at = np.where(step != 0, np.arange(n - 1), n)
        nxt = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbol changes
        out[:-1] = (nxt < n) & (step[np.minimum(nxt, n - 2)] > 0)
    return out


def _push(found: np.ndarray, s: np.ndarray, to: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Put suffixes at the edges of their symbols' buckets in the given order, and move the edges."""
    c = s[found]
    order = np.argsort(c, kind="stable")
    c = c[order]
    heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    n = np.diff(np.append(heads, len(c)))
    at = np.arange(len(c)) - np.repeat(heads, n)
    to[edge[c] + step * at] = found[order]
    edge[c[heads]] += step * n


def induce(s: np.ndarray, is_small: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost smaller ones in the order given (of suffixes, or by first symbol of substrings)."""
    n, k = len(s), len(sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # the end of the string induces the last suffix, which is larger, first of its bucket
    larger = np.bincount(s[~is_small], minlength=k)
    sa = np.full(n, -1, np.int64)
    edge = begins.copy()
    _push(np.array([n - 1]), s, sa, edge, 1)
    own = np.bincount(s[lms], minlength=k)
    mine = lms[np.argsort(s[lms], kind="stable")]
    first = np.cumsum(own) - own
    for c in np.flatnonzero(sizes):
        done = begins[c]
        while done < edge[c]:  # the larger ones of this bucket, in rounds
            batch = sa[done : edge[c]]
            done = edge[c]
            before = batch[batch > 0] - 1
            before = before[~is_small[before]]
            if len(before):
                _push(before, s, sa, edge, 1)
        if own[c]:
            batch = mine[first[c] : first[c] + own[c]]
            _push(batch[batch > 0] - 1, s, sa, edge, 1)
    edge = ends - 1
    for c in np.flatnonzero(sizes)[::-1]:
        done = ends[c] - 1
        while done > edge[c]:
            batch = sa[edge[c] + 1 : done + 1][::-1]
            done = edge[c]
            before = batch[batch > 0] - 1
            before = before[is_small[before]]
            if len(before):
                _push(before, s, sa, edge, -1)
        batch = sa[begins[c] : begins[c] + larger[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[is_small[before]]
        if len(before):
            _push(before, s, sa, edge, -1)
    return sa


def induce_by_place(s: np.ndarray, is_small: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As induce, one place after the other, over plain arrays."""
    n = len(s)
    ends = np.cumsum(sizes)
    symbol, small = array("i", s.astype(np.int32).tobytes()), is_small.tobytes()  # four bytes and one for each place, not an object
    begin, end = (ends - sizes).tolist(), (ends - 1).tolist()
    sa = array("i", [-1]) * n
    for i in reversed(lms.tolist()):
        c = symbol[i]
        sa[end[c]] = i
        end[c] -= 1
    c = symbol[n - 1]
    sa[begin[c]] = n - 1
    begin[c] += 1
    for k in range(n):  # grows ahead of k
        i = sa[k] - 1
        if i >= 0 and not small[i]:
            c = symbol[i]
            sa[begin[c]] = i
            begin[c] += 1
    end = (ends - 1).tolist()
    for k in range(n - 1, -1, -1):
        i = sa[k] - 1
        if i >= 0 and small[i]:
            c = symbol[i]
            sa[end[c]] = i
            end[c] -= 1
    return np.frombuffer(sa, np.int32).astype(np.int64)


def _names(s: np.ndarray, order: np.ndarray, lms: np.ndarray, is_lms: np.ndarray) -> np.ndarray:
    """Numbers of the leftmost smaller substrings, in the order of their places: equal ones have equal numbers."""
    n = len(s)
    nxt = np.full(n + 1, n, np.int64)
    nxt[lms[:-1]] = lms[1:]
    length = np.minimum(nxt[order] + 1, n) - order  # with the symbol of the next one
    last = nxt[order] == n  # the string's end: unlike any other
    new = np.ones(len(order), bool)
    same = np.flatnonzero((length[1:] == length[:-1]) & ~last[1:] & ~last[:-1]) + 1
    t = 0
    while len(same):
        a, b = order[same] + t, order[same - 1] + t
        same = same[s[a] == s[b]]
        full = length[same] == t + 1
        new[same[full]] = False
        same = same[~full]
        t += 1
    names = np.empty(n, np.int64)
    names[order] = np.cumsum(new) - 1
    return names[lms]


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array of a string over 0..symbols-1; a suffix that ends is smaller."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    by = induce if symbols <= WIDE else induce_by_place
    is_small = smaller(s)
    is_lms = is_small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~is_small[:-1]
    lms = np.flatnonzero(is_lms)
    sizes = np.bincount(s, minlength=symbols)
    sa = by(s, is_small, sizes, lms)
    if not len(lms):
        return sa
    order = sa[is_lms[sa]]
    names = _names(s, order, lms, is_lms)
    if names.max() + 1 < len(lms):
        order = lms[suffix_array(names, int(names.max()) + 1)]
    return by(s, is_small, sizes, order)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the symbols that its suffix has in common with the one before it in the suffix array (0 for the first).

    Only places whose preceding symbol differs from that of their neighbour (irreducible ones) are compared, four symbols at a time;
    along the string all others have one less than the place before."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    has = phi >= 0
    hard = has & ((at == 0) | (phi == 0) | (s[at - 1] != s[np.maximum(phi, 1) - 1]))
    padded = np.concatenate([s.astype(np.uint16), np.zeros(8, np.uint16)])
    word = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (n + 4, 4), (2, 2))).view("<u8")[:, 0]
    j = np.flatnonzero(hard)
    most = n - np.maximum(j, phi[j])
    got = np.zeros(len(j), np.int64)
    on = np.arange(len(j))
    while len(on):
        diff = word[j[on] + got[on]] ^ word[phi[j[on]] + got[on]]
        same = np.full(len(on), 4)
        odd = np.flatnonzero(diff)
        low = diff[odd] & (~diff[odd] + np.uint64(1))
        same[odd] = np.log2(low.astype(np.float64)).astype(np.int64) >> 4
        got[on] += same
        on = on[(same == 4) & (got[on] < most[on])]
    plcp = np.zeros(n, np.int64)
    plcp[j] = np.minimum(got, most)
    known = np.maximum.accumulate(np.where(hard, at, -1))
    rest = np.flatnonzero(has & ~hard)
    plcp[rest] = plcp[known[rest]] - (rest - known[rest])
    return plcp
