"""Suffix arrays by induced sorting and permuted longest common prefixes, on numpy arrays.

The induced passes are sequential by nature: an entry puts its left neighbour at the head (or tail) of that
neighbour's bucket, where the scan meets it later.  They run here in chunks: all entries up to the
first place that the chunk itself fills are final, so their neighbours are placed in one vector
step, in the order of the scan.  Where such chunks get short, as in long runs of one character, the scan
goes entry by entry for a while.  The string of names is sorted by the same procedure.
"""

from __future__ import annotations

import numpy as np

_SMALL = 48
#: A chunk of fewer entries is slower than as many single steps, and so many single steps follow it.
_SHORT, _STEPS = 96, 2048


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one that follows; the last, the sentinel, counts so."""
    n = len(s)
    out = np.ones(n, np.bool_)
    if n > 1:
        differs = np.flatnonzero(s[1:] != s[:-1])
        nearest = np.searchsorted(differs, np.arange(n - 1))
        at = differs[nearest]  # the sentinel is unique, so one always follows
        out[:-1] = s[at] < s[at + 1]
    return out


def _place(c: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For characters in scan order and their stable sort: rank of each among its equals, the characters, their counts."""
    ordered = c[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(first, len(ordered)))
    rank = np.empty(len(c), np.int64)
    rank[order] = np.arange(len(c)) - np.repeat(first, counts)
    return rank, ordered[first], counts


def _steps(sa: np.ndarray, s: np.ndarray, smaller: np.ndarray, free: np.ndarray, at: int, stop: int, forward: bool) -> None:
    """The scan from ``at`` to ``stop``, entry by entry."""
    way = 1 if forward else -1
    for k in range(at, stop, way):
        left = sa.item(k) - 1
        if left >= 0 and smaller.item(left) != forward:
            c = s.item(left)
            place = free.item(c)
            sa[place] = left
            free[c] = place + way


def _induce(sa: np.ndarray, s: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """Fill L-type suffixes from left to right, then S-type ones from right to left."""
    n = len(s)
    for forward in (True, False):
        free = starts.copy() if forward else ends.copy() - 1
        if not forward:  # the S-type seeds go; all but the sentinel are found again
            filled = sa >= 0
            filled[filled] = smaller[sa[filled]]
            filled[0] = False
            sa[filled] = -1
        at, size = (0 if forward else n - 1), 1 << 15
        while 0 <= at < n:
            if forward:
                stop = min(n, at + size)
                chunk = sa[at:stop]
            else:
                stop = max(-1, at - size)
                chunk = sa[stop + 1 : at + 1][::-1]
            where = np.flatnonzero(chunk > 0)
            left = chunk[where] - 1
            keep = smaller[left] != forward
            where, left = where[keep], left[keep]
            if not len(left):
                at, size = stop, min(size * 2, 1 << 17)
                continue
            c = s[left]
            order = np.argsort(c, kind="stable")
            rank, chars, counts = _place(c, order)
            target = free[c] + rank if forward else free[c] - rank
            inside = target[target < stop] if forward else target[target > stop]
            if len(inside):
                cut = int(inside.min()) if forward else int(inside.max())
                done = where < (cut - at if forward else at - cut)
                if not done.all():
                    left, target, c = left[done], target[done], c[done]
                    chars, counts = np.unique(c, return_counts=True)
                size = max(64, 2 * abs(cut - at))
                stop = cut
                if abs(cut - at) < _SHORT:
                    stop = min(n, at + _STEPS) if forward else max(-1, at - _STEPS)
                    _steps(sa, s, smaller, free, at, stop, forward)
                    at, size = stop, 1 << 12
                    continue
            else:
                size = min(size * 2, 1 << 17)
            sa[target] = left
            free[chars] += counts if forward else -counts
            at = stop


def _equal(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether s[a:a+length] equals s[b:b+length], for each of many."""
    out = np.ones(len(a), np.bool_)
    live, k = np.arange(len(a)), 0
    while len(live):
        same = s[a[live] + k] == s[b[live] + k]
        out[live[~same]] = False
        k += 1
        live = live[same]
        live = live[length[live] > k]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text``, integers of 0 or more, in lexicographic order."""
    return _sort(np.append(text.astype(np.int32) + 1, np.int32(0)))[1:]


def _sort(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s``, which ends in a 0 that stands nowhere else."""
    n = len(s)
    if n <= _SMALL:
        values = s.tolist()
        return np.array(sorted(range(n), key=lambda i: values[i:]), np.int32)
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sizes = np.bincount(s)
    ends = np.cumsum(sizes)
    starts = ends - sizes

    def seeded(order: np.ndarray) -> np.ndarray:
        """Only LMS suffixes, sorted by their first character at least, at the tails of their buckets."""
        sa = np.full(n, -1, np.int32)
        c = s[order]
        number = np.bincount(c, minlength=len(sizes))
        before = np.cumsum(number) - number
        sa[ends[c] - number[c] + np.arange(len(order)) - before[c]] = order
        return sa

    sa = seeded(lms[np.argsort(s[lms], kind="stable")])
    _induce(sa, s, smaller, starts, ends)
    is_lms = np.zeros(n, np.bool_)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    length = np.zeros(n, np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    same[same] = _equal(s, a[same], b[same], length[a[same]])
    name = np.concatenate(([0], np.cumsum(~same)))
    if name[-1] + 1 < len(lms):
        named = np.zeros(n, np.int32)
        named[ordered] = name
        ordered = lms[_sort(named[lms])]  # the sentinel's name is 0 and stands last
    sa = seeded(ordered)
    _induce(sa, s, smaller, starts, ends)
    return sa


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, by its start, the length it shares with the suffix before it in ``sa``.

    Where the characters before both suffixes agree, the value is one less than that of the
    preceding start.  Only the others are compared, eight bytes at a time; ``text`` is of bytes.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    reducible = np.zeros(n, np.bool_)
    inner = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    reducible[inner] = text[inner - 1] == text[before[inner] - 1]
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    eight = np.zeros(n + 8, np.uint64)
    for r in range(8):
        view = padded[r : r + (n + 8 - r) // 8 * 8].view(np.uint64)
        eight[r::8][: len(view)] = view
    a = np.flatnonzero(~reducible & (before >= 0))
    b = before[a]
    room = n - np.maximum(a, b)
    shared = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x = eight[a[live] + shared[live]] ^ eight[b[live] + shared[live]]
        low = x & (~x + np.uint64(1))
        agree = np.full(len(live), 8, np.int64)
        some = x > 0
        agree[some] = np.log2(low[some].astype(np.float64)).astype(np.int64) // 8
        shared[live] += agree
        live = live[(agree == 8) & (shared[live] < room[live])]
    plcp = np.zeros(n, np.int64)
    plcp[a] = np.minimum(shared, room)
    anchor = np.where(reducible, 0, np.arange(n))
    anchor = np.maximum.accumulate(anchor)
    return np.where(reducible, plcp[anchor] - (np.arange(n) - anchor), plcp)
