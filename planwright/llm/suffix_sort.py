"""Induced suffix sorting with common-prefix values, over buckets that may lie on disk.

Suffixes are sorted the way of induced sorting: positions where a rising run begins (S*) are named
by the substring up to the next one, the names form a string a third as long that is sorted
recursively, and all other suffixes are induced from those in two sweeps - falling ones (L) from
small to large, rising ones (S) from large to small. A sweep is a monotone priority queue: an
induced suffix enters the bucket of its first symbol, behind those that are there, and buckets are
emptied in the order of the sweep. What enters carries the common prefix with the entry before it:
one more than the smallest value among the suffixes taken out between the two that induced them.

Names are symbols like bytes, however many there are: neighbouring buckets leave the queue together
as long as none of them is still to receive something from another one, about twice the square root of
all entries at a time. So a step is a few array operations on every level of the recursion.

Queues are arrays that grow bucket by bucket; beyond ``memory`` bytes they, the text, the types and
the names are files mapped into memory (task-private scratch, unlinked as soon as they are open).
Values stop at ``cap``.
"""

from __future__ import annotations

import tempfile

import numpy as np


class Scratch:
    """Arrays in memory up to a budget, in unlinked files beyond it."""

    def __init__(self, memory: int):
        self.memory, self.used, self.files, self.depth = memory, 0, 0, 0

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if n == 0 or self.used + size <= self.memory:
            self.used += size
            return np.zeros(n, kind)
        self.files += 1
        with tempfile.TemporaryFile() as f:
            f.truncate(size)
            return np.memmap(f, kind, "r+", shape=(n,))


    def kept(self, x: np.ndarray) -> np.ndarray:
        """``x``, or a copy of it in a file if it is beyond the budget."""
        files = self.files
        out = self.array(len(x), x.dtype)
        if self.files == files:
            return x
        out[:] = x
        return out


def _types(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each position whether it is S (a rising or, at the end, the last one), and the length of
    the run of its symbol that begins there."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])  # ends of runs
    ends = np.append(change, n - 1)
    rises = np.append(s[change] < s[change + 1], True)  # the last run counts as rising
    sizes = np.diff(np.append(-1, ends))
    return np.repeat(rises, sizes), (np.repeat(ends, sizes) - np.arange(n) + 1)


def _common(s: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Symbols that the suffixes at a and b share, up to cap."""
    out = np.zeros(len(a), np.int64)
    alive, n = np.arange(len(a)), len(s)
    for k in range(cap):
        x, y = a[alive] + k, b[alive] + k
        ok = (x < n) & (y < n)
        ok[ok] = s[x[ok]] == s[y[ok]]
        alive = alive[ok]
        if not len(alive):
            break
        out[alive] += 1
    return out


def _names(s: np.ndarray, rising: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Rank of the substring from each S* to the next, compared by symbol, then by type."""
    m = len(stars)
    length = np.append(np.diff(stars) + 1, 1)
    bits = int(s.max()).bit_length() + 2
    per = max(1, 62 // bits)
    rank, at = np.zeros(m, np.int64), 0  # how many are in smaller groups
    some = np.arange(m)  # what is in a group with others of which one goes on
    while len(some):
        key, long = np.zeros(len(some), np.int64), length[some]
        for k in range(at, at + per):
            inside = np.flatnonzero(k < long)
            p = stars[some[inside]] + k
            key <<= bits
            key[inside] |= (s[p].astype(np.int64) << 1 | rising[p]) + 1
        order = np.lexsort((key, rank[some])) if at else np.argsort(key, kind="stable")
        some, key = some[order], key[order]
        r = rank[some]
        new = np.r_[True, r[1:] != r[:-1]]
        fine = new | np.r_[True, key[1:] != key[:-1]]
        begin, sub = np.flatnonzero(new), np.flatnonzero(fine)
        sizes = np.diff(np.append(sub, len(some)))
        offset = sub - begin[np.searchsorted(begin, sub, "right") - 1]
        rank[some] = r + np.repeat(offset, sizes)
        at += per
        goes_on = np.logical_or.reduceat(length[some] > at, sub)
        some = some[np.repeat((sizes > 1) & goes_on, sizes)]
    return np.unique(rank, return_inverse=True)[1]


class _Sweep:
    """One induction: bucket queues of suffixes of one type, emptied in the order of the buckets
    (``up``: ascending)."""

    def __init__(self, s: np.ndarray, wanted: np.ndarray, symbols: int, cap: int, scratch: Scratch, up: bool):
        counts = np.bincount(s[wanted], minlength=symbols)
        self.begin = scratch.kept(np.concatenate([[0], np.cumsum(counts)]))
        self.head = scratch.kept(self.begin[:-1].copy())
        self.pos, self.lcp = scratch.array(int(self.begin[-1]), np.int64), scratch.array(int(self.begin[-1]), np.uint8)
        # Of each symbol the step of its last entry (-1: none yet) and the least value after it in that
        # step; of each step the least value from it on.
        self.step, self.after = scratch.kept(np.full(symbols, -1)), scratch.array(symbols, np.uint8)
        self.least, self.steps = np.full(1024, cap, np.uint8), 0
        self.s, self.wanted, self.cap, self.up = s, wanted, cap, up

    def bucket(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        return self.pos[self.begin[c] : self.head[c]], self.lcp[self.begin[c] : self.head[c]]

    def targets(self, pos: np.ndarray) -> np.ndarray:
        """Symbols of the buckets that suffixes put something in; -1: none."""
        before = pos - 1
        ok = before >= 0
        ok[ok] = self.wanted[before[ok]]
        out = np.full(len(pos), -1, np.int64)
        out[ok] = self.s[before[ok]]
        return out

    def empty(self, c: int) -> None:
        """Take out bucket c; what it induces into itself comes out in the same go."""
        at = self.begin[c]
        while at < self.head[c]:
            to = self.head[c]
            self.take(np.array(self.pos[at:to]), np.array(self.lcp[at:to]))
            at = to

    def take(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Suffixes in the order of the sweep; lcp: with the one taken out before."""
        if not len(pos):
            return
        now = self.steps
        if now == len(self.least):
            self.least = np.concatenate([self.least, np.full(now, self.cap, np.uint8)])
        least = min(int(lcp.min()), self.cap)
        target = self.targets(pos)
        idx = np.flatnonzero(target >= 0)
        if len(idx):
            d = target[idx]
            order = np.argsort(d, kind="stable")
            idx, d = idx[order], d[order]
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            last = np.append(first[1:], len(d)) - 1
            value = np.empty(len(d), np.int64)
            mins = _RangeMin(lcp)
            if len(first) < len(d):
                inner = np.ones(len(d), bool)
                inner[first] = False
                inner = np.flatnonzero(inner)
                value[inner] = mins(idx[inner - 1] + 1, idx[inner])
            symbols = d[first]
            # Since the last entry: what came after it in its step, whole steps, and this one so far.
            known = self.step[symbols]
            since = np.where(known + 1 < now, self.least[np.minimum(known + 1, max(now - 1, 0))], self.cap)
            since = np.minimum(np.minimum(since, self.after[symbols]), np.minimum.accumulate(lcp)[idx[first]]).astype(np.int64)
            value[first] = np.where(known >= 0, since, -1)
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.cap)[idx[last] + 1]
            self.step[symbols] = now
            self.after[symbols] = after
            sizes = last - first + 1
            to = np.repeat(self.head[symbols] - first, sizes) + np.arange(len(d))
            self.pos[to] = pos[idx] - 1
            self.lcp[to] = np.minimum(value + 1, self.cap)
            self.head[symbols] += sizes
        self.least[now] = least
        np.minimum(self.least[:now], least, out=self.least[:now])
        self.steps += 1


class _RangeMin:
    """Minima of ranges of an array, by a table of powers of two as deep as the longest range."""

    def __init__(self, x: np.ndarray):
        self.table = [x]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(x[a : b + 1]) for ranges that are not empty."""
        if not len(a):
            return np.zeros(0, np.int64)
        depth = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        while len(self.table) <= depth.max():
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))
        out = np.empty(len(a), np.int64)
        for k in np.unique(depth):
            own = depth == k
            t = self.table[k]
            out[own] = np.minimum(t[a[own]], t[b[own] - (1 << int(k)) + 1])
        return out


def suffix_order(s: np.ndarray, cap: int, scratch: Scratch | None = None, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``s`` in order, and of each the common prefix with the one before it, up to
    ``cap`` (at most 254); suffixes that agree in their first ``cap`` symbols may stand in any
    order. The last symbol of ``s`` is smaller than all others."""
    scratch = scratch or Scratch(1 << 62)
    scratch.depth = max(scratch.depth, depth)
    n = len(s)
    if n < 3 or cap < 2:
        order = np.argsort(s, kind="stable").astype(np.int64)
        return order, np.r_[False, s[order[1:]] == s[order[:-1]]][:n].astype(np.uint8) * np.uint8(min(cap, 1) if n > 2 else 0)
    symbols = int(s.max()) + 1
    rising, run = _types(s)
    rising, run = scratch.kept(rising), scratch.kept(np.minimum(run, cap).astype(np.uint8))
    stars = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    m = len(stars)
    names = scratch.kept(_names(s, rising, stars)) if m else np.zeros(0, np.int64)
    if m and int(names.max()) + 1 < m:
        # A name stands for two symbols at least, so half as many names tell suffixes apart.
        inner, same = suffix_order(names, cap // 2 + 1 if cap > 3 else cap - 1, scratch, depth + 1)
    else:
        inner, same = np.argsort(names).astype(np.int64), np.zeros(m, np.uint8)
    sorted_stars = scratch.kept(stars[inner]) if m else stars
    # Of neighbours among the S*: the symbols of the names they share, then those of the next names.
    shared = scratch.array(m, np.uint8)
    if m > 1:
        a, k = inner[:-1], same[1:].astype(np.int64)
        skip = stars[np.minimum(a + k, m - 1)] - stars[a]
        near = np.flatnonzero(skip < cap)
        shared[1:] = np.minimum(skip, cap)
        rest = _common(s, sorted_stars[:-1][near] + skip[near], sorted_stars[1:][near] + skip[near], cap)
        shared[1 + near] = np.minimum(skip[near] + rest, cap)
    star_symbols = s[sorted_stars]
    first_star = np.searchsorted(star_symbols, np.arange(symbols + 1))
    some = max(64, int(2 * n**0.5))

    falling = _Sweep(s, ~rising, symbols, cap, scratch, True)
    c = 0
    while c < symbols:
        # Buckets as they are now, up to about ``some`` entries: of each its L, then its S*.
        to = c + 1
        size = int(falling.head[c] - falling.begin[c] + first_star[c + 1] - first_star[c])
        if size < some:
            ahead = slice(c, min(symbols, c + some))
            sizes = np.cumsum(falling.head[ahead] - falling.begin[:-1][ahead] + np.diff(first_star[c : ahead.stop + 1]))
            to = c + max(1, int(np.searchsorted(sizes, some, "right")))
        if to > c + 1:
            pos, lcp, of = _gathered(falling, c, to, first_star, sorted_stars, shared, run, cap)
            target = falling.targets(pos)
            inside = target[(target >= c) & (target < to)]
            to = int(inside.min()) if len(inside) else to
            if to > c:  # nothing more enters the buckets before it
                upto = int(np.searchsorted(of, to))
                falling.take(pos[:upto], lcp[:upto])
                c = to
                continue
        falling.empty(c)
        lo, hi = first_star[c], first_star[c + 1]
        if lo < hi:
            pos, lcp = sorted_stars[lo:hi], shared[lo:hi].copy()
            low = falling.bucket(c)[0]
            lcp[0] = min(run[low[-1]], run[pos[0]], cap) if len(low) else 0
            falling.take(np.array(pos), lcp)
        c += 1

    up = _Sweep(s, rising, symbols, cap, scratch, False)
    # The last suffix has none after it that could induce it: it opens the bucket of its symbol.
    up.pos[up.begin[s[n - 1]]] = n - 1
    up.head[s[n - 1]] += 1
    up.step[s[n - 1]] = 0
    up.least[0], up.steps = 0, 1
    c = symbols - 1
    while c >= 0:
        to = c  # buckets c down to ``to``
        size = int(up.head[c] - up.begin[c] + falling.head[c] - falling.begin[c])
        if size < some:
            ahead = slice(max(0, c - some + 1), c + 1)
            sizes = np.cumsum((up.head[ahead] - up.begin[:-1][ahead] + falling.head[ahead] - falling.begin[:-1][ahead])[::-1])
            to = c - max(0, int(np.searchsorted(sizes, some, "right")) - 1)
        if to < c:
            pos, lcp, of = _gathered_down(up, falling, c, to, run, cap)
            target = up.targets(pos)
            inside = target[(target >= to) & (target <= c)]
            to = int(inside.max()) + 1 if len(inside) else to
            if to <= c:
                upto = int(np.searchsorted(-of, -to, "right"))
                up.take(pos[:upto], lcp[:upto])
                c = to - 1
                continue
        up.empty(c)
        pos, lcp = falling.bucket(c)
        if len(pos):
            high = up.bucket(c)[0]
            down = np.empty(len(pos), np.uint8)
            down[0] = min(run[pos[-1]], run[high[-1]], cap) if len(high) else 0
            down[1:] = lcp[:0:-1]
            up.take(np.array(pos[::-1]), down)
        c -= 1
    return _joined(falling, up, run, cap, n, scratch)


def _spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of the ranges begin .. end - 1, one after another."""
    sizes = end - begin
    return np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _gathered(falling: _Sweep, c: int, to: int, first_star: np.ndarray, stars: np.ndarray, shared: np.ndarray, run: np.ndarray, cap: int) -> tuple[np.ndarray, ...]:
    """Entries of the buckets c .. to - 1, as they leave: suffix, common prefix, bucket."""
    lb, le = np.array(falling.begin[c:to]), np.array(falling.head[c:to])
    sb, se = first_star[c:to], first_star[c + 1 : to + 1]
    low, star = _spans(lb, le), _spans(sb, se)
    of = np.concatenate([np.repeat(np.arange(c, to), le - lb), np.repeat(np.arange(c, to), se - sb)])
    order = np.argsort(of, kind="stable")  # L first: they stand first in the concatenation
    pos = np.concatenate([falling.pos[low], stars[star]])[order]
    star_lcp = np.array(shared[star])
    opens = np.flatnonzero(se > sb)
    both = le[opens] > lb[opens]
    at = np.cumsum(se - sb)[opens] - (se - sb)[opens]
    star_lcp[at] = 0
    seam = opens[both]
    star_lcp[at[both]] = np.minimum(run[falling.pos[le[seam] - 1]], run[stars[sb[seam]]])
    return pos, np.concatenate([falling.lcp[low], star_lcp])[order], of[order]


def _gathered_down(up: _Sweep, falling: _Sweep, c: int, to: int, run: np.ndarray, cap: int) -> tuple[np.ndarray, ...]:
    """The same for the second sweep: buckets c, c - 1 .. to; of each its S, then its L backwards."""
    symbols = np.arange(c, to - 1, -1)
    ub, ue = up.begin[symbols], up.head[symbols]
    lb, le = falling.begin[symbols], falling.head[symbols]
    high, low = _spans(ub, ue), _spans(lb, le)
    back = np.repeat(lb + le - 1, le - lb) - low  # each range backwards
    of = np.concatenate([np.repeat(symbols, ue - ub), np.repeat(symbols, le - lb)])
    order = np.argsort(-of, kind="stable")
    pos = np.concatenate([up.pos[high], falling.pos[back]])[order]
    # Backwards, an L's value is that of the one after it; the first one's is the seam.
    low_lcp = np.array(falling.lcp[np.minimum(back + 1, max(len(falling.lcp) - 1, 0))]) if len(back) else np.zeros(0, np.uint8)
    opens = np.flatnonzero(le > lb)
    at = np.cumsum(le - lb)[opens] - (le - lb)[opens]
    low_lcp[at] = 0
    both = ue[opens] > ub[opens]
    seam = opens[both]
    low_lcp[at[both]] = np.minimum(run[falling.pos[le[seam] - 1]], run[up.pos[ue[seam] - 1]])
    return pos, np.concatenate([up.lcp[high], low_lcp])[order], of[order]


def _joined(falling: _Sweep, up: _Sweep, run: np.ndarray, cap: int, n: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes: of each symbol its L, then its S, which were taken out backwards."""
    out_pos, out_lcp = scratch.array(n, np.int64), scratch.array(n, np.uint8)
    sizes = np.diff(falling.begin) + np.diff(up.begin)
    to = np.cumsum(sizes) - sizes
    low = _spans(to, to + np.diff(falling.begin))
    out_pos[low], out_lcp[low] = falling.pos, falling.lcp
    ends = to + sizes
    high = np.repeat(ends + np.array(up.begin[:-1]) - 1, np.diff(up.begin)) - np.arange(len(up.pos))
    out_pos[high] = up.pos
    # Backwards, the value of an entry is with the one taken out before it, which now stands after it.
    after = high + 1
    inner = np.ones(len(high), bool)
    inner[np.array(up.begin[:-1])[np.diff(up.begin) > 0]] = False
    out_lcp[after[inner]] = up.lcp[inner]
    lows, highs = np.diff(falling.begin) > 0, np.diff(up.begin) > 0
    first = to + np.diff(falling.begin)  # of the S of each symbol
    out_lcp[first[highs & ~lows]] = 0
    both = np.flatnonzero(lows & highs)
    out_lcp[first[both]] = np.minimum(run[falling.pos[falling.begin[both + 1] - 1]], run[up.pos[up.begin[both + 1] - 1]])
    out_lcp[to[lows]] = 0
    return out_pos, out_lcp


def repeated_starts(parts: list[bytes], length: int, memory: int = 256 << 20) -> list[np.ndarray]:
    """Of each part, the places where a string of ``length`` bytes begins that also begins at
    another place, in the same part or another; none crosses a part's end."""
    scratch = Scratch(memory)
    n = sum(len(p) + 1 for p in parts) + 1
    s = scratch.array(n, np.uint16)
    at, begin = 0, []
    for p in parts:
        begin.append(at)
        s[at : at + len(p)] = np.frombuffer(p, np.uint8)
        s[at : at + len(p)] += 2
        s[at + len(p)] = 1
        at += len(p) + 1
    order, lcp = suffix_order(s, length, scratch)
    twin = lcp >= length
    twin[:-1] |= lcp[1:] >= length
    places = np.sort(order[twin])
    out = []
    cuts = np.searchsorted(places, np.array([*begin, n]))
    for i, p in enumerate(parts):
        own = places[cuts[i] : cuts[i + 1]] - begin[i]
        out.append(own[own <= len(p) - length])
    return out
