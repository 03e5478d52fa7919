"""Suffix order with common-prefix values by external induced sorting.

The text's suffixes that start a rising run behind a fall (S*) are sorted first:
their substrings up to the next S* are named in order, and the string of names
is sorted the same way, recursively. Two sweeps over the symbols then induce
all others. Each sweep works through priority queues keyed by (first symbol,
order of arrival): a sorted suffix at ``p`` pushes ``p - 1`` to the queue of
its symbol, with the common prefix it has with the suffix pushed there before,
which is one more than the least common prefix met since then. Pushes arrive in
order, so a queue is a list of runs; runs beyond ``memory`` bytes go to an
unnamed scratch file that ends with the sort.

Batches replace single steps: all that a queue holds at one time is handled by
a few array operations (stable partition by symbol, range minima for the
common prefixes).

Common prefixes are counted up to ``cap``; the order of suffixes that agree so
far is arbitrary. Once names are many against their string, or ``cap`` is
reached, the recursion ends by doubling ranks.
"""

from __future__ import annotations

import tempfile

import numpy as np

RECURSE = 64            # least mean number of equal names for another recursion


class Scratch:
    """Arrays kept in memory up to a budget, else in an unnamed file."""

    def __init__(self, memory: int):
        self.left, self.file = memory, None

    def put(self, a: np.ndarray):
        if a.nbytes <= self.left:
            self.left -= a.nbytes
            return a
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(a).data)
        return at, len(a), a.dtype

    def get(self, handle) -> np.ndarray:
        if isinstance(handle, np.ndarray):
            self.left += handle.nbytes
            return handle
        at, n, dtype = handle
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * np.dtype(dtype).itemsize), dtype)


class Queues:
    """A queue of (position, common prefix) runs per symbol, in order of arrival."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.runs = scratch, {}

    def push(self, symbol: int, p: np.ndarray, lcp: np.ndarray) -> None:
        self.runs.setdefault(symbol, []).append((self.scratch.put(p), self.scratch.put(lcp)))

    def pop(self, symbol: int):
        """All of a symbol's runs as two arrays; None if it has none."""
        runs = self.runs.pop(symbol, None)
        if not runs:
            return None
        got = [(self.scratch.get(p), self.scratch.get(x)) for p, x in runs]
        return got[0] if len(got) == 1 else tuple(np.concatenate(c) for c in zip(*got))


class RangeMin:
    """Minima of ``a[lo..hi]`` (both in) by a sparse table."""

    def __init__(self, a: np.ndarray):
        self.rows, width = [a], 1
        while 2 * width <= len(a):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp(hi - lo + 1)[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k) + 1])
        return out


class _Sweep:
    def __init__(self, text, symbols: int, cap: int, scratch: Scratch):
        self.text, self.cap, self.queues = text, cap, Queues(scratch)
        self.since = np.full(symbols, -1, np.int32)     # least common prefix since the last push; -1: no push yet

    def feed(self, p: np.ndarray, lcp: np.ndarray, pushes) -> None:
        """Handle sorted suffixes ``p``; ``pushes`` tells from the symbols before
        them which of these suffixes are induced."""
        before = self.text[p - 1].astype(np.int64)
        sel = np.flatnonzero(pushes(before) & (p > 0))
        least = int(lcp.min())
        if not len(sel):
            np.minimum(self.since, least, out=self.since)
            return
        target = before[sel]
        order = np.argsort(target.astype(np.uint16) if len(self.since) <= 65536 else target, kind="stable")
        target, at = target[order], sel[order]
        new = np.flatnonzero(np.diff(target, prepend=-1))
        lo = np.empty_like(at)
        lo[1:] = at[:-1] + 1
        lo[new] = 0
        least_of = RangeMin(lcp)
        m = least_of(lo, at).astype(np.int32)
        m[new] = np.minimum(m[new], self.since[target[new]])
        common = np.minimum(m + 1, self.cap).astype(lcp.dtype)
        np.minimum(self.since, least, out=self.since)
        ends = np.append(new[1:], len(at))
        last = at[ends - 1]
        rest = np.full(len(last), self.cap, np.int32)
        more = np.flatnonzero(last < len(p) - 1)
        if len(more):
            rest[more] = least_of(last[more] + 1, np.full(len(more), len(p) - 1))
        self.since[target[new]] = rest
        moved = p[at] - 1
        for a, b, c in zip(new.tolist(), ends.tolist(), target[new].tolist()):
            self.queues.push(c, moved[a:b], common[a:b])


def _types(text: np.ndarray):
    """Whether each suffix is S-type, and the length of the run it starts."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0, at - np.arange(n, dtype=np.int32) + 1


def _names(text: np.ndarray, starts: np.ndarray, symbols: int) -> np.ndarray:
    """Ranks of the S* substrings; equal ones get equal names."""
    m = len(starts)
    sizes = np.append(np.diff(starts) + 1, 1)
    bits, room = int(symbols + 1).bit_length(), 62 - int(m).bit_length()
    per = max(1, room // bits)
    rank, active, depth = np.zeros(m, np.int64), np.arange(m), 0
    while len(active):
        key = rank[active]
        for i in range(depth, depth + per):
            # behind its end a substring holds a symbol above all others
            inside = i < sizes[active]
            at = np.minimum(starts[active] + i, len(text) - 1)
            key = (key << bits) | np.where(inside, text[at].astype(np.int64), symbols)
        depth += per
        order = np.argsort(key, kind="stable")
        key, old = key[order], rank[active][order]
        place = np.arange(len(order))
        same_key = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, place, 0))
        same_old = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, place, 0))
        rank[active[order]] = old + same_key - same_old
        tied = np.bincount(rank[active], minlength=m) > 1
        open_ = np.bincount(rank[active], sizes[active] > depth, minlength=m) > 0
        active = active[(tied & open_)[rank[active]]]
    return np.unique(rank, return_inverse=True)[1]


def _doubled(names: np.ndarray, cap: int):
    """Suffix order of a string of ranks and common prefixes, by doubling."""
    n, ranks, width = len(names), [np.unique(names, return_inverse=True)[1].astype(np.int64)], 1
    while ranks[-1].max() < n - 1 and width < cap:
        r = ranks[-1]
        key = r * (n + 1)
        key[:-width] += r[width:] + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < n) & (y < n)
        ok[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
        common[ok] += 1 << k
    return order, np.concatenate([[0], np.minimum(common, cap)])


def _in_symbols(text, starts, order, common, cap: int) -> np.ndarray:
    """Common prefixes of neighbouring S* suffixes, counted in symbols."""
    out = np.zeros(len(order), np.int64)
    a, b = starts[order[:-1]], starts[order[1:]]
    full = common[1:] >= cap
    ahead = np.minimum(order[1:] + np.where(full, 0, common[1:]), len(starts) - 1)
    out[1:] = np.where(full, cap, np.minimum(starts[ahead] - b, cap))
    active = np.flatnonzero(out[1:] < cap)
    while len(active):
        off = out[1 + active]
        same = text[np.minimum(a[active] + off, len(text) - 1)] == text[np.minimum(b[active] + off, len(text) - 1)]
        same &= np.maximum(a[active], b[active]) + off < len(text)
        active = active[same]
        out[1 + active] += 1
        active = active[out[1 + active] < cap]
    return out


def suffix_order(text: np.ndarray, cap: int, memory: int = 1 << 28, scratch: Scratch | None = None):
    """``(order, common)``: the suffixes of ``text`` in order and the common prefix of
    each with the one before, up to ``cap``. ``text`` holds non-negative integers
    and ends with its only zero."""
    scratch = scratch or Scratch(memory)
    n, symbols = len(text), int(text.max()) + 1
    if n < 3:
        return np.arange(n)[::-1].astype(np.int32), np.zeros(n, np.int16)
    rising, run = _types(text)
    starts = np.flatnonzero(rising[1:] & ~rising[:-1]).astype(np.int64) + 1
    names = _names(text, starts, symbols)
    different = int(names.max()) + 1
    if different == len(names):
        order, common = np.argsort(names), np.zeros(len(names), np.int64)
    elif different * RECURSE <= len(names):
        order, common = suffix_order(names, cap, scratch=scratch)
        order, common = order.astype(np.int64), common.astype(np.int64)
    else:
        order, common = _doubled(names, cap)
    width = np.int16 if cap < 32000 else np.int32
    common = _in_symbols(text, starts, order, common, cap).astype(width)
    order = starts[order].astype(np.int32)
    first = text[order]
    present = np.flatnonzero(np.bincount(text))
    cuts = np.searchsorted(first, np.append(present, symbols))

    # left to right: falling suffixes from the S* and from each other
    sweep, falling = _Sweep(text, symbols, cap, scratch), {}
    for i, c in enumerate(present.tolist()):
        runs, top = [], None
        while (got := sweep.queues.pop(c)) is not None:
            runs.append((scratch.put(got[0]), scratch.put(got[1])))
            top = int(got[0][-1])
            sweep.feed(*got, lambda x, c=c: x >= c)
        falling[c] = (runs, top)
        a, b = cuts[i], cuts[i + 1]
        if b > a:
            lcp = common[a:b].copy()
            lcp[0] = 0 if top is None else min(run[top], run[order[a]], cap)
            sweep.feed(order[a:b], lcp, lambda x, c=c: x > c)
    # right to left: rising suffixes from those above
    sweep, done = _Sweep(text, symbols, cap, scratch), []
    for c in present[::-1].tolist():
        down, low = [], None
        while (got := sweep.queues.pop(c)) is not None:
            down.append(got)
            low = int(got[0][-1])
            sweep.feed(*got, lambda x, c=c: x <= c)
        runs, top = falling[c]
        border = 0
        if runs:
            got = [(scratch.get(p), scratch.get(x)) for p, x in runs]
            p, x = (np.concatenate(k) for k in zip(*got))
            border = 0 if low is None else min(run[low], run[top], cap)
            sweep.feed(p[::-1], np.append(np.array([border], x.dtype), x[:0:-1]), lambda y, c=c: y < c)
        else:
            p, x = np.empty(0, np.int32), np.empty(0, width)
        if down:
            q, y = (np.concatenate(k) for k in zip(*down))
            up = np.append(y[1:], np.array([0], y.dtype))[::-1].copy()
            up[0] = border
            p, x = np.concatenate([p, q[::-1]]), np.concatenate([x, up])
        done.append((scratch.put(p.astype(np.int32)), scratch.put(x.astype(width))))
    parts = [(scratch.get(p), scratch.get(x)) for p, x in done[::-1]]
    order, common = (np.concatenate(k) for k in zip(*parts))
    if len(order) < n:                                  # the end mark itself
        order, common = np.append(np.int32(n - 1), order), np.append(np.zeros(1, width), common)
    return order, common
