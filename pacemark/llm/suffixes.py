"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy.

``t`` holds whole numbers and ends with 0, which occurs nowhere else.
"""

from __future__ import annotations

import numpy as np

from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

def smaller_types(t: np.ndarray) -> np.ndarray:
    """Whether a suffix is smaller than the next one (S) or not (L)."""
    s = np.ones(len(t), bool)
    change = np.flatnonzero(t[:-1] != t[1:])
    up = t[change] < t[change + 1]
    s[:-1] = np.repeat(up, np.diff(change, prepend=-1))  # a run of one symbol takes the type of its end
    return s


class _Induction:
    """Induces the order of all suffixes from that of the leftmost smaller ones, for an alphabet of any size.

    Buckets are walked in order, first up and then down, in ranges of neighbouring buckets of about the square root of
    all entries. The suffixes before a range's entries are dealt to their buckets at once, in order, by counting sorts.
    Where some fall into the range itself, it is cut in front of the first bucket that gets one, and goes on there when
    that bucket is complete. A bucket's own entries, runs of its symbol, are written out by their distance from the
    run's end.
    """

    def __init__(self, t: np.ndarray, s: np.ndarray, symbols: int):
        self.t, self.s, self.n, self.symbols = t, s, len(t), symbols
        count = np.bincount(t, minlength=symbols)
        self.ends = np.cumsum(count)
        self.starts = self.ends - count
        self.n_larger = np.bincount(t[~s], minlength=symbols)
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        #: equal symbols right before each position
        self.run = (np.arange(self.n) - np.repeat(begin, np.diff(np.append(begin, self.n)))).astype(np.int32)
        step = max(1, int(self.n**0.5))
        cut = (np.diff(self.starts // step) > 0) | (count[1:] >= step) | (count[:-1] >= step)
        self.ranges = [0, *(np.flatnonzero(cut) + 1).tolist(), symbols]

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """``lms``: grouped by symbol, in the order they shall have inside a bucket."""
        sa = np.full(self.n, -1, np.int32)
        symbol = self.t[lms]
        many = np.bincount(symbol, minlength=self.symbols)
        sa[(self.ends - np.cumsum(many))[symbol] + np.arange(len(lms))] = lms
        head = self.starts.copy()
        for lo, hi in zip(self.ranges[:-1], self.ranges[1:]):
            self._up(sa, lo, hi, head)
        is_smaller = np.ones(self.n, bool)
        larger = np.flatnonzero(self.n_larger)
        many = self.n_larger[larger]
        is_smaller[np.repeat(self.starts[larger] - np.cumsum(many) + many, many) + np.arange(many.sum())] = False
        sa[is_smaller] = -1
        sa[0] = self.n - 1
        tail = self.ends.copy()
        for lo, hi in zip(self.ranges[-2::-1], self.ranges[:0:-1]):
            self._down(sa, lo, hi, tail)
        return sa

    def _up(self, sa: np.ndarray, lo: int, hi: int, head: np.ndarray) -> None:
        while lo < hi:
            if hi - lo == 1:
                self._write_runs(sa, lo, head)
            at, j, symbol = self._before(sa, lo, hi, False)
            inside = symbol < hi
            to = hi
            if hi - lo == 1:
                j, symbol = j[~inside], symbol[~inside]
            elif inside.any():
                to = int(symbol[inside].min())
                if to == lo:  # a run of the first bucket's symbol
                    self._up(sa, lo, lo + 1, head)
                    lo += 1
                    continue
                here = np.searchsorted(at, self.ends[to - 1] - self.starts[lo])
                j, symbol = j[:here], symbol[:here]
            if len(j):
                j, symbol, first, many, place = self._grouped(j, symbol)
                sa[head[symbol] + place] = j
                head[first] += many
            lo = to

    def _down(self, sa: np.ndarray, lo: int, hi: int, tail: np.ndarray) -> None:
        while lo < hi:
            if hi - lo == 1:
                self._write_runs_down(sa, lo, tail)
            at, j, symbol = self._before(sa, lo, hi, True)
            inside = symbol >= lo
            to = lo
            if hi - lo == 1:
                j, symbol = j[~inside], symbol[~inside]
            elif inside.any():
                to = int(symbol[inside].max()) + 1
                if to == hi:
                    self._down(sa, hi - 1, hi, tail)
                    hi -= 1
                    continue
                here = np.searchsorted(at, self.starts[to] - self.starts[lo])
                j, symbol = j[here:], symbol[here:]
            if len(j):
                j, symbol, first, many, place = self._grouped(j[::-1], symbol[::-1])
                sa[tail[symbol] - 1 - place] = j
                tail[first] -= many
            hi = to

    def _before(self, sa: np.ndarray, lo: int, hi: int, smaller: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of the type asked for right before the entries of a range: whose, which, their symbols."""
        entries = sa[self.starts[lo] : self.ends[hi - 1]]
        at = np.flatnonzero(entries > 0)
        j = entries[at] - 1
        fits = self.s[j] if smaller else ~self.s[j]
        j = j[fits]
        return at[fits], j, self.t[j]

    def _grouped(self, j: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both in the order of symbols, each symbol once, how often, and every entry's place in its group."""
        if self.symbols <= 257:  # one byte is sorted by counting in half the time; symbol 0 is never dealt
            order = np.argsort((symbol - 1).astype(np.uint8), kind="stable")
        else:
            order = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")
            if self.symbols > 1 << 16:
                order = order[np.argsort((symbol[order] >> 16).astype(np.uint16), kind="stable")]
        j, symbol = j[order], symbol[order]
        begin = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        many = np.diff(np.append(begin, len(symbol)))
        return j, symbol, symbol[begin], many, np.arange(len(symbol)) - np.repeat(begin, many)

    def _runs(self, ends: np.ndarray) -> np.ndarray:
        """Entries and the positions of their symbol's run before them: the nearest first, each in the order given."""
        many = self.run[ends] + 1
        back = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return (np.repeat(ends, many) - back)[np.argsort(back, kind="stable")]

    def _write_runs(self, sa: np.ndarray, c: int, head: np.ndarray) -> None:
        got = sa[self.starts[c] : head[c]]
        if self.run[got].any():
            got = self._runs(got)
            head[c] = self.starts[c] + len(got)
            sa[self.starts[c] : head[c]] = got

    def _write_runs_down(self, sa: np.ndarray, c: int, tail: np.ndarray) -> None:
        got = sa[tail[c] : self.ends[c]][::-1]
        if self.run[got].any():
            got = self._runs(got)
            tail[c] = self.ends[c] - len(got)
            sa[tail[c] : self.ends[c]] = got[::-1]


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Begins of all suffixes in their order. ``symbols``: one more than the largest number in ``t``.

    The leftmost smaller suffixes' substrings are sorted by induction and named; where names repeat, their
    sequence is sorted by this function itself, whatever its alphabet. Their order then induces that of all suffixes.
    """
    n = len(t)
    if n < 3:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    t = t.astype(np.int32)
    s = smaller_types(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    induction = _Induction(t, s, symbols)
    order = induction.induce(lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    place = np.zeros(n, np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    size = np.ones(len(lms), np.int64)
    size[:-1] = np.diff(lms) + 1
    new = np.ones(len(ranked), bool)
    length = size[place[ranked]]
    same = np.flatnonzero(length[1:] == length[:-1])
    a, b, most, at = ranked[same], ranked[same + 1], length[same], 0
    while len(same):  # compare neighbours of one length, symbol by symbol
        new[same[at >= most] + 1] = False
        go = at < most
        go[go] = t[a[go] + at] == t[b[go] + at]
        same, a, b, most, at = same[go], a[go], b[go], most[go], at + 1
    name = np.cumsum(new) - 1
    if name[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int32)
        reduced[place[ranked]] = name
        ranked = lms[suffix_array(reduced, int(name[-1]) + 1)]
    return induction.induce(ranked)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each text position, the common prefix with the suffix that stands before it in the suffix array.

    Walking the text, a length falls by one at most while the symbols to the left of both suffixes agree.
    So only the other positions are compared, and ``position + length`` is carried on as a maximum.
    """
    n = len(t)
    phi = np.zeros(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    wide = np.concatenate([t.astype(np.uint64), np.zeros(3, np.uint64)])
    four = wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)
    at = np.arange(n, dtype=np.int32)
    free = (at == 0) | (phi == 0)
    free |= t[at - 1] != t[phi - 1]
    free[sa[0]] = False
    i = np.flatnonzero(free)
    j, length = phi[i].astype(np.int64), np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        # four symbols at a time; the end of the text is unique, so neither side runs over it
        x = four[np.minimum(i[live] + length[live], n - 1)] ^ four[np.minimum(j[live] + length[live], n - 1)]
        equal = x == 0
        low = x[~equal]
        some = (low & np.uint64(0xFFFF) == 0).astype(np.int64)
        two = some & (low & np.uint64(0xFFFFFFFF) == 0)
        three = two & (low & np.uint64(0xFFFFFFFFFFFF) == 0)
        length[live[~equal]] += some + two + three
        live = live[equal]
        length[live] += 4
    reach = np.zeros(n, np.int64)
    reach[i] = i + length
    return np.maximum(np.maximum.accumulate(reach) - at, 0)
