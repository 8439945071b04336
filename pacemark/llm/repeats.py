"""Periodic runs in a text's words: online dyadic square catching.

A text is a sequence of words, taken as numbers. `Catchers` reads it from the left, any number of words at a
time. For every power of two s, each completed block of s words keeps a catcher that waits for the block to come
again, s to 2s words later. A word that equals the block's last word starts a suffix comparison, backward from
both; if the whole block came again, p words later, it is carried on to both sides until the words differ. A
stretch of 2p words or more is a square of period p, and the stretch its run. A run of three periods or more
holds a whole aligned block of the level with s <= p < 2s that comes again p words later inside it, so none is
missed. Where runs of fewer periods are asked for, the catchers wait 2s to 4s words (1 to 4 for s = 1), which
holds for every square.

Squares merge into runs: a catch within a known run whose period divides its own is part of that run and is passed
over, so a run is compared once per level, however often its blocks come again. Stretches that reach the last
word so far stay open, and each appended word carries their comparison on. Of the periods of one stretch the
smallest counts.

The catchers of a level advance over all appended words by one vector operation; words that start a comparison
are few. Work is n log n for n words and memory some 20 bytes a word; nothing is shuffled.

Edge cases: a null or blank text has no words, no runs and an empty collapsed text. Each row stands for itself,
so null ids and repeated rows are rows like any other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

EXPONENT, LENGTH = 4, 6  # a run is that many periods long and has that many words, at least
GLANCE = 8  # words of a suffix comparison made for all catches of a level at once
STEP = 64  # first stretch compared when a match is carried on

Words = list[bytes]


class Catchers:
    """Squares and their runs of ``exponent`` periods or more in a growing sequence of numbers."""

    def __init__(self, exponent: int = EXPONENT) -> None:
        self.exponent, self.wait = exponent, 1 if exponent >= 3 else 2
        self.seq = np.empty(64, np.int32)
        self.n = 0
        self.seen: list[int] = []  # per level, the words that its catchers have seen
        self.found: dict[tuple[int, int], int] = {}  # (start, end) of closed runs: smallest period
        self.open: dict[tuple[int, int], None] = {}  # (start, period) of stretches that reach the last word

    def append(self, words: np.ndarray) -> None:
        """Let all catchers see further words."""
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.seq):
            self.seq = np.concatenate([self.seq[:before], np.empty(max(self.n, 2 * before) - before, np.int32)])
        self.seq[before : self.n] = words
        waiting, self.open = self.open, {}
        for start, period in waiting:
            self._close(start, self._right(before, period), period)
        level = 0
        while self.exponent * (self.wait << level if level else 1) <= self.n:  # shorter texts have no such run
            if level == len(self.seen):
                self.seen.append(0)
            self._catch(level, self.seen[level])
            self.seen[level] = self.n
            level += 1

    def runs(self, length: int = LENGTH) -> list[tuple[int, int, int]]:
        """Start, length and smallest period of the runs so far, in the order of start and period."""
        every = dict(self.found)
        for start, period in self.open:
            every[start, self.n] = min(period, every.get((start, self.n), period))
        long = ((a, b - a, p) for (a, b), p in every.items() if b - a >= max(length, self.exponent * p))
        return sorted(long, key=lambda r: (r[0], r[2]))

    def _catch(self, level: int, before: int) -> None:
        """Suffix comparisons that the words from ``before`` on start at the blocks of one level."""
        size, seq, n = 1 << level, self.seq, self.n
        ends, periods = [], []
        for away in (1,) if self.wait == 1 else (1, 2, 3) if level == 0 else (2, 3):
            # a text of n1 words meets the block that ends `away` blocks before its own last completed one
            first = max(before + 1, (away + 1) * size)
            if first > n:
                continue
            low, high = first // size - away, n // size - away  # blocks met, by the number of their end
            last = seq[low * size - 1 : high * size : size]
            skip = first - (low + away) * size
            wanted = np.repeat(last, size)[skip : skip + n + 1 - first] if level else last
            at = np.flatnonzero(wanted == seq[first - 1 : n]) + first
            ends.append(at)
            periods.append(at - (at // size - away) * size)
        if not ends:
            return
        end, period = np.concatenate(ends), np.concatenate(periods)
        for back in range(1, min(size, GLANCE)):
            if not len(end):
                return
            same = seq[end - 1 - back] == seq[end - 1 - back - period]
            end, period = end[same], period[same]
        if len(end):
            order = np.argsort(end, kind="stable")
            end, period = end[order], period[order]
            keep = self._outside(end, period, size)
            self._compare(end[keep].tolist(), period[keep].tolist(), size)

    def _outside(self, end: np.ndarray, period: np.ndarray, size: int) -> np.ndarray:
        """Catches that are not part of a known run whose period divides theirs."""
        keep = np.ones(len(end), bool)
        known = [(a, b, p) for (a, b), p in self.found.items()] + [(a, self.n, p) for a, p in self.open]
        for a, b, p in known:
            if b - a < 2 * size:
                continue
            low, high = np.searchsorted(end, [a, b + 1])
            part = slice(int(low), int(high))
            keep[part] &= (period[part] % p != 0) | (end[part] - size - period[part] < a)
        return keep

    def _compare(self, ends: list[int], periods: list[int], size: int) -> None:
        """Carry the suffix comparisons of one level on, both ways; squares are kept as runs."""
        reached: dict[int, int] = {}
        seq = self.seq
        for end, period in zip(ends, periods):
            if end <= reached.get(period, -1):
                continue  # inside the run of this period that an earlier catch found
            if size > GLANCE and not np.array_equal(seq[end - size : end], seq[end - size - period : end - period]):
                continue
            right = self._right(end, period)
            left = self._left(end - size, period)
            reached[period] = right
            self._close(left, right, period)

    def _close(self, start: int, end: int, period: int) -> None:
        if end == self.n:
            self.open[start, period] = None
        elif end - start >= 2 * period:
            self.found[start, end] = min(period, self.found.get((start, end), period))

    def _right(self, at: int, period: int) -> int:
        """The first place from ``at`` on that differs from the one a period before; the end, if none."""
        seq, step = self.seq, STEP
        while at < self.n:
            stop = min(self.n, at + step)
            same = seq[at:stop] == seq[at - period : stop - period]
            if not same.all():
                return at + int(same.argmin())
            at, step = stop, 2 * step
        return at

    def _left(self, at: int, period: int) -> int:
        """The start of the stretch: where the words before ``at`` and a period before it begin to agree."""
        seq, low, step = self.seq, at - period, STEP
        while low > 0:
            begin = max(0, low - step)
            same = seq[begin:low] == seq[begin + period : low + period]
            if not same.all():
                return low - int(same[::-1].argmin())
            low, step = begin, 2 * step
        return low


def numbers(words: Words) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter(map(known.setdefault, words, count()), np.int32, len(words))


def runs_of(words: Words, exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of the maximal runs of one text."""
    catchers = Catchers(exponent)
    catchers.append(numbers(words))
    return catchers.runs(length)


def collapsed(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find(
    docs: DataFrame,
    exponent: int = EXPONENT,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    rewrite: Callable[[object, Words], Words] | None = None,
) -> DataFrame:
    """Per row: ``doc_id, n_words, runs`` (array of start, length, period by start, then period), ``best``
    (the strongest one, null without runs) and ``collapsed``, the kept words joined by one space (bytes).

    ``rewrite(id, words)`` may change the words of a row before they are searched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in batches:
            sizes, every, best, kept = [], [], [], []
            for i in range(len(batch)):
                words = (batch.column(1)[i].as_py() or b"").split()  # bytes: space and \x09-\x0D only
                if rewrite is not None:
                    words = rewrite(batch.column(0)[i].as_py(), words)
                runs = runs_of(words, exponent, length)
                sizes.append(len(words))
                every.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                top = strongest(runs)
                best.append(top and dict(zip(("start", "length", "period"), top)))
                kept.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(every, pa.list_(kind)),
                    pa.array(best, kind),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_words", "runs", "best", "collapsed"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
    return narrow.mapInArrow(run, shape + "best struct<start:bigint,length:bigint,period:bigint>, collapsed binary")
