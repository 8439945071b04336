"""Announced periods: a decision that depends on the last announced value.

A candidate is announced if it differs from the last *announced* period by at least the threshold
(period policies), or differs at all (I/O steps). That chain runs through all rows of a cluster, but
it can be cut: seen from the first candidate ``c`` of a slice, an incoming value is either one of
``c - threshold + 1 .. c + threshold - 1`` or far away, and all far values behave alike. So every slice
is worked off once for these ``2 * threshold`` incoming cases, which soon fall together, and each row
notes in which cases it is announced. The outcomes per slice, a few numbers each, are then chained per
cluster, and a join picks the rows of the case that really came in. No task holds a whole cluster.

Inside a slice, blocks of candidates in which no case leaves its band are passed over as a whole, so a
steady cluster costs little, whatever the threshold.

Candidates are integers; rows with a NULL candidate are left out. A NULL start is far from every
candidate. Rows with a NULL key form a cluster of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.operators.ordered import SLICE
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

WORD = 62  # cases per BIGINT
BLOCK = 512  # candidates that are passed over at once
NOWHERE = -(1 << 62)  # a start far from every candidate


def _case_of(state: int, first: int, threshold: int) -> int:
    off = state - first
    return off + threshold - 1 if abs(off) < threshold else 2 * threshold - 1


def _words(bits: np.ndarray) -> list[int]:
    """Cases as bits of numbers of `WORD` bits."""
    at = np.flatnonzero(bits)
    return [
        int(np.bitwise_or.reduce(np.int64(1) << (at[at // WORD == i] % WORD)))
        if (at // WORD == i).any()
        else 0
        for i in range(-(-len(bits) // WORD))
    ]


class _Slice:
    """The values announced last in every incoming case, on the way through a slice."""

    def __init__(self, first: int, threshold: int):
        self.first, self.threshold = first, threshold
        self.states = first + np.arange(1 - threshold, threshold + 1, dtype=np.int64)
        self.far = True  # the last case has announced nothing yet

    def walk(self, values: np.ndarray, change: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Positions announced in at least one case, with the cases."""
        everywhere = _words(np.ones(2 * self.threshold, bool))
        at, n = 0, len(values)
        while at < n:
            end = min(n, at + BLOCK)
            low, high = int(self.states.min()), int(self.states.max())
            block = values[at:end]
            leaves = (block - low >= self.threshold) | (high - block >= self.threshold)
            leaves |= change[at:end] & ((block != low) | (low != high))
            if self.far:
                leaves[0] = True
            if not leaves.any():
                at = end
                continue
            at += int(np.argmax(leaves))
            if low == high and not self.far:  # one case: plain comparisons to the end of the block
                state = low
                rows = zip(values[at:end].tolist(), change[at:end].tolist())
                for i, (c, any_change) in enumerate(rows, at):
                    if abs(c - state) >= (1 if any_change else self.threshold):
                        state = c
                        yield i, everywhere
                self.states[:] = state
                at = end
                continue
            c = int(values[at])
            hit = np.abs(self.states - c) >= (1 if change[at] else self.threshold)
            if self.far:
                hit[-1], self.far = True, False
            if hit.any():
                self.states[hit] = c
                yield at, _words(hit)
            at += 1


def _mark(value: str, any_change: str, start: str, slice_col: str, threshold: int, columns: list[str]):
    """Rows announced in at least one case, and one row per slice with the outcome of every case."""
    shape = [*columns, "words", "first", "ends"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: tuple | None = None
        walk: _Slice | None = None
        begin = 0

        def outcome() -> dict:
            known = {"_key": group[0], slice_col: group[1], any_change: False, start: begin}
            return known | {"words": None, "first": walk.first, "ends": walk.states.tolist()}

        for pdf in batches:
            key, part = pdf["_key"].to_numpy(), pdf[slice_col].to_numpy()
            values = pdf[value].to_numpy(np.int64)
            change = pdf[any_change].to_numpy(bool)
            new = np.ones(len(pdf), bool)
            new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            bounds = [*np.flatnonzero(new).tolist(), len(pdf)]
            picked: list[int] = []
            words: list[list[int]] = []
            closed: list[dict] = []
            for a, b in zip(bounds, bounds[1:]):
                if group != (key[a], part[a]):
                    if group is not None:
                        closed.append(outcome())
                    group, begin = (key[a], part[a]), int(pdf[start].iloc[a])
                    walk = _Slice(int(values[a]), threshold)
                for i, cases in walk.walk(values[a:b], change[a:b]):
                    picked.append(a + i)
                    words.append(cases)
            if picked:  # a frame without rows has no types
                yield pdf[columns].iloc[picked].assign(words=words, first=None, ends=None)
            if closed:
                yield pd.DataFrame(closed).reindex(columns=shape)
        if group is not None:
            yield pd.DataFrame([outcome()]).reindex(columns=shape)

    return run


def _chain(slice_col: str, start: str, threshold: int):
    """The incoming case of every slice, walking the slice outcomes of each key in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: str | None = None
        state = 0
        for pdf in batches:
            found = []
            for key, begin, first, ends in zip(pdf["_key"], pdf[start], pdf["first"], pdf["ends"]):
                if key != group:
                    group, state = key, int(begin)
                case = _case_of(state, int(first), threshold)
                found.append(case)
                state = int(ends[case])
            if found:
                yield pdf[["_key", slice_col]].assign(incoming=found)

    return run


def announce(
    candidates: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    threshold: int,
    start: int | str,
    any_change: str | None = None,
    slice_col: str = SLICE,
) -> DataFrame:
    """Candidates that are announced, in every key and in order.

    ``start`` is the value announced before the first candidate, or the name of a column that holds it
    for every row of the key. ``any_change`` names a boolean column: TRUE rows are announced on any
    difference, the others need at least ``threshold``.
    """
    keys, order = list(keys), list(order)
    parts = ["_key", slice_col]
    flag, begin = "_any_change", "_start"
    columns = [*parts, *order, value, flag, begin]
    given = F.lit(start) if isinstance(start, int) else F.col(start)
    named = F.struct(*keys)
    rows = candidates.where(F.col(value).isNotNull()).select(
        F.to_json(named).alias("_key"),  # one text per key, also where a part of it is NULL
        slice_col,
        *order,
        F.col(value).cast("bigint").alias(value),
        F.coalesce(F.col(any_change) if any_change else F.lit(False), F.lit(False)).alias(flag),
        F.coalesce(given.cast("bigint"), F.lit(NOWHERE)).alias(begin),
    )
    key_type = candidates.select(named.alias("k")).schema["k"].dataType
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    marked = (
        rows.repartition(*parts)
        .sortWithinPartitions(*parts, *order)
        .mapInPandas(
            _mark(value, flag, begin, slice_col, threshold, columns),
            f"{fields}, words array<bigint>, first bigint, ends array<bigint>",
        )
    )
    incoming = (
        marked.where(F.col("ends").isNotNull())
        .select(*parts, begin, "first", "ends")
        .repartition("_key")
        .sortWithinPartitions(*parts)
        .mapInPandas(
            _chain(slice_col, begin, threshold),
            marked.select(*parts).schema.add("incoming", "long"),
        )
    )
    word = F.element_at("words", (F.col("incoming") / WORD).cast("int") + 1)
    bit = F.getbit(word, (F.col("incoming") % WORD).cast("int"))
    key = F.from_json("_key", key_type)
    return (
        marked.where(F.col("words").isNotNull())
        .join(incoming, parts)
        .where(bit == 1)
        .withColumn("_key", key)
        .select(
            *[F.col("_key")[k].alias(k) for k in keys],
            *order,
            value,
            slice_col,
            F.col(flag).alias("any_change"),
        )
    )
