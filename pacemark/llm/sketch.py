"""Count-min prefilter over sparse partition sketches.

A chunk of texts has a set of 64-bit keys, each with its number of occurrences, held at two. The sketch of the
whole corpus is cut into blocks of keys. Each chunk hands its part of a block over as 32-bit values; a block's
task adds up the parts in two rows of counters and returns to each chunk the values whose smaller counter is two
or more. Counters only ever rise through other keys, so no key that occurs twice is lost. Counters, blocks and
chunks are of bounded size; their number grows with the corpus, and no sketch is sent to all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

CELLS = 22  # bits: counters of a row
ODD = (0x9E3779B1, 0x85EBCA6B)  # one multiplier per row
PART = "block bigint, chunk bigint, vals binary, twice binary"


def mixed(z: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers; one to one."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def parts(keys: np.ndarray, chunk: int, n_blocks: int) -> pa.Table:
    """A chunk's rows for the blocks; ``keys`` has one entry per occurrence."""
    block, value = (keys >> np.uint64(32)) % np.uint64(n_blocks), keys & np.uint64(0xFFFFFFFF)
    short, count = np.unique(block << np.uint64(32) | value, return_counts=True)
    block = (short >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(block, prepend=-1)) if len(block) else np.zeros(0, np.int64)
    ends = [*cuts[1:].tolist(), len(block)]
    return pa.table(
        {
            "block": pa.array(block[cuts], pa.int64()),
            "chunk": pa.array([chunk] * len(cuts), pa.int64()),
            "vals": pa.array([short[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            "twice": pa.array([np.packbits(count[a:b] > 1).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        }
    )


def repeated(sketches: DataFrame) -> DataFrame:
    """``chunk, block, vals``: the values of a chunk that are estimated to occur twice in the corpus."""

    def merge(part: pa.Table) -> pa.Table:
        chunks, sent = part["chunk"].to_pylist(), [np.frombuffer(x, np.uint32) for x in part["vals"].to_pylist()]
        weights = [
            1 + np.unpackbits(np.frombuffer(t, np.uint8), count=len(v)) for v, t in zip(sent, part["twice"].to_pylist())
        ]
        values, weight = np.concatenate(sent), np.concatenate(weights)
        estimate = np.full(len(values), 2, np.uint8)
        for odd in ODD:
            cell = (values * np.uint32(odd)) >> np.uint32(32 - CELLS)
            counters = np.minimum(np.bincount(cell, weight, 1 << CELLS), 2).astype(np.uint8)
            estimate = np.minimum(estimate, counters[cell])
        ends = np.cumsum([len(v) for v in sent])[:-1]
        flagged = [v[e > 1] for v, e in zip(sent, np.split(estimate, ends))]
        some = [i for i, v in enumerate(flagged) if len(v)]
        return pa.table(
            {
                "chunk": pa.array([chunks[i] for i in some], pa.int64()),
                "block": pa.array([part["block"][0].as_py()] * len(some), pa.int64()),
                "vals": pa.array([flagged[i].tobytes() for i in some], pa.binary()),
            }
        )

    return sketches.groupBy("block").applyInArrow(merge, "chunk bigint, block bigint, vals binary")


def estimated(keys: np.ndarray, flagged: pa.Table, n_blocks: int) -> np.ndarray:
    """Which keys of a chunk are among its flagged ones (``block, vals``)."""
    sets = [
        np.uint64(b) << np.uint64(32) | np.frombuffer(v, np.uint32).astype(np.uint64)
        for b, v in zip(flagged["block"].to_pylist(), flagged["vals"].to_pylist())
    ]
    short = ((keys >> np.uint64(32)) % np.uint64(n_blocks)) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)
    return np.isin(short, np.concatenate(sets)) if sets else np.zeros(len(keys), bool)
