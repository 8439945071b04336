"""Substring dedup: word windows that an earlier document has, by a count-min prefilter.

A window is 13 consecutive words of a document. Words covered by a window whose words also start in a document
with a smaller id are removed; all windows are judged on the input.

First pass: the sketch (`sketch`) counts, for each window, its smallest run of 9 words by hash. That run belongs
to the window's words alone, so it occurs at least as often as the window: its count is an overestimate of the
window's, and a third of the numbers is enough. Second pass: only windows whose run is estimated to occur twice
are hashed whole (128 bits) and grouped exactly: the smallest id per window, combined before the shuffle, is
joined back, and windows of larger ids are removed. A window that very many documents share is a row with a
minimum on one side and rows that can be split on the other.

Rows of one text: the smallest id stands for it (`texts.Dealt.leaders`); larger ids lose every word that a window
covers, so all of them if there are 13, without any further look. Texts are shuffled once.

Edge cases: a null or blank text has no words. A text of fewer than 13 words has no window and is left as it is.
Rows with a null id are left as they are and count as no earlier document. Rows that repeat an id count as one
document; repeated rows get the same result each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.llm import sketch, texts
from pacemark.llm.base import store
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

WINDOW, RUN = 13, 9
BLOCK_BYTES = 16 << 20  # of text for a block of the sketch, about a million runs
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        self[word] = digest = xxhash.xxh3_128_digest(word)
        return digest


def _rolled(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each ``size`` consecutive entries."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        out += h[i : i + len(out)] * np.uint64(pow(base, i, 1 << 64))
    return sketch.mixed(out)


class Words:
    """The leaders' words of a chunk, one after another, in the order of their digests."""

    def __init__(self, rows: pa.Table, leaders: pa.Table):
        chosen = sorted(
            {(d, i) for d, i in zip(leaders["digest"].to_pylist(), leaders["doc_id"].to_pylist()) if i is not None}
        )
        where = {}
        for at, key in enumerate(zip(rows["digest"].to_pylist(), rows["doc_id"].to_pylist())):
            where.setdefault(key, at)
        self.keys = [k for k in chosen if k in where]
        self.words = [rows["text"][where[k]].as_py().split() for k in self.keys]
        self.sizes = [len(w) for w in self.words]
        self.begins = np.cumsum([0, *self.sizes])

    def hash(self, window: int) -> Words:
        """Add the words' 128-bit hashes in two halves, their documents, and where windows start."""
        known, hashes = _Hashes(), [b""]
        for words in self.words:
            hashes += map(known.__getitem__, words)
        both = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
        self.h1, self.h2 = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        self.ids = np.repeat(np.array([i for _, i in self.keys], np.int64), self.sizes)
        left = np.repeat(self.begins[1:], self.sizes) - np.arange(len(self.h1))
        self.starts = np.flatnonzero(left >= window)
        return self

    def runs(self, window: int, run: int) -> np.ndarray:
        """The key of each window: the smallest hash of its runs."""
        grams = _rolled(self.h1, run, BASES[0])
        return np.min([grams[self.starts + i] for i in range(window - run + 1)], axis=0).astype(np.uint64)


def _result(ids: pa.ChunkedArray, sizes: list, removed: list, kept: list[bytes]) -> pa.Table:
    return pa.table(
        {
            "doc_id": ids.cast(pa.int64()),
            "n_words": pa.array(sizes, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()),
        }
    )


def dedup(
    docs: DataFrame, window: int = WINDOW, run: int = RUN, id_col: str = "doc_id", text_col: str = "text",
    hashed: bool = False,
) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept``: the kept words joined by one space (bytes), or, if
    ``hashed``, their SHA-256 in hex as ``kept_sha256``."""
    dealt = texts.deal(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    n_blocks = max(1, -(-dealt.n_bytes // BLOCK_BYTES))
    leaders = store(dealt.leaders)
    rows = dealt.rows.groupBy("chunk")

    def count(own: pa.Table, lead: pa.Table) -> pa.Table:
        words = Words(own, lead).hash(window)
        keys = words.runs(window, run)
        fresh = np.ones(len(keys), bool)  # neighbours with one and the same run count it once
        if len(keys):
            fresh[1:] = (keys[1:] != keys[:-1]) | (np.diff(words.starts) != 1)
        return sketch.parts(keys[fresh], own["chunk"][0].as_py() if len(own) else 0, n_blocks)

    sketches = rows.cogroup(leaders.groupBy("chunk")).applyInArrow(count, sketch.PART)
    flagged = store(sketch.repeated(sketches))
    # leaders and flagged values reach a chunk together
    side = leaders.select("chunk", "digest", "doc_id", F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("binary").alias("vals"))
    none = [F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("bigint").alias("doc_id")]
    told = side.unionByName(flagged.select("chunk", *none, "block", "vals"))

    def hash_windows(own: pa.Table, told: pa.Table) -> pa.Table:
        is_flag = told["vals"].is_valid()
        words = Words(own, told.filter(pa.compute.invert(is_flag))).hash(window)
        keep = sketch.estimated(words.runs(window, run), told.filter(is_flag), n_blocks)
        at = words.starts[keep]
        place = (own["chunk"][0].as_py() if len(own) else 0) << 32
        return pa.table(
            {
                "a": pa.array(_rolled(words.h1, window, BASES[0])[at].view(np.int64), pa.int64()),
                "b": pa.array(_rolled(words.h2, window, BASES[1])[at].view(np.int64), pa.int64()),
                "doc": pa.array(words.ids[at], pa.int64()),
                "place": pa.array(at.astype(np.int64) + place, pa.int64()),
            }
        )

    found = rows.cogroup(told.groupBy("chunk")).applyInArrow(hash_windows, "a bigint, b bigint, doc bigint, place bigint")
    first = found.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    first = store(first.where("least < most").drop("most"))  # read anew, so that a large key can be split
    later = found.join(first, ["a", "b"]).where("doc > least")
    gone = store(later.select(F.shiftright("place", 32).alias("chunk"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at")))
    side = leaders.select("chunk", "digest", "doc_id", F.lit(None).cast("bigint").alias("at"))
    told = side.unionByName(gone.select("chunk", *none, "at"))

    def cut(own: pa.Table, told: pa.Table) -> pa.Table:
        is_gone = told["at"].is_valid()
        words = Words(own, told.filter(pa.compute.invert(is_gone)))
        change = np.zeros(words.begins[-1] + 1, np.int64)
        at = told.filter(is_gone)["at"].to_numpy()
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        covered = np.cumsum(change)[:-1] > 0
        place = {k: i for i, k in enumerate(words.keys)}
        sizes, removed, kept = [], [], []
        for digest, doc, text in zip(*(own[c].to_pylist() for c in ("digest", "doc_id", "text"))):
            i = place.get((digest, doc))
            each = words.words[i] if i is not None else text.split()
            sizes.append(len(each))
            if i is not None:
                gone_here = covered[words.begins[i] : words.begins[i + 1]]
                if gone_here.any():
                    each = [w for w, g in zip(each, gone_here.tolist()) if not g]
            elif doc is not None and len(each) >= window:  # a smaller id has the same text
                each = []
            removed.append(sizes[-1] - len(each))
            line = b" ".join(each)
            kept.append(hashlib.sha256(line).hexdigest().encode() if hashed else line)
        return _result(own["doc_id"], sizes, removed, kept)

    out = rows.cogroup(told.groupBy("chunk")).applyInArrow(
        cut, "doc_id bigint, n_words bigint, n_removed bigint, kept binary"
    )
    if not hashed:
        return out
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256"))
