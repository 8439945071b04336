"""Suffix-array dedup of byte passages that occur more than once.

Each byte is removed that a string of 400 bytes covers which also starts anywhere else in the corpus, the same
text included; strings do not cross texts and are judged on the input.

Which texts meet: every 400-byte string is known by its smallest run of 200 bytes by hash. Equal strings have
equal runs, so they meet wherever that run's strings are brought together. A sketch (`sketch`) counts the runs
that are smallest somewhere; only runs that may occur twice go on. Neighbouring strings with one such run form a
segment. Segments are grouped by content first, so a passage that many texts share is one segment with a number
of occurrences; each different segment is sent once, to the shard of its run.

A shard's segments are one sequence with separators. Its suffix array is made by induced sorting and its permuted
common prefixes in one walk (`suffixes`): a string of 400 bytes repeats in the shard if it shares its 400 bytes
with a neighbour in the array. Shards are of bounded size; a run with too many different segments for a shard is
settled by grouping its strings by a 128-bit digest, again combined before the shuffle. Covered stretches
then go back to all places of a segment.

Texts that several rows share lose everything from 400 bytes on. Texts are shuffled once; only segments of
repeated runs are shuffled beside them.

Edge cases: a null text is empty; shorter texts than 400 bytes stay. Null ids and repeated rows are texts like any
other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.llm import sketch, suffixes, texts
from pacemark.llm.base import store
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

LENGTH, RUN = 400, 200
BLOCK_BYTES = 64 << 20  # of text for a block of the sketch
SHARD_BYTES = 2 << 20
HOT = 2_048  # different segments of a run beyond which it is settled by digests
PIECE = 1 << 15  # strings of a segment at most
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(data: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of each ``run`` consecutive bytes."""
    n = len(data)
    if n < run:
        return np.zeros(0, np.uint64)
    spread = sketch.mixed(np.arange(1, 257, dtype=np.uint64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(spread[data] * _powers(BASE, n), out=total[1:])
    return sketch.mixed((total[run:] - total[:-run]) * _powers(INVERSE, n - run + 1))


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum, or maximum, of each ``width`` consecutive entries."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    step = np.minimum if least else np.maximum
    padded = np.concatenate([x, np.full(-len(x) % width, x[-1])]).reshape(-1, width)
    ahead = step.accumulate(padded, axis=1).ravel()
    back = step.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return step(back[:n], ahead[width - 1 : width - 1 + n])


class Bytes:
    """The leaders' texts of a chunk that have at least one string, one after another."""

    def __init__(self, rows: pa.Table, leaders: pa.Table, length: int):
        copies = dict(zip(leaders["digest"].to_pylist(), leaders["copies"].to_pylist()))
        lead = set(zip(leaders["digest"].to_pylist(), leaders["doc_id"].to_pylist()))
        found: dict[bytes, int] = {}
        for at, key in enumerate(zip(rows["digest"].to_pylist(), rows["doc_id"].to_pylist())):
            if key in lead:
                found.setdefault(key[0], at)
        self.digests = sorted(found)
        own = [rows["text"][found[d]].as_py() for d in self.digests]
        keep = [i for i, x in enumerate(own) if len(x) >= length]
        self.digests, own = [self.digests[i] for i in keep], [own[i] for i in keep]
        self.rows = [found[d] for d in self.digests]
        self.sizes = np.array([len(x) for x in own], np.int64)
        self.begins = np.cumsum([0, *self.sizes])
        self.data = np.frombuffer(b"".join(own), np.uint8)
        self.many = np.repeat([copies[d] > 1 for d in self.digests], self.sizes).astype(bool)
        self.length = length

    def windows(self) -> np.ndarray:
        """Whether a string starts here that ends in the same text."""
        left = np.repeat(self.begins[1:], self.sizes) - np.arange(len(self.data))
        return left >= self.length

    def keys(self, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run hashes, the smallest of each string, and where strings start."""
        grams = run_hashes(self.data, run)
        least = sliding(grams, self.length - run + 1, True)
        return grams, least, self.windows()[: len(least)]


def anchors(own: Bytes, run: int) -> np.ndarray:
    """Hashes of all places whose run is the smallest of some string."""
    grams, least, starts = own.keys(run)
    if not starts.any():
        return grams[:0]
    width = own.length - run + 1
    edge = np.zeros(width - 1, np.uint64)
    around = np.concatenate([edge, np.where(starts, least, np.uint64(0)), edge])
    return grams[sliding(around, width, False)[: len(grams)] == grams]


def segments(own: Bytes, run: int, told: pa.Table, n_blocks: int) -> tuple[np.ndarray, ...]:
    """Begin, number of strings and run of each segment whose run may occur twice."""
    _, least, starts = own.keys(run)
    at = np.flatnonzero(starts)
    if not len(at):
        return at, at, least[:0]
    key = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    pieces = -(-count // PIECE)  # a long segment goes in pieces
    shift = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(at[first], pieces) + shift * PIECE
    count = np.minimum(PIECE, np.repeat(count, pieces) - shift * PIECE)
    key = np.repeat(key[first], pieces)
    keep = sketch.estimated(key, told, n_blocks)
    return begin[keep], count[keep], key[keep]


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def repeated_in_shard(parts: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """Per segment, which of its strings occur more than once among all segments with their weights."""
    sizes = np.array([len(x) for x in parts], np.int64)
    joined = np.frombuffer(b"\0".join(parts), np.uint8).astype(np.int32) + 2
    begins = np.cumsum(sizes + 1) - sizes - 1
    joined[begins[1:] - 1] = 1
    t = np.append(joined, 0)
    sa = suffixes.suffix_array(t, int(t.max()) + 1)
    shared = suffixes.common_prefixes(t, sa) >= length
    in_order = shared[sa]
    in_order[:-1] |= in_order[1:]  # with the one before or the one after
    twice = np.zeros(len(t), bool)
    twice[sa] = in_order
    return [
        twice[b : b + n - length + 1] | (w > 1) for b, n, w in zip(begins.tolist(), sizes.tolist(), weights)
    ]


def stretches(starts: np.ndarray, length: int) -> bytes:
    """Begin and end of what the strings cover, as pairs of 32-bit numbers."""
    at = np.flatnonzero(starts)
    if not len(at):
        return b""
    cut = np.flatnonzero(np.diff(at) > length)
    return np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + length], axis=1).astype(np.uint32).tobytes()


def _longs(*digests: bytes) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())


def dedup(
    docs: DataFrame, length: int = LENGTH, run: int = RUN, id_col: str = "doc_id", text_col: str = "text",
    hashed: bool = False, hot: int = HOT,
) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay), or, if ``hashed``,
    ``kept_sha256`` in hex in place of ``kept``. ``n_spans``: maximal removed runs."""
    dealt = texts.deal(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    n_blocks = max(1, -(-dealt.n_bytes // BLOCK_BYTES))
    leaders = store(dealt.leaders)
    rows = dealt.rows.groupBy("chunk")

    def with_leaders(told: DataFrame) -> DataFrame:
        """Rows for the chunks, and the leaders, in one table; ``digest`` tells them apart."""
        return leaders.unionByName(told, allowMissingColumns=True)

    def both(told: pa.Table) -> tuple[pa.Table, pa.Table]:
        lead = told["digest"].is_valid()
        return told.filter(lead), told.filter(pa.compute.invert(lead))

    def count(own: pa.Table, lead: pa.Table) -> pa.Table:
        here = own["chunk"][0].as_py() if len(own) else 0
        return sketch.parts(anchors(Bytes(own, lead, length), run), here, n_blocks)

    flagged = store(sketch.repeated(rows.cogroup(leaders.groupBy("chunk")).applyInArrow(count, sketch.PART)))

    def find(own: pa.Table, told: pa.Table) -> pa.Table:
        lead, flags = both(told)
        data = Bytes(own, lead, length)
        begin, n, key = segments(data, run, flags, n_blocks)
        raw = data.data.tobytes()
        a, b = _longs(*(_digest(raw[x : x + y + length - 1]) for x, y in zip(begin.tolist(), n.tolist())))
        place = (own["chunk"][0].as_py() if len(own) else 0) << 32
        weight = 1 + data.many[begin].astype(np.int64) if len(begin) else np.zeros(0, np.int64)
        return pa.table(
            {
                "run": pa.array(key.view(np.int64), pa.int64()), "a": a, "b": b,
                "place": pa.array(begin.astype(np.int64) + place, pa.int64()),
                "n": pa.array(n.astype(np.int64), pa.int64()), "weight": pa.array(weight, pa.int64()),
            }
        )

    found = store(
        rows.cogroup(with_leaders(flagged).groupBy("chunk")).applyInArrow(
            find, "run bigint, a bigint, b bigint, place bigint, n bigint, weight bigint"
        )
    )
    segment = ["run", "a", "b"]
    different = found.groupBy(*segment).agg(
        F.sum("weight").alias("weight"), F.min("place").alias("place"), F.max("n").alias("n")
    )
    per_run = different.groupBy("run").agg(F.count("*").alias("kinds"))
    different = store(different.join(per_run, "run"))
    whole = (F.col("kinds") == 1) & (F.col("weight") > 1)  # nothing else to compare with, and it repeats
    n_shards = different.where(~whole & (F.col("kinds") <= hot)).agg(F.sum(F.col("n") + length)).first()[0] or 0
    n_shards = max(1, -(-n_shards // SHARD_BYTES))
    chunk_of: Column = F.shiftright("place", 32).alias("chunk")
    todo = different.where(~whole).select(
        chunk_of, F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"), *segment, "n", "weight",
        F.pmod(F.xxhash64("run"), F.lit(n_shards)).alias("shard"), (F.col("kinds") > hot).alias("is_hot"),
    )
    asked = with_leaders(todo).groupBy("chunk")
    columns = [*segment, "weight", "shard"]

    def send(own: pa.Table, told: pa.Table) -> pa.Table:
        lead, want = both(told)
        want = want.filter(pa.compute.invert(want["is_hot"]))
        raw = Bytes(own, lead, length).data.tobytes()
        parts = [raw[x : x + y + length - 1] for x, y in zip(want["at"].to_pylist(), want["n"].to_pylist())]
        return want.select(columns).append_column("part", pa.array(parts, pa.binary()))

    def compare(shard: pa.Table) -> pa.Table:
        starts = repeated_in_shard(shard["part"].to_pylist(), shard["weight"].to_pylist(), length)
        return shard.select(segment).append_column(
            "covered", pa.array([stretches(s, length) for s in starts], pa.binary())
        )

    long3 = "run bigint, a bigint, b bigint"
    sent = rows.cogroup(asked).applyInArrow(send, f"{long3}, weight bigint, shard bigint, part binary")
    by_shard = sent.groupBy("shard").applyInArrow(compare, f"{long3}, covered binary")

    def each_string(own: pa.Table, told: pa.Table) -> pa.Table:
        lead, want = both(told)
        want = want.filter(want["is_hot"])
        raw = Bytes(own, lead, length).data.tobytes()
        spots = [(i, x, y) for i, (x, y) in enumerate(zip(want["at"].to_pylist(), want["n"].to_pylist()))]
        index = [i for i, _, y in spots for _ in range(y)]
        offset = [o for _, _, y in spots for o in range(y)]
        c, d = _longs(*(_digest(raw[x + o : x + o + length]) for _, x, y in spots for o in range(y)))
        out = want.select([*segment, "weight"]).take(pa.array(index, pa.int64()))
        return out.append_column("c", c).append_column("d", d).append_column("off", pa.array(offset, pa.int64()))

    strings = rows.cogroup(asked).applyInArrow(
        each_string, f"{long3}, weight bigint, c bigint, d bigint, off bigint"
    )
    again = strings.groupBy("run", "c", "d").agg(F.sum("weight").alias("_w")).where("_w > 1").drop("_w")

    def cover(part: pa.Table) -> pa.Table:
        starts = np.zeros(int(part["off"].to_numpy().max()) + 1, bool)
        starts[part["off"].to_numpy()] = True
        return part.select(segment).slice(0, 1).append_column("covered", pa.array([stretches(starts, length)], pa.binary()))

    by_digest = (
        strings.join(again, ["run", "c", "d"]).select(*segment, "off").groupBy(*segment)
        .applyInArrow(cover, f"{long3}, covered binary")
    )
    settled = by_shard
    if different.where(~whole & (F.col("kinds") > hot)).limit(1).count():
        settled = by_shard.unionByName(by_digest)
    alone = different.where(whole).select(*segment, F.lit(None).cast("binary").alias("covered"))
    settled = settled.where(F.octet_length("covered") > 0).unionByName(alone)
    covered = store(
        found.join(settled, segment).select(
            chunk_of, F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"), "n", "covered"
        )
    )

    def cut(own: pa.Table, told: pa.Table) -> pa.Table:
        lead, gone = both(told)
        data = Bytes(own, lead, length)
        change = np.zeros(len(data.data) + 1, np.int64)
        for at, n, pairs in zip(*(gone[c].to_pylist() for c in ("at", "n", "covered"))):
            spans = [[0, n + length - 1]] if pairs is None else np.frombuffer(pairs, np.uint32).reshape(-1, 2).tolist()
            for begin, end in spans:
                change[at + begin] += 1
                change[at + end] -= 1
        removed = np.cumsum(change)[:-1] > 0
        place = {r: i for i, r in enumerate(data.rows)}
        many = {d for d, c in zip(lead["digest"].to_pylist(), lead["copies"].to_pylist()) if c > 1}
        out: list[tuple] = []
        for row, (digest, text) in enumerate(zip(own["digest"].to_pylist(), own["text"].to_pylist())):
            n, spans = len(text), 0
            kept = text
            if row in place and digest not in many:
                i = place[row]
                mask = removed[data.begins[i] : data.begins[i + 1]]
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
            elif n >= length:  # several rows have this text
                kept, spans = b"", 1
            out.append((n, n - len(kept), spans, hashlib.sha256(kept).hexdigest().encode() if hashed else kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        made = [pa.array([r[i] for r in out], kinds[i]) for i in range(4)]
        return pa.table([own["doc_id"], *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    done = rows.cogroup(with_leaders(covered).groupBy("chunk")).applyInArrow(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
    if not hashed:
        return done
    return done.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256")
    )
