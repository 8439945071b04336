"""Near copies by shingle sets: SimHash rings wide enough for a similarity, pigeonring chains, exact check.

Two texts are near copies if the sets of their word shingles (five words, A-Z lower-cased) have a Jaccard
similarity of at least 0.8. A bit of a SimHash differs with probability ``acos(cosine) / pi``, 0.15 there, so
that 64 bits and a small distance find few of them. Here the ring is as wide as the similarity asks for:

* `plan` takes segments as wide as the number of different texts needs to part them, and as many of them
  as meet a pair at the threshold with probability ``recall``; more similar pairs are met more often.
* A candidate shares a whole segment. From there on the chains of 2, 3, .. segments may differ in `SHARE` of
  their bits at most; then the whole rings may; then the shingle sets are compared exactly. So nothing is
  linked wrongly, and what is missed is missed by chance, not by a cap.

Texts with equal sets are one node. In a segment that many nodes share, all are held against the smallest
first; pairs are made only between nodes that are not yet in one component, so that a large group of near
copies gives a link or a few per node and not all pairs. Only components are wanted here, not all links.

Segments of more than `CROWD` nodes are no place to make pairs: of many edited copies of one text most may stay
under the threshold, and all of them meet. There the shingles themselves part the nodes (`_first_shingles`): each
set is sorted, rare shingles first; a pair that reaches the threshold has a common shingle among the first ones
of both sets, at places that leave room for the overlap needed. What an edit brings is rare, so an edited copy has
few or no common shingles there. All that share one are held against the set with the fewest rare shingles before
it, the least edited one; pairs follow between components, as above. No pair that reaches the threshold is lost by
this, whatever the order of the shingles; how rare they are is counted on a sample of the nodes, which changes the
number of candidates only.

Edge cases: a null or blank text has the empty set; these are one group. A text of one to four words is a
single shingle. Repeated rows and null ids stay as they are; a group's ``component_id`` is its smallest id
that is not null. Other columns of the input are ignored, whatever their names. Sets and shingles are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.llm.base import components, store
from pacemark.llm.simhash import CHUNK, bit_counts
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
RECALL = 0.98  # of pairs at the threshold itself that share a segment
SHARE = 0.25  # differing bits of a chain; 0.15 are expected at the threshold
CHAIN = 64  # bits after the shared segment that travel with it
ROWS = 256  # rings that are cut at once
CROWD = 16  # nodes of a segment up to which all its pairs are made
SLOTS = 1 << 20  # counters of shingles
COUNTED = 4_000_000  # shingles that are counted, about, and an eighth of them at most


def plan(distinct: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Number and width of segments, for a number of different texts."""
    width = max(16, distinct.bit_length() - 2)
    differs = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - differs) ** width)), width


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of a text's shingles."""
    words = (text or b"").lower().split()  # both know ASCII only
    if 0 < len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n = max(0, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64, n))


def ring_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``64 * words`` bits: each hash is mixed anew for every 64 of them."""
    out = np.zeros(words, np.int64)
    for j in range(words):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), CHUNK):
            x = hashes[at : at + CHUNK] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            counts += bit_counts(x ^ (x >> np.uint64(31)))
        out[j] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0]
    return out


def _prints(docs: DataFrame, words: int, shingle: int) -> DataFrame:
    """Per row of ``doc_id, text, h``: ``doc_id, h, node`` (hash of the set) and ``fp``, its ring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(1)]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            rings = pa.array([ring_of(s, words) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes), rings], names=["doc_id", "h", "node", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, h bigint, node bigint, fp array<bigint>")


def _segments(nodes: DataFrame, places: int, width: int) -> DataFrame:
    """Rows ``key`` (place and value of a segment), ``node``, ``chain`` (the bits that follow in the ring)."""
    bits = places * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = ((np.arange(places) + 1)[:, None] * width + np.arange(CHAIN)) % bits
        values, first = 1 << np.arange(width, dtype=np.int64), np.arange(places, dtype=np.int64) << width
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rings = np.array(part.column(1).to_pylist(), np.int64)
                ones = np.unpackbits(rings.view(np.uint8), axis=1, bitorder="little")[:, :bits]
                keys = ones.reshape(len(ones), places, width) @ values + first
                chains = np.packbits(ones[:, after], axis=2, bitorder="little").view(np.int64)
                owners = np.repeat(part.column(0).to_numpy(), places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(owners), pa.array(chains.ravel())], names=["key", "node", "chain"]
                )

    return nodes.select("node", "fp").mapInArrow(run, "key bigint, node bigint, chain bigint")


def _chains_fit(a: str, b: str, width: int) -> Column:
    """Every chain from the shared segment on differs in at most `SHARE` of its bits."""
    bits, fits = F.col(a).bitwiseXOR(F.col(b)), F.lit(True)
    for end in sorted({*range(width, CHAIN, width), CHAIN}):
        head = F.call_function("shiftleft", bits, F.lit(CHAIN - end))
        fits &= F.bit_count(head) <= int(SHARE * (width + end))
    return fits


def _sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``node, found``: the shingle set of each node asked for (column ``node``)."""
    least = nodes.join(asked, "node", "left_semi").select("node", "rep.h", "rep.doc_id").alias("k")
    same = (F.col("d.h") == F.col("k.h")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    texts = docs.alias("d").join(least, same).select("k.node", "d.text").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = shingle_set(batch.column(1)[i].as_py(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([found], pa.list_(pa.int64()))], names=["node", "found"]
                )

    return store(texts.mapInArrow(run, "node bigint, found array<bigint>"))


def rare_first(found: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones first: a set of this similarity has one of them in common with it."""
    order = np.lexsort((found, counts[found.view(np.uint64) % np.uint64(SLOTS)]))
    return found[order[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]]


def _first_shingles(members: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``x, node, n, at``: `rare_first` of the nodes' sets with their places and the size of the set."""
    sets = _sets(members, nodes, docs, shingle)
    total = sets.agg(F.sum(F.size("found"))).first()[0] or 0
    part = sets.where(F.pmod("node", F.lit(max(8, -(-total // COUNTED)))) == 0)
    slots = part.select(F.explode("found").alias("x")).groupBy(F.expr(f"cast(x & {SLOTS - 1} as int)").alias("slot"))
    told = slots.count().where("count > 1").toPandas()  # as many rows as counters at most
    counts = np.zeros(SLOTS, np.int32)
    counts[told["slot"].to_numpy(np.int64)] = np.minimum(told["count"], 2**31 - 1)
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, found in zip(batch.column(0), batch.column(1)):
                whole = found.values.to_numpy(zero_copy_only=False)
                x = rare_first(whole, sent.value, similarity)
                columns = [x, np.full(len(x), node.as_py()), np.full(len(x), len(whole)), np.arange(len(x))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["x", "node", "n", "at"])

    return store(sets.where(F.size("found") > 0).mapInArrow(run, "x bigint, node bigint, n bigint, at bigint"))


def _room(similarity: float) -> Column:
    """Two sets with a common shingle, ``n, at`` and ``n_b, at_b``, and none before it may reach the similarity."""
    room = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    return room >= similarity / (1 + similarity) * (F.col("n") + F.col("n_b")) - 1e-6


def _two(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _central(first: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of each node and those that have one of its shingles the earliest."""
    least = first.groupBy("x").agg(F.min(F.struct(F.col("at").alias("at_b"), F.col("n").alias("n_b"), "node")).alias("s"))
    least = least.select("x", "s.at_b", "s.n_b", F.col("s.node").alias("node_b"))
    met = first.join(least, "x").where((F.col("node") != F.col("node_b")) & _room(similarity))
    return met.select(*_two("node", "node_b"))


def _between(first: DataFrame, group: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of different components that may reach the similarity by their first shingles."""
    first = first.join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = first.groupBy("x").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("x")
    first = first.join(mixed, "x", "left_semi")
    other = first.select("x", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "root")])
    met = first.join(other, "x").where((F.col("root") < F.col("root_b")) & _room(similarity))
    return met.select(*_two("node", "node_b"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, bits: int, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose rings are near and whose shingle sets reach the similarity."""
    rings = nodes.select("node", "fp")
    far = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = pairs.join(rings.toDF("a", "fa"), "a").join(rings.toDF("b", "fb"), "b")
    near = store(near.where(far <= int(SHARE * bits)).select("a", "b"))
    met = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(met, nodes, docs, shingle)
    both = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    enough = F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common"))
    return store(both.where(enough).select("a", "b"))


def near_copies(
    docs: DataFrame,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: ``doc_id``, ``h``, a hash of the text, ``root`` of its group and ``component_id``, the smallest id in it."""
    docs = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("h")
    )
    places, width = plan(docs.agg(F.approx_count_distinct("h")).first()[0], similarity, recall)
    bits = places * width
    prints = store(_prints(docs, -(-bits // 64), shingle))
    nodes = store(
        prints.groupBy("node").agg(
            F.min(F.struct("h", "doc_id")).alias("rep"), F.min("doc_id").alias("least"), F.first("fp").alias("fp")
        )
    )
    ring = _segments(nodes, places, width)  # made anew for each of its two shuffles: cheaper than keeping it
    dealt = ring.repartition("key")
    crowded = store(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key"))
    members = ring.join(crowded, "key", "left_semi").select("node").distinct()
    rare = _first_shingles(members, nodes, docs, shingle, similarity)
    dealt = ring.join(crowded, "key", "left_anti").repartition("key")
    first = dealt.groupBy("key").agg(F.min(F.struct("node", "chain")).alias("s"))
    first = first.select("key", F.col("s.node").alias("b"), F.col("s.chain").alias("cb"))
    stars = dealt.join(first, "key").where((F.col("node") > F.col("b")) & _chains_fit("chain", "cb", width))
    stars = stars.select(F.col("node").alias("a"), "b").unionByName(_central(rare, similarity))
    stars = store(stars.distinct())
    links = _verified(stars, nodes, docs, bits, shingle, similarity)

    group = store(components(links))
    mine = ring.join(crowded, "key", "left_anti").join(group, "node", "left")
    mine = mine.withColumn("root", F.coalesce("root", "node")).repartition("key")
    mixed = mine.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    mine = mine.join(mixed, "key", "left_semi")
    other = mine.select("key", F.col("node").alias("b"), F.col("chain").alias("cb"), F.col("root").alias("rb"))
    more = mine.join(other, "key").where((F.col("root") < F.col("rb")) & _chains_fit("chain", "cb", width))
    more = more.select(*_two("node", "b")).unionByName(_between(rare, group, similarity)).distinct()
    more = store(more.join(stars, ["a", "b"], "left_anti"))
    links = links.unionByName(_verified(more, nodes, docs, bits, shingle, similarity))

    group = nodes.select("node", "least").join(components(links), "node", "left")
    group = group.select("node", "least", F.coalesce("root", "node").alias("root"))
    least = group.groupBy("root").agg(F.min("least").alias("component_id"))
    named = group.join(least, "root").select("node", "root", "component_id")
    return prints.join(named, "node").select("doc_id", "h", "root", "component_id")
