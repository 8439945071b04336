"""Hard-negative mining: tiles of anchors by candidates multiplied by Strassen's recursion.

Components become ``floor(256 * x)``, so scores are whole numbers. For each anchor the best rows of its own label
are its positives; for each positive the best rows of other labels whose score lies in a window relative to the
positive's are its negatives.

Anchors and candidates meet in blocks of bounded size; inside a task a pair of blocks is multiplied tile by tile.
A tile is padded with zeros to a power of two times the leaf size and multiplied by seven half-size products per
level. All sums and products are int64. Such arithmetic is exact modulo 2^64 whatever the intermediate sums do,
so every score that fits a BIGINT comes out right; tiles whose bound does not show that it fits are multiplied in
Python's whole numbers, by the same recursion, and their scores end at BIGINT's limits.

A heap is the best few entries of an anchor (or of an anchor and positive), by score, then id. Two heaps merge by
keeping the best of both, so tiles, blocks and tasks can be taken in any order: tiles merge into the block's heap,
blocks meet in a ranking per anchor that cuts before the shuffle. Positives come first, from pairs of blocks of one
label; the windows follow in a second pass over all pairs, with one window heap per positive. A window heap's worst
entry is its bar: once full, most of a tile is passed over by comparison.

A label may hold any share of the rows: it has as many blocks as its rows fill, dealt by row number, not by id.

Edge cases: rows with a null label, a null vector, a null id, or null or non-finite components take no part. Only
vectors of equal length are compared; empty ones score 0. Repeated rows are candidates each, never against an anchor
of the same id; an id that occurs more than once among the anchors is asked once, with its smallest label, then
vector. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacemark.llm.base import store
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score that a negative has, at least and at most
ANCHOR_ROWS, CANDIDATE_ROWS = 2_048, 8_192  # rows of a block
TILE = (256, 1_024)  # anchors and candidates multiplied at once
LEAF = 32  # sides up to which a product is taken directly
LIMIT = (1 << 63) - 1


def usable(vector: str) -> Column:
    """Not null, and every component is a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole_numbers(vectors: pd.Series) -> np.ndarray:
    """Rows of floor(256 * x), as int64, or as Python's numbers where they do not fit."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    if not x.size:
        return np.zeros((len(vectors), 0), np.int64)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * x)
    if not np.abs(scaled).max() < 2**62:
        exact = [[int(np.floor(SCALE * c)) if abs(c) < 2**900 else SCALE * int(c) for c in row] for row in x.tolist()]
        return np.array(exact, object).reshape(x.shape)
    return scaled.astype(np.int64)


def _padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns), x.dtype)
    if x.dtype == object:
        out[:] = 0
    out[: x.shape[0], : x.shape[1]] = x
    return out


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r, c = x.shape[0] // 2, x.shape[1] // 2
    return x[:r, :c], x[:r, c:], x[r:, :c], x[r:, c:]


def _product(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    """Strassen's recursion; all sides are multiples of 2 ** levels."""
    if not levels:
        return a @ b
    a1, a2, a3, a4 = _halves(a)
    b1, b2, b3, b4 = _halves(b)
    levels -= 1
    p = _product(a1 + a4, b1 + b4, levels)
    q = _product(a3 + a4, b1, levels)
    r = _product(a1, b2 - b4, levels)
    s = _product(a4, b3 - b1, levels)
    t = _product(a1 + a2, b4, levels)
    u = _product(a3 - a1, b1 + b2, levels)
    v = _product(a2 - a4, b3 + b4, levels)
    out = np.empty((a.shape[0], b.shape[1]), a.dtype)
    m, n = a.shape[0] // 2, b.shape[1] // 2
    out[:m, :n], out[:m, n:] = p + s - t + v, r + t
    out[m:, :n], out[m:, n:] = q + s, p - q + r + u
    return out


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b.T`` of whole numbers."""
    (m, k), n = a.shape, len(b)
    if not m or not n or not k:
        return np.zeros((m, n), np.int64)
    levels = 0
    while min(m, k, n) > leaf << levels:
        levels += 1
    side = [-(-x >> levels) << levels for x in (m, k, n)]  # rounded up
    return _product(_padded(a, side[0], side[1]), _padded(b.T, side[1], side[2]), levels)[:m, :n]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, int64."""
    most = [int(np.abs(x).max()) if x.size else 0 for x in (a, b)]
    if a.dtype == object or b.dtype == object or most[0] * most[1] * a.shape[1] >= 1 << 63:
        exact = multiply(a.astype(object), b.astype(object))
        ended = [[min(LIMIT, max(-LIMIT - 1, int(x))) for x in row] for row in exact]
        return np.array(ended, np.int64).reshape(len(a), len(b))
    return multiply(a, b)


class Heaps:
    """The best ``size`` entries (score, id) of each key, mergeable."""

    def __init__(self, keys: int, size: int):
        self.size = size
        self.score = np.full((keys, size), -LIMIT - 1, np.int64)
        self.id = np.zeros((keys, size), np.int64)
        self.count = np.zeros(keys, np.int64)

    def bars(self) -> np.ndarray:
        """What a new entry of each key has to reach."""
        return np.where(self.count == self.size, self.score[:, -1], -LIMIT - 1)

    def merge(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in entries of the given keys."""
        touched = np.unique(key)
        held = np.arange(self.size)[None, :] < self.count[touched][:, None]
        key = np.concatenate([key, np.repeat(touched, self.count[touched])])
        score = np.concatenate([score, self.score[touched][held]])
        ids = np.concatenate([ids, self.id[touched][held]])
        order = np.lexsort((ids, ~score, key))  # ~score falls as the score rises and does not overflow
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        keep = place < self.size
        key, place = key[keep], place[keep]
        self.score[key, place], self.id[key, place] = score[keep], ids[keep]
        self.count[touched] = np.bincount(np.searchsorted(touched, key), minlength=len(touched))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, score and id of all entries."""
        held = np.arange(self.size)[None, :] < self.count[:, None]
        return np.repeat(np.arange(len(self.count)), self.count), self.score[held], self.id[held]


def _tiles(anchors: np.ndarray, rows: np.ndarray):
    """Places of the first anchor and candidate of each tile, and its scores."""
    for a in range(0, len(anchors), TILE[0]):
        for r in range(0, len(rows), TILE[1]):
            yield a, r, scores(anchors[a : a + TILE[0]], rows[r : r + TILE[1]])


def positives_of_blocks(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` other rows of each anchor, of two blocks of one label."""
    ids, own = rows["id"].to_numpy(np.int64), anchors["id"].to_numpy(np.int64)
    heaps = Heaps(len(anchors), k)
    for a, r, tile in _tiles(whole_numbers(anchors["v"]), whole_numbers(rows["v"])):
        m, n = tile.shape
        fits = (tile >= heaps.bars()[a : a + m, None]) & (own[a : a + m, None] != ids[None, r : r + n])
        i, j = np.nonzero(fits)
        if len(i):
            heaps.merge(i + a, tile[i, j], ids[r + j])
    key, score, found = heaps.entries()
    return pd.DataFrame({"anchor_id": own[key], "positive_id": found, "positive_score": score})


def negatives_of_blocks(
    anchors: pd.DataFrame, rows: pd.DataFrame, k: int, low: int, high: int
) -> pd.DataFrame:
    """The best ``k`` rows of other labels within each positive's window, of two blocks."""
    ids, own = rows["id"].to_numpy(np.int64), anchors["id"].to_numpy(np.int64)
    kinds, kind = rows["label"].to_numpy(), anchors["label"].to_numpy()
    width = max((len(p) for p in anchors["positives"]), default=0)
    least = np.full((len(anchors), max(width, 1)), LIMIT, np.int64)
    most = np.full_like(least, -LIMIT - 1)  # no window: nothing lies between
    for i, listed in enumerate(anchors["positives"]):
        for p, score in enumerate(listed):
            least[i, p] = -(-low * int(score) // 100)
            most[i, p] = high * int(score) // 100
    heaps = Heaps(least.size, k)
    for a, r, tile in _tiles(whole_numbers(anchors["v"]), whole_numbers(rows["v"])):
        m, n = tile.shape
        other = (kind[a : a + m, None] != kinds[None, r : r + n]) & (own[a : a + m, None] != ids[None, r : r + n])
        bars = np.maximum(heaps.bars().reshape(least.shape), least)[a : a + m]
        for p in range(width):
            i, j = np.nonzero((tile >= bars[:, p, None]) & (tile <= most[a : a + m, p, None]) & other)
            if len(i):
                heaps.merge((i + a) * least.shape[1] + p, tile[i, j], ids[r + j])
    key, score, found = heaps.entries()
    at, place = key // least.shape[1], key % least.shape[1]
    return pd.DataFrame(
        {"anchor_id": own[at], "place": place.astype(np.int32), "negative_id": found, "negative_score": score}
    )


def _numbers(up_to: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), up_to.cast("bigint") - 1))


def _block(blocks: Column | str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "row"), F.col(blocks) if isinstance(blocks, str) else blocks)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_rows: int = ANCHOR_ROWS,
    candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """Per anchor, positive and negative: ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``, and ``place``, the positive's own rank. ``is_anchor`` is a condition on ``id``."""
    fit = vectors.where(
        usable(vector_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    ).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    rows = store(fit.withColumns({"width": F.size("v"), "row": F.monotonically_increasing_id()}))
    asked = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "width", "v", "row")).alias("a"))
    asked = store(asked.select("id", "a.label", "a.width", "a.v", "a.row"))

    # positives: blocks of one label and width
    kind = ["label", "width"]
    n_rows = rows.groupBy(*kind).agg(F.ceil(F.count("*") / candidate_rows).alias("rbs"))
    sizes = asked.groupBy(*kind).agg(F.ceil(F.count("*") / anchor_rows).alias("qbs")).join(n_rows, kind)
    sizes = store(sizes)
    left = asked.join(sizes, kind).select(
        *kind, _block("qbs", 5).alias("qb"), _numbers(F.col("rbs")).alias("rb"), "id", "v"
    )
    right = rows.join(sizes, kind).select(
        *kind, _numbers(F.col("qbs")).alias("qb"), _block("rbs", 6).alias("rb"), "id", "v"
    )

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return positives_of_blocks(q, r, positives)

    key = [*kind, "qb", "rb"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        meet, "anchor_id bigint, positive_id bigint, positive_score bigint"
    )
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = store(near.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"])
    windows = best.groupBy(F.col("anchor_id").alias("id")).agg(listed.alias("positives"))
    anchors = store(asked.join(windows, "id"))

    # windows: all pairs of blocks of one width
    rbs = max(1, -(-rows.count() // candidate_rows))
    qbs = max(1, -(-anchors.count() // anchor_rows))
    left = anchors.select(
        "width", _block(F.lit(qbs), 5).alias("qb"), _numbers(F.lit(rbs)).alias("rb"), "id", "label", "v", "positives"
    )
    right = rows.select(
        "width", _numbers(F.lit(qbs)).alias("qb"), _block(F.lit(rbs), 6).alias("rb"), "id", "label", "v"
    )

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return negatives_of_blocks(q, r, negatives, low, high)

    key = ["width", "qb", "rb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        search, "anchor_id bigint, place int, negative_id bigint, negative_score bigint"
    )
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(best, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "place"
    )
