"""Embedding near-duplicates by sorted projection passes.

A pass draws 62 random hyperplanes; a vector's signs, read as one number, are its hash. Vectors stand in the
order of that number within their label, and each is compared with the next ``window`` ones. Near vectors share
long beginnings of hashes often enough that some pass brings them close together. How often depends on how
crowded their surroundings are, so it is measured: up to about ``PROBES`` vectors of a label get a partner made at
the threshold, half of them towards another vector of the label, and passes go on until the share ``recall`` of
the made pairs has been met. Labels of at most ``window`` + 1 vectors are compared in whole by their first pass.
Verified pairs are united and their connected components found.

A label too crowded for its passes, which has not met its probes after ``PATIENCE`` times the passes that even
surroundings need, is completed exactly: its vectors meet by pairs of bounded blocks. ``complete`` asks for that
for all labels, whatever their probes say.

A bounded window cannot hold all pairs of a large group, and they are no result. So pairs and passes only have to
connect a group; afterwards each component counts its links exactly: its members meet in blocks of bounded size,
and every pair of blocks is a task of its own that returns numbers of links, not pairs. Equal vectors are one row
with a number of copies throughout.

All ranks are dense numbers over range-parted rows, cut into blocks that also get the last ``window`` rows of the
block before; no label or group is gathered in one task.

Edge cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label, link
with nothing; likewise vectors of different length. Rows that repeat an id are vectors of their own. Null ids
are no node; such a row has no links. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.llm.base import components, numbered, store
from pacemark.llm.topk import usable
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

COSINE, WINDOW, RECALL, SEED = 0.93, 48, 0.999, 11
PLANES = 62  # of a pass; the hash is a non-negative BIGINT
BLOCK = 2_048  # rows of a task's block
PATIENCE = 3
PROBES = 4_096  # pairs made to measure a label's passes, about


def passes_for(rows: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes until a pair at the threshold is met with the given probability, if signs part the table evenly.

    Two vectors agree in a plane's sign with probability 1 - angle / pi. If they share the first b signs,
    where 2**b windows make the table, they stand about a window apart at most. Crowded tables need more.
    """
    same = 1 - math.acos(cosine) / math.pi
    met = same ** max(1.0, math.log2(max(2, rows) / window))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hashes(rows: DataFrame, passes: int, seed: int = SEED, first: int = 0) -> DataFrame:
    """``pass, label, width, h, id, v``: a row of each vector for each pass, numbered from ``first`` on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        power = 1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64)
        for pdf in batches:
            for width, own in pdf.groupby("width"):
                x = _unit(own["v"])
                for p in range(first, first + passes):
                    planes = np.random.default_rng([seed, p, int(width)]).standard_normal((int(width), PLANES))
                    signs = (x @ planes > 0).astype(np.int64)
                    yield own.assign(**{"pass": p, "h": signs @ power})[["pass", "label", "width", "h", "id", "v"]]

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInPandas(
        run, f"pass int, label {label}, width int, h bigint, id bigint, v array<double>"
    )


def _stars(pairs: np.ndarray) -> np.ndarray:
    """Pairs of each node with the smallest one that the given pairs lead to: as connected, but few."""
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(pairs.shape).T
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        lower = label.copy()
        np.minimum.at(lower, a, least)
        np.minimum.at(lower, b, least)
        lower = lower[lower]
        if (lower == label).all():
            return np.stack([nodes[label], nodes], axis=1)[label != np.arange(len(nodes))]
        label = lower


def window_pairs(
    hashed: DataFrame, cosine: float = COSINE, window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """Pairs ``a, b`` that connect all rows which verified pairs, at most ``window`` places apart, connect.

    A block's verified pairs are united at once, so it hands on a pair per row at most, not all of them.
    A row with a negative id is a probe: it connects nothing, and is handed on with its own row (`probes`) if met.
    """
    order = [F.col(c) for c in ("pass", "label", "width", "h", "id")]
    placed = numbered(hashed, *order)
    own, at = F.floor(F.col("pos") / block), F.col("pos") % block
    both = F.when(at >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
    blocks = placed.select("pass", "label", "width", "id", "v", "pos", F.explode(both).alias("block"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        found, met = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for _, part in pdf.groupby(["pass", "label", "width"], sort=False):
            x, ids = _unit(part["v"]), part["id"].to_numpy()
            for d in range(1, min(window, len(part) - 1) + 1):
                own = np.flatnonzero(ids[:-d] == -1 - ids[d:])
                met.append(np.stack([ids[own], ids[own + d]], axis=1))
                hit = np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= cosine)
                hit = hit[(ids[hit] >= 0) & (ids[hit + d] >= 0)]
                found.append(np.stack([ids[hit], ids[hit + d]], axis=1))
        both = np.concatenate([_stars(np.concatenate(found)), np.sort(np.concatenate(met), axis=1)])
        return pd.DataFrame(both, columns=["a", "b"])

    return blocks.groupBy("block").applyInPandas(compare, "a bigint, b bigint").distinct()


def probes(rows: DataFrame, cosine: float = COSINE, seed: int = SEED) -> DataFrame:
    """Rows ``id, label, width, v`` at the threshold from about ``PROBES`` rows of each group; of row i, id is -1 - i.

    ``rows`` has ``size``, the rows of its label and width. Every second probe lies towards another row, where its
    surroundings are crowded, the others in a random direction.
    """
    some = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("size")) < PROBES
    label = rows.schema["label"].dataType.simpleString()

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = _unit(pdf["v"])
        to = np.random.default_rng([seed, x.shape[1]]).standard_normal(x.shape)
        other = np.roll(x, 1, axis=0)
        aside = other - (other * x).sum(axis=1, keepdims=True) * x
        towards = (np.arange(len(x)) % 2 == 0) & ((aside * aside).sum(axis=1) > 1e-9)
        to[towards] = aside[towards]
        to -= (to * x).sum(axis=1, keepdims=True) * x
        to /= np.sqrt((to * to).sum(axis=1, keepdims=True)) + 1e-300
        made = cosine * x + math.sqrt(1 - cosine * cosine) * to
        return pdf.assign(id=-1 - pdf["id"], v=list(made))

    picked = rows.where(some & (F.col("width") > 1)).select("id", "label", "width", "v")
    return picked.groupBy("label", "width").applyInPandas(make, f"id bigint, label {label}, width int, v array<double>")


def _cells(members: DataFrame, block: int) -> DataFrame:
    """Rows ``root, id, v, copies`` dealt to the pairs ``i, j`` of their group's blocks, and a ``task``.

    A group of several blocks is worked off by pairs of blocks, of larger blocks if it has many; small groups
    share a task.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 1
    bins = max(1, total // block)
    n = F.ceil(F.col("size") / F.when(F.col("size") > 16 * block, 4 * block).otherwise(block))
    rows = members.join(sizes, "root").withColumn("n", n)
    own = F.pmod(F.xxhash64("id"), F.col("n"))
    others = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda j: F.struct(
        F.least(j, own).alias("i"), F.greatest(j, own).alias("j")
    ))
    return rows.select(
        "root", "id", "v", "copies", own.alias("own"), "n", F.explode(others).alias("cell")
    ).select(
        "root", "id", "v", "copies", "own", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"),
        F.when(F.col("n") > 1, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(bins))).alias("task"),
    )


def all_pairs(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Pairs ``a, b`` that connect all rows ``id, v`` of a group (``root``) which any link connects."""

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        stars = [np.zeros((0, 2), np.int64)]
        for _, part in pdf.groupby("root", sort=False):
            x, ids = _unit(part["v"]), part["id"].to_numpy()
            one = part["i"].iloc[0] == part["j"].iloc[0]
            side = part["own"].to_numpy() == part["i"].iloc[0]
            mine, rest = np.flatnonzero(side), np.flatnonzero(side if one else ~side)
            for begin in range(0, len(mine), 512):
                take = mine[begin : begin + 512]
                near, far = np.nonzero(x[take] @ x[rest].T >= cosine)
                pairs = np.stack([ids[take[near]], ids[rest[far]]], axis=1)
                stars.append(_stars(pairs[pairs[:, 0] != pairs[:, 1]]))
        return pd.DataFrame(_stars(np.concatenate(stars)), columns=["a", "b"])

    cells = _cells(rows.withColumn("copies", F.lit(1).cast("bigint")), block)
    return cells.groupBy("task", "i", "j").applyInPandas(unite, "a bigint, b bigint").distinct()


def connecting_pairs(
    rows: DataFrame, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL, complete: bool = False
) -> DataFrame:
    """Pairs ``a, b`` that connect the rows ``id, label, width, v`` which links of their label connect.

    Which labels still need passes is a table, however many they are; only its size and largest label come here.
    """
    group = ["label", "width"]
    sizes = store(rows.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1"))
    sized = rows.join(sizes, group)
    made = store(probes(sized.where(F.col("size") > window + 1), cosine))
    own = store(sized.select("id", *group, "v").unionByName(made.select("id", *group, "v")))
    planted = store(made.groupBy(*group).agg(F.count("*").alias("planted")))
    found, met, first, open_ = [], None, 0, sizes
    largest = limit = sizes.agg(F.max("size")).first()[0] or 0
    while largest:
        need = passes_for(largest, cosine, window, recall)
        if not found:
            limit = PATIENCE * need
        step = 1 if largest <= window + 1 else min(need, limit - first)
        pairs = store(window_pairs(hashes(own.join(open_, group, "left_semi"), step, first=first), cosine, window))
        first += step
        found.append(pairs.where("a >= 0"))
        new = pairs.where("a < 0").select(F.col("a").alias("id"))
        met = store(new if met is None else met.unionByName(new).distinct())
        seen = made.join(met, "id", "left_semi").groupBy(*group).agg(F.count("*").alias("seen"))
        left = open_.join(planted, group).join(seen, group, "left")
        open_ = store(left.where(F.coalesce("seen", F.lit(0)) < recall * F.col("planted")).select(*group, "size"))
        largest = (open_.agg(F.max("size")).first()[0] or 0) if first < limit else 0
    rest = sizes if complete else open_
    least = store(sized.join(rest.drop("size"), group).groupBy(*group).agg(F.min("id").alias("root")))
    every = all_pairs(sized.join(least, group).select("root", "id", "v"), cosine)
    for pairs in found:
        every = every.unionByName(pairs)
    return every.distinct()


def links_within(members: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``id, n``: copies of other rows of the component (``root``) that a row links with.

    ``members`` has ``root, id, v, copies``. A component of several blocks is counted by pairs of blocks;
    many small components share a task.
    """
    cells = _cells(members, block)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, numbers = [], []
        for _, part in pdf.groupby("root", sort=False):
            x, copies, near = _unit(part["v"]), part["copies"].to_numpy(), part["id"].to_numpy()
            one = len(part) and part["i"].iloc[0] == part["j"].iloc[0]
            side = part["own"].to_numpy() == part["i"].iloc[0]
            for mine, rest in [(side, side)] if one else [(side, ~side), (~side, side)]:
                for begin in range(0, int(mine.sum()), 512):
                    take = np.flatnonzero(mine)[begin : begin + 512]
                    hit = x[take] @ x[rest].T >= cosine
                    if one:
                        hit &= near[take][:, None] != near[rest][None, :]
                    ids.append(near[take])
                    numbers.append(hit @ copies[rest])
        return pd.DataFrame(
            {"id": np.concatenate(ids or [np.zeros(0, np.int64)]), "n": np.concatenate(numbers or [np.zeros(0, np.int64)])}
        )

    counted = cells.groupBy("task", "i", "j").applyInPandas(count, "id bigint, n bigint")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    window: int = WINDOW,
    recall: float = RECALL,
    complete: bool = False,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    fit = usable(vector_col) & F.exists(vector_col, lambda x: x != 0) & F.col(label_col).isNotNull()
    fit = F.coalesce(fit & F.col(id_col).isNotNull(), F.lit(False))
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("e"),
        fit.alias("fit"),
    )
    kinds = store(
        rows.where("fit").groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    )
    # a node per label and vector; its number is the smallest vec_id, told apart where ids repeat
    kinds = store(numbered(kinds, F.col("least"), F.col("label"), F.col("e"), name="id"))
    flat = kinds.select("id", "label", F.size("e").alias("width"), F.col("e").cast("array<double>").alias("v"))
    pairs = connecting_pairs(flat, cosine, window, recall, complete)
    roots = store(components(pairs))
    named = roots.withColumnRenamed("node", "id")
    members = store(
        kinds.join(named, "id")
        .unionByName(kinds.withColumn("root", F.col("id")).join(named.select(F.col("root").alias("id")).distinct(), "id"))
        .select("root", "id", "least", "copies", F.col("e").cast("array<double>").alias("v"))
    )
    linked = links_within(members, cosine)
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of_kind = members.select("id", "root").join(least, "root").join(linked, "id").select("id", "n", "component_id")
    of_kind = kinds.join(of_kind, "id", "left").select(
        "label", "e", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    done = rows.where("fit").join(of_kind, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).select(
        "vec_id", "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
