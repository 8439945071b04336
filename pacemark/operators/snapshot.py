"""Histories and announced periods in the key–value tree: to snapshot nodes and back.

Nodes have ``path`` and ``value``; the key columns name the tree, one per cluster. Paths may end with a
slash or not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.functions.periods import PERIOD_DEFAULT
from pacemark.operators.history import restored_period, whole

# Places in the tree.
PERIOD = "/checkpoint/period/"
SERIES_NODE = r"^/historic/(mtbf|checkpoint)/$"
SLOT_NODE = r"^/historic/(mtbf|checkpoint)/zn(\d+)/$"
LAST_FAILURE = "/historic/mtbf/tslf/"
ELAPSED = "/historic/mtbf/tebi/"


def _closed(path: str = "path"):
    return F.concat(F.rtrim(path, F.lit("/")), F.lit("/"))


def to_nodes(
    rings: DataFrame, periods: DataFrame, keys: Sequence[str] = ("cluster",)
) -> DataFrame:
    """Nodes of ring slots (``series``, ``slot``, ``value``, ``pointer``) and announced ``period``."""
    base = F.concat(F.lit("/historic/"), "series", F.lit("/"))
    slots = rings.select(
        *keys,
        F.concat(base, F.lit("zn"), "slot", F.lit("/")).alias("path"),
        F.col("value").cast("string").alias("value"),
    )
    pointers = rings.groupBy(*keys, base.alias("path")).agg(
        F.max("pointer").cast("string").alias("value")
    )
    announced = periods.select(
        *keys, F.lit(PERIOD).alias("path"), F.col("period").cast("string").alias("value")
    )
    return slots.unionByName(pointers).unionByName(announced)


def rings_of(nodes: DataFrame, keys: Sequence[str] = ("cluster",)) -> DataFrame:
    """Ring content: ``series``, ``slot``, ``value`` and the ``pointer`` of the series.

    Slots beyond an unreadable pointer count from the highest slot.
    """
    path = _closed()
    slots = nodes.where(path.rlike(SLOT_NODE)).select(
        *keys,
        F.regexp_extract(path, SLOT_NODE, 1).alias("series"),
        F.regexp_extract(path, SLOT_NODE, 2).cast("int").alias("slot"),
        whole(F.col("value")).alias("value"),
    )
    pointers = nodes.where(path.rlike(SERIES_NODE)).select(
        *keys,
        F.regexp_extract(path, SERIES_NODE, 1).alias("series"),
        F.col("value").try_cast("double").cast("int").alias("pointer"),
    )
    highest = slots.groupBy(*keys, "series").agg(F.max("slot").alias("_top"))
    known = highest.join(pointers, [*keys, "series"], "left").select(
        *keys, "series", F.coalesce("pointer", "_top").alias("pointer")
    )
    return slots.join(known, [*keys, "series"])


def clusters_of(nodes: DataFrame, keys: Sequence[str] = ("cluster",)) -> DataFrame:
    """Announced period, last failure anchor and stored elapsed time of each tree.

    A period that is no number counts as 0; a tree without one has the default.
    """
    path = _closed()

    def at(place: str):
        return F.max(F.when(path == place, F.col("value")))

    return nodes.groupBy(*keys).agg(
        F.when(F.max(path == PERIOD), restored_period(at(PERIOD)))
        .otherwise(PERIOD_DEFAULT)
        .alias("period"),
        whole(at(LAST_FAILURE).try_cast("double")).alias("failed_at"),
        F.coalesce(whole(at(ELAPSED).try_cast("double")), F.lit(0)).alias("elapsed"),
    )
