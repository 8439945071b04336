"""Snapshots of any size as text: a document is written as ordered pieces.

`kvtree.nest` makes one string of a snapshot. Here each node makes two texts, one that opens and one that closes it,
and the document is all of them in the order of an Euler tour. Where a text begins is a running sum of lengths
along the tour, so a task holds the pieces it writes and nothing else, whatever the size of a snapshot or subtree.

The order of the tour needs no tree: a node's names, one below the other, order its opening, and a mark behind them
that sorts after all names below orders its closing. Rows are dealt by ranges of this order and numbered; the sums
run inside the ranges, and one row per snapshot and range carries them over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.operators.kvtree import with_inner_nodes
from pacemark.operators.ordered import previous, running_sum, scan
from pacemark.session import cut

PIECE = 1 << 20  # characters of a piece; the last one of a document may be shorter


def _quoted(text: Column | str) -> Column:
    """A string as JSON writes it."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def tour(nodes: DataFrame, keys: Sequence[str] = ("snapshot",)) -> DataFrame:
    """All openings and closings (``opens``, ``text``) with their place: ``range`` and ``row`` inside the snapshot.

    Commas between siblings are not in the texts: one stands before each opening that follows a closing.
    """
    rows = nodes.select(F.struct(*keys).alias("_snapshot"), "path", "value")
    above = with_inner_nodes(rows, ["_snapshot"]).select("_snapshot", "path")
    missing = above.join(rows, ["_snapshot", "path"], "left_anti").withColumn("value", F.lit(""))
    names = F.filter(F.split("path", "/"), lambda p: p != "")
    place = F.transform(names, lambda p: F.struct(F.lit(1).alias("mark"), p.alias("name")))
    behind = F.array(F.struct(F.lit(2).alias("mark"), F.lit("").alias("name")))
    is_root = F.col("path") == "/"
    name = F.when(is_root, '{"/": ').otherwise(F.concat(_quoted(F.try_element_at(names, F.lit(-1))), F.lit(": ")))
    value = F.when(F.col("value").isNull(), "0").otherwise(_quoted("value"))
    opening = F.concat(name, F.lit("["), value, F.lit(", "), _quoted("path"), F.lit(", {"))
    closing = F.when(is_root, "}]}").otherwise("}]")
    both = F.inline(
        F.array(
            F.struct(place.alias("at"), F.lit(True).alias("opens"), opening.alias("text")),
            F.struct(F.concat(place, behind).alias("at"), F.lit(False).alias("opens"), closing.alias("text")),
        )
    )
    texts = rows.unionByName(missing).select("_snapshot", both)
    order = ["_snapshot", "at"]
    dealt = cut(texts.repartitionByRange(*order).sortWithinPartitions(*order).drop("at"))
    row = F.monotonically_increasing_id()
    return dealt.select("_snapshot", F.shiftright(row, 33).alias("range"), row.alias("row"), "opens", "text")


def nest_pieces(nodes: DataFrame, keys: Sequence[str] = ("snapshot",), size: int = PIECE) -> DataFrame:
    """``keys, piece, text``: the documents of `kvtree.nest`, each in pieces of ``size`` characters from 0 on.

    A text that is longer than a piece is divided. Repeated paths of a snapshot are written repeatedly.
    """
    names = ["_snapshot"]
    known = scan(tour(nodes, keys), names, ["row"], {"_before": previous(F.col("opens"))}, "range")
    follows = F.col("opens") & ~F.coalesce("_before", F.lit(True))
    texts = known.withColumn("text", F.when(follows, F.concat(F.lit(", "), "text")).otherwise(F.col("text")))
    length = F.length("text").cast("bigint")
    placed = scan(texts, names, ["row"], {"_upto": running_sum(length)}, "range")
    begin = F.col("_upto") - length
    spread = placed.select(
        *names,
        "text",
        begin.alias("_begin"),
        F.explode(F.sequence(F.expr(f"(_upto - length(text)) div {size}"), F.expr(f"(_upto - 1) div {size}"))).alias("piece"),
    )
    skip = F.greatest(F.col("piece") * size - F.col("_begin"), F.lit(0).cast("bigint"))
    upto = (F.col("piece") + 1) * size - F.col("_begin")
    part = F.substring("text", (skip + 1).cast("int"), (upto - skip).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("_begin", part.alias("x"))))
    joined = spread.groupBy(*names, "piece").agg(F.array_join(F.transform(listed, lambda t: t["x"]), "").alias("text"))
    return joined.select(*[F.col("_snapshot")[k].alias(k) for k in keys], "piece", "text")
