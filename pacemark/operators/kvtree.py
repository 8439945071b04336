"""Snapshots of a key–value tree: flatten, nest, upsert, difference.

A snapshot document is JSON: a node is ``[value, absolute path, {name: node}]`` and the document
``{"/": root}``. Paths end with a slash. The flat form has one row per node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacemark.session import cut

CREATED, MODIFIED, UNCHANGED = "Created", "Modified", "Unchanged"


def flatten(
    documents: DataFrame, keys: Sequence[str] = ("snapshot",), text: str = "doc"
) -> DataFrame:
    """One row per node: ``depth``, ``path``, ``name``, ``parent``, ``value``.

    The trees are taken apart level by level as VARIANT values. The number of levels is the deepest
    nesting of braces outside of strings in a document that is JSON; only that number reaches the
    driver. Other documents have no nodes.
    """
    names = list(keys)
    # possessive: the engine goes through a string in a loop, however long it is
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "")
    braces = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    step = F.create_map(F.lit("{"), F.lit(1), F.lit("}"), F.lit(-1))
    nesting = F.aggregate(
        braces,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda a, x: F.struct(
            (a["now"] + F.coalesce(step[x], F.lit(0))).alias("now"),
            F.greatest(a["top"], a["now"] + F.coalesce(step[x], F.lit(0))).alias("top"),
        ),
        lambda a: a["top"],
    )
    is_json = F.try_parse_json(text).isNotNull()
    levels = (documents.agg(F.max(F.when(is_json, nesting))).first()[0] or 1) - 1

    def children(node: Column, depth: int) -> Column:
        named = F.map_entries(F.variant_get(node, "$", "map<string, variant>"))
        return F.transform(
            named,
            lambda e: F.struct(
                e["key"].alias("name"), e["value"].alias("node"), F.lit(depth).alias("depth")
            ),
        )

    flat = documents.select(*names, F.inline(children(F.try_parse_json(text), 0)))
    itself = F.array(F.struct("name", "node", "depth"))
    for depth in range(1, levels):
        # nodes of the level before make room for their children, all others pass
        kids = children(F.variant_get("node", "$[2]", "variant"), depth)
        opens = (F.col("depth") == depth - 1) & kids.isNotNull()
        flat = flat.select(*names, F.inline(F.when(opens, F.concat(itself, kids)).otherwise(itself)))
    path = F.variant_get("node", "$[1]", "string")
    return flat.select(
        *names,
        "depth",
        path.alias("path"),
        "name",
        F.when(F.col("depth") > 0, F.regexp_replace(path, "[^/]+/$", "")).alias("parent"),
        F.variant_get("node", "$[0]", "string").alias("value"),
    )


def with_inner_nodes(leaves: DataFrame, keys: Sequence[str] = ("snapshot",)) -> DataFrame:
    """Add the missing ancestors of all paths, with empty values."""
    parts = F.split(F.trim("path", F.lit("/")), "/")
    deep = F.when(F.col("path") == "/", 0).otherwise(F.size(parts))
    every = leaves.select(
        *keys,
        F.explode(
            F.transform(
                F.sequence(F.lit(0), deep),
                lambda i: F.when(i == 0, F.lit("/")).otherwise(
                    F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))
                ),
            )
        ).alias("path"),
        F.lit(None).cast("string").alias("value"),
    )
    return (
        leaves.select(*keys, "path", "value")
        .unionByName(every)
        .groupBy(*keys, "path")
        .agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))
    )


def nest(nodes: DataFrame, keys: Sequence[str] = ("snapshot",)) -> DataFrame:
    """One JSON document per snapshot from its flat nodes (``path``, ``value``).

    Works from the deepest level up with one grouping per level; the driver only learns the depth. A
    NULL value is written as 0. Children are in the order of their names; missing ancestors are added
    with empty values. A document is one string, so a snapshot has to fit one; many snapshots are worked
    off side by side. A NULL key is a snapshot like any other.
    """
    names = ["_snapshot"]
    nodes = nodes.select(F.struct(*keys).alias("_snapshot"), "path", "value")
    above = with_inner_nodes(nodes, names).select(*names, "path")
    missing = above.join(nodes, [*names, "path"], "left_anti")
    nodes = nodes.unionByName(missing.withColumn("value", F.lit("")))
    depth = F.when(F.col("path") == "/", 0).otherwise(
        F.size(F.split(F.trim("path", F.lit("/")), "/"))
    )
    def quoted(column: str) -> Column:
        listed = F.to_json(F.array(column))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    shaped = nodes.select(
        *names,
        "path",
        depth.alias("_depth"),
        F.when(F.col("path") != "/", F.regexp_replace("path", "[^/]+/$", "")).alias("_parent"),
        F.element_at(F.split(F.trim("path", F.lit("/")), "/"), -1).alias("_name"),
        F.when(F.col("value").isNull(), "0").otherwise(quoted("value")).alias("_v"),
    )
    flat = cut(shaped)  # read once per level
    head = F.concat(F.lit("["), F.col("_v"))

    top = flat.agg(F.max("_depth")).first()[0] or 0
    below: DataFrame | None = None
    for d in range(top, -1, -1):
        here = flat.where(F.col("_depth") == d)
        if below is None:
            here = here.withColumn("_kids", F.lit(None).cast("string"))
        else:
            here = here.join(below, [*names, "path"], "left")
        text = F.concat(
            head, F.lit(", "), quoted("path"), F.lit(", {"), F.coalesce("_kids", F.lit("")), F.lit("}]")
        )
        written = here.withColumn("_text", text)
        if d == 0:
            return written.select(
                *[F.col("_snapshot")[k].alias(k) for k in keys],
                F.concat(F.lit('{"/": '), F.col("_text"), F.lit("}")).alias("doc"),
            )
        below = (
            written.select(
                *names,
                F.col("_parent").alias("path"),
                F.struct(
                    F.col("_name"), F.concat(quoted("_name"), F.lit(": "), F.col("_text")).alias("x")
                ).alias("_kid"),
            )
            .groupBy(*names, "path")
            .agg(F.sort_array(F.collect_list("_kid")).alias("_k"))
            .select(
                *names, "path", F.array_join(F.transform("_k", lambda k: k["x"]), ", ").alias("_kids")
            )
        )
    raise AssertionError("unreachable")


def upsert(
    current: DataFrame, changes: DataFrame, keys: Sequence[str] = ("path",)
) -> DataFrame:
    """State after writing ``changes`` (one row per key), and what happened to each key.

    ``action`` is Created or Modified for written keys and Unchanged for the others.
    """
    names = list(keys)
    a = current.select(*names, F.col("value").alias("_old"), F.lit(True).alias("_had"))
    b = changes.select(*names, F.col("value").alias("_new"), F.lit(True).alias("_set"))
    action = (
        F.when(F.col("_set").isNull(), UNCHANGED)
        .when(F.col("_had").isNull(), CREATED)
        .otherwise(MODIFIED)
    )
    return a.join(b, names, "full").select(
        *names,
        F.when(F.col("_set"), F.col("_new")).otherwise(F.col("_old")).alias("value"),
        action.alias("action"),
    )


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Each path of ``after`` as Created, Modified or Unchanged; paths only in ``before`` as Removed."""
    names = list(keys)
    a = before.select(*names, F.col("value").alias("old_value"), F.lit(True).alias("_a"))
    b = after.select(*names, F.col("value").alias("new_value"), F.lit(True).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), CREATED)
        .when(F.col("_b").isNull(), "Removed")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), UNCHANGED)
        .otherwise(MODIFIED)
    )
    return a.join(b, names, "full").select(
        *names, "old_value", "new_value", change.alias("change")
    )
