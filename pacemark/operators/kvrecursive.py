"""Flattening of snapshots by a recursive query over VARIANT values.

`kvtree.flatten` unrolls one plan step per level and asks the documents for their depth first. Here the plan is
recursive: it starts with the root of each document and goes on with the children of the nodes found last, until
no node has any. Documents of any and unequal depth take as many rounds as the deepest one; nothing about them
reaches the driver but the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.session import cut, settings


def flatten(documents: DataFrame, keys: Sequence[str] = ("snapshot",), text: str = "doc") -> DataFrame:
    """``keys, depth, path, name, parent, value`` of each node, as `kvtree.flatten`.

    Texts that are no JSON object have no nodes. The result is stored, since limits on recursion are lifted only here.
    """
    spark = documents.sparkSession
    read = documents.select(F.struct(*keys).alias("_keys"), F.try_parse_json(text).alias("_tree"))
    with settings(spark, cteRecursionLevelLimit=-1, cteRecursionRowLimit=-1):
        nodes = cut(
            spark.sql(
                """
                with recursive node (keys, depth, name, tree) as (
                  select d._keys, 0, c.key, c.value
                  from {documents} d, lateral variant_explode(d._tree) c
                  where c.key is not null
                  union all
                  select n.keys, n.depth + 1, c.key, c.value
                  from node n, lateral variant_explode(variant_get(n.tree, '$[2]', 'variant')) c
                  where c.key is not null
                )
                select keys, depth, name, variant_get(tree, '$[1]', 'string') as path,
                  variant_get(tree, '$[0]', 'string') as value
                from node
                """,
                documents=read,
            )
        )
    return nodes.select(
        *[F.col("keys")[k].alias(k) for k in keys],
        "depth",
        "path",
        "name",
        F.when(F.col("depth") > 0, F.regexp_replace("path", "[^/]+/$", "")).alias("parent"),
        "value",
    )
