"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node of the edges reaches. Nodes without edges are not returned.

    Rounds of large-star and small-star operations, each a group-by with partial minima, until nothing
    changes: every node ends up tied to its component's least node. A round's table is written to the
    shared folder, so that no lineage grows, and the one before it is deleted. Null ends, loops and repeated
    edges are passed over.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    now = materialize(now, "edges")
    while True:
        both = now.union(now.select(F.col("v"), F.col("u")))
        # Large star: larger neighbours move to the least of a node's neighbourhood.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours, and the node itself, move to the least of them.
        lesser = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = lesser.groupBy("u").agg(F.min("v").alias("m"))
        moved = lesser.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # Both are free of repeats: they are the same if they have as many rows as they share.
        same = new.count() == now.count() == new.join(now, ["u", "v"]).count()
        discard(now)
        now = new
        if same:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
