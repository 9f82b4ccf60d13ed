"""Connected components of an undirected graph as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultferry.llm.support import stored


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node for every node of ``links(a, b)``: ``(node, component)``.

    Union-find in rounds: every root hooks onto its smallest neighbour, the chains that
    arise are shortened by pointer jumping, and the links are rewritten between roots.
    Hooks point to smaller nodes only, so they form a forest. Each round is an aggregate
    and joins on stored tables; nothing reaches the driver but row counts.
    """
    edges = stored(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")),
        "links",
    )
    # Every node with its smallest neighbour: the first labels and the first hooks at once.
    ends = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nearest = stored(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "nearest")
    labels = nearest.select("node", F.col("node").alias("component"))
    hooks = nearest.where("up < node").select(F.col("node").alias("root"), "up")
    first = True
    while not edges.isEmpty():
        if not first:
            least = edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up"))
            hooks = stored(least, "hooks")
        first = False
        while True:
            above = hooks.select(F.col("root").alias("up"), F.col("up").alias("higher"))
            jumped = stored(
                hooks.join(above, "up", "left").select(
                    "root",
                    F.coalesce("higher", "up").alias("up"),
                    F.col("higher").isNotNull().alias("moved"),
                ),
                "jumps",
            )
            hooks = jumped.select("root", "up")
            if jumped.where("moved").isEmpty():
                break
        new_label = hooks.select(F.col("root").alias("component"), "up")
        labels = stored(
            labels.join(new_label, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")
            ),
            "labels",
        )
        at_a = hooks.select(F.col("root").alias("a"), F.col("up").alias("up_a"))
        at_b = hooks.select(F.col("root").alias("b"), F.col("up").alias("up_b"))
        moved = (
            edges.join(at_a, "a", "left")
            .join(at_b, "b", "left")
            .select(F.coalesce("up_a", "a").alias("x"), F.coalesce("up_b", "b").alias("y"))
            .where("x <> y")
        )
        edges = stored(
            moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
    return labels
