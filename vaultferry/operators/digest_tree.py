"""Reconciliation through digest trees: only what differs is compared row by row.

Each side is reduced to one digest per bucket of its keys: number of rows and two sums of row
hashes, which do not depend on order and combine before the shuffle. Digests of sixteen buckets
add up to that of the node above, so two sides, or a side and a stored tree, are compared from
the root down, and where nodes agree nothing below is looked at. A tree has a fixed number of
rows whatever the size of its side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.operators.reconcile import reconcile_items
from vaultferry.session import durable

FAN, DEPTH = 16, 4
BUCKETS = FAN**DEPTH
# Buckets that are named in a filter; more are joined.
FEW = 200
DIGEST = ("rows", "mixed", "total")


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _hashed(rows: DataFrame, *columns: str) -> DataFrame:
    """Bucket and two hashes of each row; nulls differ from every value."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    return rows.select(
        bucket_of(F.col("idempotency_key")).alias("node"),
        F.xxhash64(F.lit("x"), *shown).alias("h"),
        F.xxhash64(F.lit("y"), *shown).cast("decimal(38, 0)").alias("g"),
    )


def digest_tree(side: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(level, node, rows, mixed, total) of one side's items and, if given, part lists.

    Level 0 holds the buckets; nodes without rows are left out. The side is read once: its
    buckets are kept, and the levels above are sums of them.
    """
    rows = _hashed(side, "idempotency_key", "target_archive", "legal_hold")
    if parts is not None:
        rows = rows.unionByName(_hashed(parts, "idempotency_key", "pos", "sha256"))
    level = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("mixed"), F.sum("g").alias("total")
    )
    level = durable(level)
    tree = level.select(F.lit(0).alias("level"), "node", *DIGEST)
    for n in range(1, DEPTH + 1):
        width = FAN**n
        above = level.groupBy(F.expr(f"node div {width}").alias("node")).agg(
            F.sum("rows").alias("rows"), F.bit_xor("mixed").alias("mixed"), F.sum("total").alias("total")
        )
        tree = tree.unionByName(above.select(F.lit(n).alias("level"), "node", *DIGEST))
    return tree


def within(rows: DataFrame, node: Column, nodes: list[int]) -> DataFrame:
    """Rows whose node is listed. The list has ``BUCKETS`` numbers at most, half a megabyte."""
    if len(nodes) <= FEW:
        return rows.where(node.isin(nodes) if nodes else F.lit(False))
    listed = rows.sparkSession.createDataFrame([(n,) for n in nodes], "_node bigint")
    return rows.join(F.broadcast(listed), node == F.col("_node"), "left_semi")


def differing_buckets(ours: DataFrame, theirs: DataFrame) -> list[int]:
    """Buckets in which two trees differ, found from the root down.

    A level is read only below nodes that differ; at most ``BUCKETS`` numbers come back.
    """
    nodes: list[int] | None = None
    for level in range(DEPTH, -1, -1):
        both = []
        for tree in (ours, theirs):
            here = tree.where(F.col("level") == level)
            if nodes is not None:
                here = within(here, F.expr(f"node div {FAN}"), nodes)
            both.append(here.select("node", *[F.col(c) for c in DIGEST]))
        left, right = both
        # A row that both have is taken twice; what is left differs or is on one side only.
        changed = left.unionAll(right).groupBy("node", *DIGEST).count().where("count = 1")
        nodes = sorted(r["node"] for r in changed.select("node").distinct().collect())
        if not nodes:
            return []
    return nodes or []


def reconcile_by_digest(
    local: DataFrame,
    target: DataFrame,
    local_parts: DataFrame | None = None,
    target_parts: DataFrame | None = None,
    target_tree: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``reconcile_items``, joined in buckets that differ only.

    Where most buckets differ, both sides are joined as they are.
    ``target_tree`` may be a stored tree of the target; then its rows are read for
    differing buckets alone.
    """
    theirs = digest_tree(target, target_parts) if target_tree is None else target_tree
    nodes = differing_buckets(digest_tree(local, local_parts), theirs)

    def cut(rows: DataFrame | None) -> DataFrame | None:
        if rows is None or len(nodes) > BUCKETS // 2:
            return rows
        return within(rows, bucket_of(F.col("idempotency_key")), nodes)

    return reconcile_items(cut(local), cut(target), cut(local_parts), cut(target_parts))
