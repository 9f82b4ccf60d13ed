"""Merkle manifest of a dataset: a digest for every row, subtree and the whole, with proofs.

A level of a block of 512 consecutive nodes is one string of 64 hex digits per node. Parents
are digests of its fixed-width substrings of eight nodes, and the substrings left and right of
a node within its eight are its siblings. The roots of the blocks are the nodes of the next
round, so a tree of any size takes one round per factor of 512.

Defined cases: null columns give ``-``; an empty text is ``0:``. Rows of one language stand by
``doc_id``, null first, rows with the same id by leaf digest; rows equal in all five columns are
interchangeable leaves. A language that is null is a tree of its own and comes first. A null id
is never altered. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultferry.llm.support import stored

FANOUT = 8
HEX = 64
# Levels that one block holds, and its nodes.
LEVELS = 3
BLOCK = FANOUT**LEVELS
PATH = "array<struct<before: string, after: string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")
    )


def leaf_digest(text: Column) -> Column:
    fields = [encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*fields, encoded(text)), 256)


def tampered(doc_id: Column) -> Column:
    """Whether three divides the id's checksum; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``pos``, the place of a row among those of its key, and ``total``, their number.

    A range sort cuts a large key over many partitions. The sorted rows are stored; the row
    number carries the partition in its upper bits, so a row's place is its distance from the
    first row of its key in the partition, plus the rows of the partitions before. ``order``
    must not tie for long: ties stay in one partition.
    """
    placed = rows.orderBy(*keys, *order).withColumn("row", F.monotonically_increasing_id())
    placed = stored(placed, name).withColumn("slice", F.shiftright("row", 33))
    slices = placed.groupBy(*keys, "slice").agg(
        F.min("row").alias("first"), F.count(F.lit(1)).alias("size")
    )
    spans = _running(slices, keys)
    joined = placed.alias("p").join(spans.alias("s"), _same([*keys, "slice"], "p", "s"))
    return joined.select(
        *[F.col(f"p.{c}") for c in rows.columns],
        (F.col("p.row") - F.col("s.first") + F.col("s.before")).alias("pos"),
        F.col("s.total").alias("total"),
    )


def _running(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a key before each slice and in all; a key has one slice a partition at most."""
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.select(
        *keys,
        "slice",
        "first",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"),
        F.sum("size").over(whole).alias("total"),
    )


def _cut(digits: Column, start: Column, size: Column) -> Column:
    """A fixed-width piece, taken by bytes: counting characters would read all before it."""
    return F.substring(digits.cast("binary"), start, size)


def _parents(level: Column) -> Column:
    """The next level of a block: digests of each eight nodes of its string."""
    width = FANOUT * HEX
    runs = F.ceil(F.octet_length(level) / width).cast("int")
    hashed = F.transform(
        F.sequence(F.lit(0), runs - 1),
        lambda i: F.sha2(_cut(level, i * width + 1, F.lit(width)), 256),
    )
    return F.array_join(hashed, "")


def _depth(total: Column) -> Column:
    """Levels above ``total`` nodes until one is left."""
    depth = F.lit(0)
    for n in range(21):
        depth = depth + F.when(total > FANOUT**n, 1).otherwise(0)
    return depth


def _blocks(nodes: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Blocks of consecutive nodes with their levels as strings and the root of each.

    ``nodes`` has the keys, ``pos``, ``node``, ``left`` (levels of the tree still to build)
    and the columns of ``carry``, which is kept beside each node. A block holds 512 nodes at
    most, however many rows its key has.
    """
    carry = ["pos", *[c for c in nodes.columns if c not in (*keys, "left", "pos")]]
    held = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy(
        *keys, "left", "block"
    )
    blocks = held.agg(F.array_sort(F.collect_list(F.struct(*carry))).alias("nodes"))
    blocks = blocks.withColumn("level0", F.array_join("nodes.node", ""))
    for n in range(LEVELS):
        here = F.col(f"level{n}")
        up = F.when(F.col("left") > n, _parents(here)).otherwise(here)
        blocks = blocks.withColumn(f"level{n + 1}", up)
    return stored(blocks, name)


def _path(place: Column) -> Column:
    """Hex digits left and right of a node within its eight, for each level of its block."""
    found = []
    for n in range(LEVELS):
        node = F.shiftright(place, 3 * n)
        inside = F.pmod(node, F.lit(FANOUT)).cast("int")
        start = ((node - inside) * HEX + 1).cast("int")
        eight = _cut(F.col(f"level{n}"), start, F.lit(FANOUT * HEX))
        pair = F.struct(
            _cut(eight, F.lit(1), inside * HEX).cast("string").alias("before"),
            _cut(eight, (inside + 1) * HEX + 1, F.lit(FANOUT * HEX)).cast("string").alias("after"),
        )
        found.append(F.when(F.col("left") > n, pair))
    return F.filter(F.array(*found), lambda pair: pair.isNotNull())


def tree(
    nodes: DataFrame, keys: Sequence[str], name: str
) -> tuple[DataFrame, DataFrame]:
    """Roots by key, and the first blocks with the siblings above each block's root.

    ``nodes`` has the keys, ``pos``, ``total``, ``node`` and columns to carry along.
    """
    level = nodes.withColumn("left", _depth(F.col("total"))).drop("total")
    rounds: list[DataFrame] = []
    while True:
        blocks = _blocks(level, keys, f"{name}-{len(rounds)}")
        rounds.append(blocks)
        rest = F.greatest(F.col("left") - LEVELS, F.lit(0))
        level = blocks.select(
            *keys, F.col("block").alias("pos"), F.col(f"level{LEVELS}").alias("node"), rest.alias("left")
        )
        if level.where("left > 0").isEmpty():
            break
    roots = level.select(*keys, F.col("node").alias("top"))
    above = rounds[-1].withColumn("above", F.array().cast(PATH))
    for lower in reversed(rounds[:-1]):
        # Each block below is a node of one block here.
        parents = _nodes(above, keys)
        parents = parents.select(
            *keys, F.col("node.pos").alias("block"), F.concat(_path(F.col("place")), "above").alias("above")
        )
        joined = lower.alias("l").join(parents.alias("u"), _same([*keys, "block"], "l", "u"))
        above = joined.select("l.*", "u.above")
    return roots, above


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    """Equal keys, nulls included."""
    return reduce(
        lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    )


def _nodes(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per node of each block: its place, its values, and the block's strings."""
    levels = [f"level{n}" for n in range(LEVELS)]
    return blocks.select(*keys, F.posexplode("nodes").alias("place", "node"), "left", *levels, "above")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(
        path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256)
    )


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Digest, proof and check of every document.

    Leaves are digested once and stored; texts are not moved. Each leaf travels with its block
    of 512 at most. The subroots of the languages are numbered and folded by the same rounds,
    so there may be as many languages as there are documents.
    """
    lowered = leaf_digest(F.translate(F.col("text"), UPPER, LOWER))
    leaves = docs.select(
        "doc_id",
        "lang",
        leaf_digest(F.col("text")).alias("node"),
        F.when(tampered(F.col("doc_id")), lowered).alias("altered"),
        # Spreads rows that are equal in all columns over partitions.
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = stored(leaves, "leaves")
    placed = numbered(leaves, ["lang"], ["doc_id", "node", "tie"], "sorted").drop("tie")
    subroots, blocks = tree(placed, ["lang"], "tree")
    subroots = stored(subroots, "subroots")
    tops = numbered(subroots.withColumnRenamed("top", "node"), [], ["lang"], "tops")
    roots, groups = tree(tops, [], "root")
    ways = _nodes(groups, []).select(
        F.col("node.lang").alias("lang"),
        F.col("node.node").alias("subroot"),
        F.concat(_path(F.col("place")), "above").alias("upper"),
    )
    ways = stored(ways.withColumn("root", roots.select("top").scalar()), "ways")
    joined = blocks.alias("b").join(ways.alias("w"), _same(["lang"], "b", "w"))
    joined = joined.select("b.*", "w.subroot", "w.root", "w.upper")
    each = _nodes(joined, ["subroot", "root", "upper"]).select(
        "node", "subroot", "root", F.concat(_path(F.col("place")), "above", "upper").alias("path")
    )
    siblings = F.transform("path", lambda s: F.concat(s["before"], s["after"]))
    shown = each.select(
        F.col("node.doc_id").alias("doc_id"),
        F.col("node.node").alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        folded(F.coalesce("node.altered", "node.node"), F.col("path")).alias("folded_root"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
