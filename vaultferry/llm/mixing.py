"""Mixing sources to target weights over a domain, language and source tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultferry.llm.support import stored

# Leaves that may be sent to every executor (about 100 bytes each).
BROADCAST_LEAVES = 100_000
# The order hash has 60 bits; its upper 12 name one of 4096 slices of a leaf.
SLICE = 1 << 48
SPACE = r"[ \t\n\r\f\x0B]+"


@dataclass(frozen=True)
class Mix:
    """Targets of a mix.

    ``weights`` has one mapping per level, from a node's name to its weight among its
    siblings; names that are not listed weigh 1. ``share`` is the token budget as a part of
    all tokens, ``tokens`` the budget itself, if given. A leaf is read ``epochs`` times at most.
    """

    weights: Sequence[Mapping[str, float]] = field(default_factory=lambda: ({}, {}, {}))
    share: float = 0.7
    tokens: int | None = None
    epochs: int = 4
    seed: int = 17


LEVELS = ("domain", "lang", "source")


def tokens(text: Column) -> Column:
    """Words between white space; null and empty texts have none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), ""))


def domain_of(source: Column, domains: Sequence[str]) -> Column:
    """Domain of a source: its number modulo the number of domains; without a number, the first."""
    number = F.coalesce(F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in domains]), (number % len(domains)) + 1)


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a document in the shuffled order of an epoch, 60 bits."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _key(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("string"), F.md5(F.coalesce(docs["text"], F.lit(""))))


def _weight(level: int, mix: Mix) -> Column:
    value = F.lit(1.0)
    for name, weight in mix.weights[level].items():
        value = F.when(F.col(LEVELS[level]) == name, F.lit(float(weight))).otherwise(value)
    return value


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Token quota of every leaf of ``leaves(domain, lang, source, supply)``.

    Supplies are summed up the tree. From the root down, each node shares its budget among
    its children by weight; a child never gets more than its whole subtree can supply, and
    what it leaves goes to its siblings. So a shortage is made up by siblings first and
    reaches a higher level only when all of them are exhausted. Per node this is one pass:
    children sorted by supply per weight, exhausted ones first, share what the ones before
    them have left.
    """
    everything = leaves.agg(F.sum("supply")).first()[0] or 0
    budget = everything / mix.epochs * mix.share if mix.tokens is None else mix.tokens
    node = None
    for level in range(len(LEVELS)):
        names = list(LEVELS[: level + 1])
        above = names[:-1]
        children = leaves.groupBy(*names).agg(F.sum("supply").cast("double").alias("cap"))
        children = children.withColumn("weight", _weight(level, mix)).where("weight > 0")
        if node is None:
            given = children.withColumn("budget", F.lit(float(min(budget, everything))))
        else:
            given = children.join(node, above)
        ordered = Window.partitionBy(*above).orderBy(F.col("cap") / F.col("weight"), names[-1])
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        rate = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
            "weight"
        ).over(onward)
        # The rate falls while children are exhausted; from the first that is not, it holds.
        rated = given.withColumn("rate", rate)
        full = F.when(F.col("cap") > F.col("rate") * F.col("weight"), F.col("rate"))
        held = rated.withColumn("held", F.max(full).over(Window.partitionBy(*above)))
        part = F.coalesce(F.least(F.col("cap"), F.col("held") * F.col("weight")), F.col("cap"))
        node = held.select(*names, F.greatest(part, F.lit(0.0)).alias("budget"))
    return node.select(*LEVELS, F.floor(F.round("budget", 3)).cast("bigint").alias("quota"))


def _with_leaves(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Join on the leaf: broadcast while the leaves are few, else shuffled and split if hot."""
    small = leaves.count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if small else leaves, list(LEVELS))


def leaf_plan(docs: DataFrame, domain: Column, mix: Mix) -> DataFrame:
    """Per leaf: quota, whole epochs, and where the prefix of the next epoch ends.

    ``cut`` is the order hash of the last document taken from the epoch ``full`` and ``rest``
    the tokens taken of it; documents with a smaller hash are taken whole. A leaf is cut
    into 4096 slices by hash, whose sums find the slice with the cut; only that slice is
    sorted, so a hot leaf is never in one task.
    """
    rows = stored(
        docs.select(
            domain.alias("domain"),
            F.coalesce(docs["lang"], F.lit("")).alias("lang"),
            F.coalesce(docs["source"], F.lit("")).alias("source"),
            _key(docs).alias("key"),
            tokens(docs["text"]).cast("bigint").alias("tokens"),
        ),
        "mix-rows",
    )
    totals = stored(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("total")), "mix-leaves")
    supply = totals.withColumn("supply", F.col("total") * mix.epochs)
    quotas = (
        totals.join(budgets(supply, mix), list(LEVELS))
        .withColumn("full", F.when(F.col("total") > 0, F.expr("quota div total")).otherwise(0))
        .withColumn("left", F.col("quota") - F.col("full") * F.col("total"))
    )
    quotas = stored(quotas.withColumn("full", F.col("full").cast("int")), "mix-quotas")
    hashed = _with_leaves(rows, quotas.where("left > 0")).select(
        *LEVELS, "left", "tokens", order_hash(mix.seed, F.col("full"), F.col("key")).alias("place")
    )
    hashed = hashed.withColumn("slice", F.expr(f"place div {SLICE}"))
    sums = hashed.groupBy(*LEVELS, "left", "slice").agg(F.sum("tokens").alias("tokens"))
    along = Window.partitionBy(*LEVELS).orderBy("slice")
    edge = (
        sums.withColumn("upto", F.sum("tokens").over(along))
        .where("upto >= left and upto - tokens < left")
        .select(*LEVELS, "slice", (F.col("upto") - F.col("tokens")).alias("before"))
    )
    edge = stored(edge, "mix-edges")
    few = edge.count() <= BROADCAST_LEAVES
    inside = hashed.join(F.broadcast(edge) if few else edge, [*LEVELS, "slice"])
    by_place = inside.groupBy(*LEVELS, "left", "before", "place").agg(
        F.sum("tokens").alias("tokens")
    )
    start = F.col("before") + F.sum("tokens").over(
        Window.partitionBy(*LEVELS).orderBy("place")
    ) - F.col("tokens")
    last = (
        by_place.withColumn("start", start)
        .where("start < left")
        .groupBy(*LEVELS)
        .agg(F.max(F.struct("place", (F.col("left") - F.col("start")).alias("rest"))).alias("end"))
        .select(*LEVELS, F.col("end.place").alias("cut"), F.col("end.rest").alias("rest"))
    )
    plan = quotas.join(last, list(LEVELS), "left").select(
        *LEVELS, "total", "quota", "full", F.coalesce("cut", F.lit(-1)).alias("cut"), "rest"
    )
    return stored(plan, "mix-plan")


def mixed_documents(docs: DataFrame, domain: Column, mix: Mix) -> DataFrame:
    """Documents of a mix, one row per epoch they are read in.

    ``docs`` has ``doc_id, text, lang, source``; ``domain`` is an expression over it. Returns
    ``row`` (all columns of the input as one struct), the leaf, ``epoch``, ``n_tokens`` and
    ``tokens_taken``, which is less than ``n_tokens`` for the document the quota ends in.
    The texts are not shuffled: whether a row is taken follows from its leaf's plan and its
    own hash. Null languages and sources are a leaf named by the empty string. Rows with
    equal ``doc_id`` have one place and are taken together; documents without words are
    taken when their place is before the cut. An empty table gives no rows.
    """
    plan = leaf_plan(docs, domain, mix)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        domain.alias("domain"),
        F.coalesce(docs["lang"], F.lit("")).alias("lang"),
        F.coalesce(docs["source"], F.lit("")).alias("source"),
        _key(docs).alias("key"),
        tokens(docs["text"]).cast("bigint").alias("n_tokens"),
    )
    placed = _with_leaves(rows, plan).withColumn(
        "place", order_hash(mix.seed, F.col("full"), F.col("key"))
    )
    reads = F.col("full") + (F.col("place") <= F.col("cut")).cast("int")
    spread = placed.withColumn("reads", reads).where("reads > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("reads") - 1)).alias("epoch")
    )
    ends = (F.col("epoch") == F.col("full")) & (F.col("place") == F.col("cut"))
    taken = F.when(ends, F.least("n_tokens", "rest")).otherwise(F.col("n_tokens"))
    return spread.select("row", *LEVELS, "epoch", "n_tokens", taken.alias("tokens_taken"))
