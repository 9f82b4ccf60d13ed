"""Target statistics and the comparison of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of a sketch of distinct hashes: 2^14 registers, 12 KB.
SKETCH_BITS = 14


def target_stats(
    registry: DataFrame, part_store: DataFrame, attempts: DataFrame | None = None
) -> DataFrame:
    """One row: items and parts the target holds, items with a known part, refused deliveries."""
    names = ("total_ingested", "deduped_parts", "unique_parts", "rejected_429", "transient_503")

    def counted(rows: DataFrame, **flags: Column) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return rows.select(
            *[flags[c].cast("bigint").alias(c) if c in flags else zero.alias(c) for c in names]
        )

    # Each table is read once; its rows carry the counters they raise.
    rows = counted(
        registry,
        total_ingested=F.lit(1),
        deduped_parts=F.coalesce(F.col("deduped"), F.lit(False)),
    ).unionByName(counted(part_store.select("sha256").distinct(), unique_parts=F.lit(1)))
    if attempts is not None:
        status = F.coalesce("http_status", F.lit(0))
        rows = rows.unionByName(
            counted(attempts, rejected_429=status == 429, transient_503=status == 503)
        )
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names])


def part_sketch(parts: DataFrame) -> DataFrame:
    """One row to store with a batch of parts: their number and a sketch of their hashes."""
    return parts.agg(
        F.count(F.lit(1)).alias("parts"), F.hll_sketch_agg("sha256", F.lit(SKETCH_BITS)).alias("sketch")
    )


def target_stats_approx(sketches: DataFrame) -> DataFrame:
    """Parts and different parts over all batches, from their sketches alone.

    The standard error is 0.83 / 2^(SKETCH_BITS / 2), about 0.65 %; no part row is read.
    """
    return sketches.agg(
        F.coalesce(F.sum("parts"), F.lit(0)).cast("bigint").alias("parts"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("unique_parts"),
    )


def ingested_by_target(registry: DataFrame) -> DataFrame:
    return registry.groupBy("target_archive").agg(F.count(F.lit(1)).alias("ingested"))


def reconcile_totals(events: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Local and target totals per run, as the totals-only report has them.

    The target total is over all runs and -1 when the target cannot be asked.
    """
    local = events.groupBy("run_id").agg(
        F.count_if(F.col("event_type").isin("ItemMigrated", "ItemAlreadyPresent")).alias(
            "local_total"
        )
    )
    if registry is None:
        target = F.lit(-1).cast("bigint")
    else:
        target = registry.agg(F.count(F.lit(1))).scalar()
    both = local.withColumn("target_total", target)
    known = F.col("target_total") >= 0
    gap = F.col("local_total") - F.col("target_total")
    missing = F.when(known & (gap > 0), gap).otherwise(0).cast("bigint")
    unexpected = F.when(known & (gap < 0), -gap).otherwise(0).cast("bigint")
    note = (
        F.when(~known, "target stats unavailable, cannot reconcile")
        .when(
            gap > 0,
            F.concat(
                gap.cast("string"),
                F.lit(" item(s) recorded as migrated locally but not confirmed in the target"),
            ),
        )
        .when(
            gap < 0,
            F.concat(
                (-gap).cast("string"),
                F.lit(" item(s) in the target exceed the local records of run "),
                F.col("run_id"),
            ),
        )
    )
    return both.select(
        "run_id",
        "local_total",
        "target_total",
        missing.alias("missing"),
        unexpected.alias("unexpected"),
        note.alias("note"),
        (known & (gap == 0)).alias("is_clean"),
    )


def reconcile_items(
    local: DataFrame,
    target: DataFrame,
    local_parts: DataFrame | None = None,
    target_parts: DataFrame | None = None,
) -> DataFrame:
    """Discrepancies per item: missing, unexpected or mismatched, with what differs.

    Both sides: idempotency_key, target_archive, legal_hold. Part lists are compared
    position by position (idempotency_key, pos, sha256), so no list is ever gathered.
    """
    left = local.select(
        "idempotency_key",
        F.col("target_archive").alias("l_archive"),
        F.col("legal_hold").alias("l_hold"),
        F.lit(True).alias("in_local"),
    )
    right = target.select(
        "idempotency_key",
        F.col("target_archive").alias("t_archive"),
        F.col("legal_hold").alias("t_hold"),
        F.lit(True).alias("in_target"),
    )
    both = left.join(right, "idempotency_key", "full")
    if local_parts is not None and target_parts is not None:
        ours = local_parts.select("idempotency_key", "pos", F.col("sha256").alias("l_sha"))
        theirs = target_parts.select("idempotency_key", "pos", F.col("sha256").alias("t_sha"))
        differs = (
            ours.join(theirs, ["idempotency_key", "pos"], "full")
            .where(~F.col("l_sha").eqNullSafe(F.col("t_sha")))
            .groupBy("idempotency_key")
            .agg(F.count(F.lit(1)).alias("part_differences"))
        )
        both = both.join(differs, "idempotency_key", "left")
    else:
        both = both.withColumn("part_differences", F.lit(None).cast("bigint"))
    kind = (
        F.when(F.col("in_target").isNull(), "missing")
        .when(F.col("in_local").isNull(), "unexpected")
        .when(
            ~F.col("l_archive").eqNullSafe(F.col("t_archive"))
            | ~F.col("l_hold").eqNullSafe(F.col("t_hold"))
            | F.col("part_differences").isNotNull(),
            "mismatched",
        )
    )
    detail = F.concat_ws(
        ",",
        F.when(~F.col("l_archive").eqNullSafe(F.col("t_archive")), "target_archive"),
        F.when(~F.col("l_hold").eqNullSafe(F.col("t_hold")), "legal_hold"),
        F.when(F.col("part_differences").isNotNull(), "parts"),
    )
    return (
        both.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "idempotency_key",
            "kind",
            F.when(F.col("kind") == "mismatched", detail).otherwise(F.lit("")).alias("detail"),
        )
    )


def reconciliation_verdict(discrepancies: DataFrame) -> DataFrame:
    counted = discrepancies.agg(
        *[
            F.count_if(F.col("kind") == k).alias(k)
            for k in ("missing", "unexpected", "mismatched")
        ]
    )
    return counted.withColumn(
        "is_clean", (F.col("missing") + F.col("unexpected") + F.col("mismatched")) == 0
    )
