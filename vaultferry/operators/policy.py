"""Policy: which archives and items may move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.functions.letters import ignore_case
from vaultferry.functions.times import utc
from vaultferry.options import MIGRATE, RETAIN, MigrationFilters

SKIPPED = ("SkippedByFilter", "Orphaned", "LegalHoldRetain")


# The reason texts below are fixed values.


def scope_rules(filters: MigrationFilters) -> list[tuple[str, Column]]:
    """(reason, rule that leaves an item out) for each filter that is set, in order.

    A rule is null for a missing value; that leaves the item out too.
    """
    rules: list[tuple[str, Column]] = []
    if filters.archive_id is not None:
        rules.append(
            ("ArchiveId filter not matched.", F.col("archive_id") != F.lit(filters.archive_id))
        )
    if filters.from_utc is not None:
        rules.append(
            ("Item predates FromUtc filter.", F.col("sent_date_utc") < utc(filters.from_utc))
        )
    if filters.to_utc is not None:
        rules.append(
            ("Item is at or after ToUtc filter.", F.col("sent_date_utc") >= utc(filters.to_utc))
        )
    if filters.folder_path is not None:
        prefix = ignore_case(F.lit(filters.folder_path))
        inside = F.startswith(ignore_case(F.col("folder_path")), prefix)
        rules.append(("FolderPath filter not matched.", ~inside))
    if filters.retention_category is not None:
        wanted = ignore_case(F.lit(filters.retention_category))
        same = ignore_case(F.col("retention_category")) == wanted
        rules.append(("RetentionCategory filter not matched.", ~same))
    return rules


def in_scope(items: DataFrame, filters: MigrationFilters) -> DataFrame:
    """Items that pass every filter; the date and id rules reach the scan."""
    for _, left_out in scope_rules(filters):
        items = items.where(~left_out)
    return items


def decide(
    filters: MigrationFilters,
    legal_hold: str = RETAIN,
    extra_rules: Sequence[tuple[str, Column]] = (),
) -> Column:
    """Struct (outcome, reason) of an item joined with its archive; the first rule decides.

    ``extra_rules`` are further (reason, rule) pairs that skip an item.
    """
    hold = F.col("legal_hold")
    ownerless = (F.col("type") == "Mailbox") & F.col("owner_upn").isNull()
    cascade = [
        *[("SkippedByFilter", why, F.coalesce(r, F.lit(True))) for why, r in scope_rules(filters)],
        *[("SkippedByFilter", why, rule) for why, rule in extra_rules],
        (
            "LegalHoldRetain",
            "Archive is under legal hold; policy is Retain.",
            hold & F.lit(legal_hold == RETAIN),
        ),
        ("Orphaned", "Mailbox archive has no owner UPN.", ownerless),
        (
            "LegalHoldMigrate",
            "Archive is under legal hold; policy is Migrate.",
            hold & F.lit(legal_hold == MIGRATE),
        ),
        ("Proceed", "No exclusion rules matched.", F.lit(True)),
    ]

    def answer(outcome: str, reason: str) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"))

    first, *others = cascade
    decision = F.when(first[2], answer(first[0], first[1]))
    for outcome, reason, rule in others:
        decision = decision.when(rule, answer(outcome, reason))
    return decision


def with_decision(
    archive_items: DataFrame,
    filters: MigrationFilters,
    legal_hold: str = RETAIN,
    extra_rules: Sequence[tuple[str, Column]] = (),
) -> DataFrame:
    decided = archive_items.withColumn("_d", decide(filters, legal_hold, extra_rules))
    return decided.select(
        *archive_items.columns,
        F.col("_d.outcome").alias("outcome"),
        F.col("_d.reason").alias("reason"),
    )


def route_items(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items that go on, skipped items)."""
    skipped = F.col("outcome").isin(*SKIPPED)
    return decided.where(~skipped), decided.where(skipped)


def retain_legal_hold(archives: DataFrame, legal_hold: str = RETAIN) -> DataFrame:
    """Archives held back as a whole."""
    if legal_hold != RETAIN:
        return archives.where(F.lit(False))
    return archives.where("legal_hold")
