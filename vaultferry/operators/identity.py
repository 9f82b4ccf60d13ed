"""Owner to target-archive mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultferry.functions.letters import ignore_case
from vaultferry.functions.messages import type_target
from vaultferry.operators.lookups import lookup_join
from vaultferry.options import RETAIN, RunOptions


def unique_map(identity_map: DataFrame, order: str | None = None) -> DataFrame:
    """One target per owner, ignoring case; with ``order``, the last entry wins."""
    rank = F.col(order) if order else F.col("target_archive")
    return identity_map.groupBy(ignore_case(F.col("upn")).alias("owner_key")).agg(
        F.max_by("target_archive", rank).alias("mapped_target")
    )


def resolve_targets(
    archives: DataFrame, identity_map: DataFrame, order: str | None = None
) -> DataFrame:
    """Add target_archive and orphan_reason.

    Only mailboxes look their owner up. A mailbox without owner or mapping has no target;
    the reason is NullOwnerUpn or Unmapped.
    """
    mailbox = F.col("type") == "Mailbox"
    keyed = archives.withColumn("owner_key", F.when(mailbox, ignore_case(F.col("owner_upn"))))
    joined = lookup_join(
        keyed, unique_map(identity_map, order), ["owner_key"], "left", [F.col("archive_id")]
    )
    target = F.when(mailbox, F.col("mapped_target")).otherwise(
        type_target(F.col("type"), F.col("archive_id"))
    )
    reason = F.when(mailbox & F.col("owner_upn").isNull(), "NullOwnerUpn").when(
        mailbox & F.col("mapped_target").isNull(), "Unmapped"
    )
    return joined.select(
        *archives.columns, target.alias("target_archive"), reason.alias("orphan_reason")
    )


def route_archives(
    archives: DataFrame,
    identity_map: DataFrame,
    options: RunOptions,
    order: str | None = None,
) -> DataFrame:
    """Add route (filtered, held, orphan, routed), target_archive and orphan_reason.

    The archive filter comes first, then legal hold, then the owner lookup.
    """
    wanted = F.lit(True)
    if options.filters.archive_id is not None:
        wanted = F.col("archive_id") == F.lit(options.filters.archive_id)
    held = F.col("legal_hold") & F.lit(options.legal_hold == RETAIN)
    resolved = resolve_targets(archives, identity_map, order)
    route = (
        F.when(~wanted, "filtered")
        .when(held, "held")
        .when(F.col("orphan_reason").isNotNull(), "orphan")
        .otherwise("routed")
    )
    return resolved.withColumn("route", route)


def identity_map_stats(archives: DataFrame, identity_map: DataFrame) -> DataFrame:
    """Owners found in the map and owners that are not, counted once each."""
    owners = archives.where((F.col("type") == "Mailbox") & F.col("owner_upn").isNotNull())
    distinct = owners.groupBy(ignore_case(F.col("owner_upn")).alias("owner_key")).agg(
        F.min("owner_upn").alias("owner_upn")
    )
    joined = distinct.join(unique_map(identity_map), "owner_key", "left")
    return joined.agg(
        F.count_if(F.col("mapped_target").isNotNull()).alias("mapped_upns"),
        F.count_if(F.col("mapped_target").isNull()).alias("orphaned_upns"),
    )


def orphaned_owners(archives: DataFrame, identity_map: DataFrame) -> DataFrame:
    """Distinct owners (in lower case) that have no target."""
    owners = archives.where((F.col("type") == "Mailbox") & F.col("owner_upn").isNotNull())
    distinct = owners.groupBy(ignore_case(F.col("owner_upn")).alias("owner_key")).agg(
        F.min(F.lower("owner_upn")).alias("owner")
    )
    unmapped = distinct.join(unique_map(identity_map), "owner_key", "left_anti")
    return unmapped.select(F.col("owner").alias("owner_key"))
