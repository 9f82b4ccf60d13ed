"""Audit log: building events, searching and counting them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultferry.functions.keys import event_id
from vaultferry.functions.payload import payload_text
from vaultferry.schemas import ERROR_EVENTS

AUDIT_COLUMNS = ("id", "timestamp_utc", "event_type", "item_id", "payload", "run_id")


def audit_events(
    df: DataFrame,
    run_id: Column,
    at: Column,
    event_type: Column,
    item_id: Column,
    payload: Column,
    subject: Column,
) -> DataFrame:
    """Turn each row into an audit event whose id follows from run, type and subject."""
    return df.select(
        event_id(run_id, event_type, subject).alias("id"),
        at.alias("timestamp_utc"),
        event_type.alias("event_type"),
        item_id.alias("item_id"),
        payload.alias("payload"),
        run_id.alias("run_id"),
    )


def collect_audit(branches: Sequence[DataFrame]) -> DataFrame:
    """All branches as one log."""
    return reduce(lambda a, b: a.unionByName(b), branches)


def filter_events(
    events: DataFrame, run_id: str, event_types: Sequence[str] | None = None
) -> DataFrame:
    chosen = events.where(F.col("run_id") == run_id)
    if event_types is not None:
        chosen = chosen.where(F.col("event_type").isin(*event_types))
    return chosen


def order_audit(events: DataFrame) -> DataFrame:
    return events.orderBy("timestamp_utc", "id")


def matches(text: str, event_type: str | None = None) -> Column:
    """Search rule: wanted type, and the text inside item id or type, ignoring case."""
    rule = F.lit(True) if event_type is None else F.col("event_type") == event_type
    if text:
        wanted = F.lower(F.lit(text))
        found = F.coalesce(F.contains(F.lower("item_id"), wanted), F.lit(False))
        rule = rule & (found | F.contains(F.lower("event_type"), wanted))
    return rule


def search_events(events: DataFrame, text: str = "", event_type: str | None = None) -> DataFrame:
    return events.where(matches(text, event_type))


def filtered_ratio(
    events: DataFrame, text: str = "", event_type: str | None = None
) -> DataFrame:
    return events.agg(
        F.count_if(matches(text, event_type)).alias("filtered"),
        F.count(F.lit(1)).alias("total"),
    )


def error_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*ERROR_EVENTS))


def error_breakdown(events: DataFrame) -> DataFrame:
    """Failures per run, type and error code (or exception name)."""
    code = F.coalesce(
        payload_text(F.col("payload"), "errorCode"), payload_text(F.col("payload"), "error")
    )
    return (
        error_events(events)
        .groupBy("run_id", "event_type", code.alias("error_code"))
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def event_types(events: DataFrame) -> DataFrame:
    return events.select("event_type").distinct().orderBy("event_type")


def ingest_histogram(events: DataFrame, by: str = "minute") -> DataFrame:
    """Migrated items per run and minute, or per minute of the day over all days."""
    if by not in ("minute", "minute_of_day"):
        raise ValueError(f"by must be minute or minute_of_day, got {by!r}")
    ts = F.col("timestamp_utc")
    bucket = F.date_trunc("minute", ts) if by == "minute" else F.date_format(ts, "HH:mm")
    return (
        events.where(F.col("event_type") == "ItemMigrated")
        .groupBy("run_id", bucket.alias(by))
        .agg(F.count(F.lit(1)).alias("ingested"))
    )


def cumulative_ingested(histogram: DataFrame) -> DataFrame:
    """Running total over the minutes of a run; the window sees one row per minute."""
    so_far = (
        Window.partitionBy("run_id")
        .orderBy("minute")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return histogram.withColumn("cumulative", F.sum("ingested").over(so_far))
