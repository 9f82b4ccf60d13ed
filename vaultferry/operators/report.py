"""Run reports built from the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.functions.payload import payload_long, payload_text
from vaultferry.operators.lookups import with_position, with_previous
from vaultferry.schemas import ERROR_EVENTS, RUN_EVENTS

COUNTERS = {
    "total_archives": "totalArchives",
    "total_items": "totalItems",
    "migrated": "migrated",
    "already_present": "alreadyPresent",
    "orphaned": "orphaned",
    "skipped": "skipped",
    "failed": "failed",
}


def _is(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def outcome_counts() -> list[Column]:
    """Counters that follow from the events alone."""
    return [
        F.count_if(_is("ItemMigrated", "ItemDryRun")).alias("migrated"),
        F.count_if(_is("ItemAlreadyPresent")).alias("already_present"),
        F.count_if(_is("ArchiveOrphaned")).alias("orphaned"),
        F.count_if(_is("ItemSkipped")).alias("skipped"),
        F.count_if(_is(*ERROR_EVENTS)).alias("failed"),
        F.count_if(_is("ArchiveLegalHoldRetained")).alias("held_archives"),
    ]


def run_counters(events: DataFrame) -> DataFrame:
    """Counters per run, recomputed from its events.

    Every scanned item ends in exactly one event, so the item total is their sum.
    """
    counted = events.groupBy("run_id").agg(*outcome_counts())
    total = F.col("migrated") + F.col("already_present") + F.col("skipped") + F.col("failed")
    return counted.withColumn("total_items", total)


def run_summary(events: DataFrame, latest: bool = False) -> DataFrame:
    """One row per run: start, finish and the counters its RunCompleted event carries.

    A run that was repeated reports its first completion, or with ``latest`` its last; of
    completions at one time, the last is the one that saw and delivered more items.
    """
    pick_by, pick_time = (F.max_by, F.max) if latest else (F.min_by, F.min)
    seen = [payload_long(F.col("payload"), c) for c in ("totalItems", "migrated")] if latest else []
    done = F.when(_is("RunCompleted"), F.col("timestamp_utc"))
    picked = (
        events.where(_is("RunStarted", "RunCompleted"))
        .groupBy("run_id")
        .agg(
            F.min(F.when(_is("RunStarted"), F.col("timestamp_utc"))).alias("started_at_utc"),
            pick_time(done).alias("finished_at_utc"),
            pick_by(
                "payload", F.when(_is("RunCompleted"), F.struct("timestamp_utc", *seen, "id"))
            ).alias("_payload"),
        )
    )
    return picked.select(
        "run_id",
        "started_at_utc",
        "finished_at_utc",
        *[payload_long(F.col("_payload"), p).alias(c) for c, p in COUNTERS.items()],
    )


def archive_summary(events: DataFrame) -> DataFrame:
    """Item counters per run and archive."""
    item_event = events.where(F.col("item_id").isNotNull())
    return item_event.groupBy(
        "run_id", payload_text(F.col("payload"), "archiveId").alias("archive_id")
    ).agg(
        F.count_if(_is("ItemMigrated", "ItemDryRun")).alias("migrated"),
        F.count_if(_is("ItemAlreadyPresent")).alias("already_present"),
        F.count_if(_is("ItemSkipped")).alias("skipped"),
        F.count_if(_is(*ERROR_EVENTS)).alias("failed"),
    )


def _status() -> Column:
    status = F.lit(None).cast("string")
    for event, name in RUN_EVENTS.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    return status


def run_events(events: DataFrame) -> DataFrame:
    """Events that start or end a run, with the status they set."""
    return events.where(_is(*RUN_EVENTS)).withColumn("status", _status())


def _moment() -> Column:
    """Order of run events; an end sorts after a start at the same time."""
    return F.struct("timestamp_utc", F.col("status") != "Running", "id")


def run_list(events: DataFrame) -> DataFrame:
    """run_id, status and first start of every run; the newest run event sets the status."""
    return (
        run_events(events)
        .groupBy("run_id")
        .agg(
            F.max_by("status", _moment()).alias("status"),
            F.min(F.when(_is("RunStarted"), F.col("timestamp_utc"))).alias("started_at_utc"),
        )
    )


def run_detail(events: DataFrame) -> DataFrame:
    """Run list with the summary of the runs that are completed."""
    done = F.when(_is("RunCompleted"), F.struct("timestamp_utc", "id"))
    picked = (
        run_events(events)
        .groupBy("run_id")
        .agg(
            F.max_by("status", _moment()).alias("status"),
            F.min(F.when(_is("RunStarted"), F.col("timestamp_utc"))).alias("started_at_utc"),
            F.min(F.when(_is("RunCompleted"), F.col("timestamp_utc"))).alias("finished_at_utc"),
            F.min_by("payload", done).alias("_payload"),
        )
    )
    completed = F.col("status") == "Completed"
    counters = [payload_long(F.col("_payload"), p).alias(c) for c, p in COUNTERS.items()]
    counted = picked.select("run_id", "status", "started_at_utc", "finished_at_utc", *counters)
    return counted.select(
        "run_id",
        "status",
        "started_at_utc",
        *[F.when(completed, F.col(c)).alias(c) for c in ("finished_at_utc", *COUNTERS)],
    )


def run_kpis(runs: DataFrame) -> DataFrame:
    """Number of runs, completed, running, and the completed share in whole percent."""
    counted = runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "Completed").alias("completed"),
        F.count_if(F.col("status") == "Running").alias("running"),
    )
    rate = F.floor(F.lit(100.0) * F.col("completed") / F.col("total") + F.lit(0.5))
    return counted.withColumn(
        "success_rate",
        F.when(F.col("total") > 0, rate).otherwise(F.lit(0)).cast("bigint"),
    )


def resumable_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin("Cancelled", "Failed"))


def filter_runs(runs: DataFrame, text: str) -> DataFrame:
    """Runs whose id, start time or status contains the text, ignoring case."""
    wanted = F.lower(F.lit(text))
    started = F.date_format("started_at_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    found = F.lit(False)
    for c in (F.col("run_id"), started, F.col("status")):
        found = found | F.coalesce(F.contains(F.lower(c), wanted), F.lit(False))
    return runs.where(found)


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The n runs started last."""
    return runs.orderBy(F.desc("started_at_utc"), "run_id").limit(n)


def last_completed_run(runs: DataFrame) -> DataFrame:
    return recent_runs(runs.where(F.col("status") == "Completed"), 1)


def status_changes(events: DataFrame) -> DataFrame:
    """Run events that moved a run from Running to Completed or Failed."""
    ended = run_events(events).withColumn("ended", F.col("status") != "Running")
    changed = with_previous(
        ended, ["run_id"], ["timestamp_utc", "ended", "id"], "status", "previous_status"
    )
    return changed.where(
        (F.col("previous_status") == "Running") & F.col("status").isin("Completed", "Failed")
    ).select("run_id", "timestamp_utc", "previous_status", "status")


def archive_catalog(archives: DataFrame) -> DataFrame:
    return archives.groupBy("type").agg(
        F.count(F.lit(1)).alias("archives"),
        F.count_if("legal_hold").alias("held"),
        F.count("owner_upn").alias("owned"),
    )


def progress_marks(events: DataFrame, every: int = 100) -> DataFrame:
    """Every n-th processed item of a run with the running count.

    Items found delivered before, and skipped ones, do not count as processed.
    """
    processed = events.where(_is("ItemMigrated", "ItemDryRun", *ERROR_EVENTS)).select(
        "run_id", "timestamp_utc", "id", "item_id"
    )
    numbered = with_position(processed, ["run_id"], ["timestamp_utc", "id"], "_pos")
    count = F.col("_pos") + 1
    return (
        numbered.withColumn("processed_count", count)
        .where(F.col("processed_count") % F.lit(every) == 0)
        .select("run_id", "timestamp_utc", "item_id", "processed_count")
    )
