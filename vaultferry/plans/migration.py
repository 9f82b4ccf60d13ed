"""A migration run: from archives and items to messages, records, audit log and summary."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultferry import schemas
from vaultferry.functions.keys import idempotency_key
from vaultferry.functions.payload import audit_payload, payload_long
from vaultferry.functions.times import utc
from vaultferry.operators import audit as a
from vaultferry.operators import ingest as ing
from vaultferry.operators.delivery import attempt_rollup, retry_queue
from vaultferry.operators.identity import route_archives
from vaultferry.operators.key_index import INDEX, key_index, prune
from vaultferry.operators.lookups import lookup_join, rows_with_keys
from vaultferry.operators.policy import SKIPPED, with_decision
from vaultferry.operators.rehydrate import (
    BLOB_NOT_FOUND,
    PART_NOT_FOUND,
    assemble_parts,
    check_refs,
    distinct_part_ids,
    item_content,
    part_refs,
    verify_parts,
    with_content,
    with_error_detail,
)
from vaultferry.operators.report import COUNTERS, outcome_counts, run_summary
from vaultferry.operators.transform import build_messages, transform_error
from vaultferry.options import RunOptions
from vaultferry.session import prepare_session, without_key_filters
from vaultferry.sinks import writers
from vaultferry.sources.readers import read_if_present

DELIVER = "Deliver"
RESULT_EVENTS = {
    "Ingested": "ItemMigrated",
    "AlreadyPresent": "ItemMigrated",
    "TransientError": "ItemTransientFailed",
    "PermanentError": "ItemPermanentFailed",
    "UnexpectedError": "ItemUnexpectedError",
}


@dataclass(frozen=True)
class MigrationInputs:
    """Source tables.

    ``refs`` (item_id, pos, part_id) may stand in for the items' part lists; positions grow.
    """

    archives: DataFrame
    items: DataFrame
    identity_map: DataFrame
    parts: DataFrame
    blob_hashes: DataFrame
    refs: DataFrame | None = None
    records: DataFrame | None = None
    identity_order: str | None = None


def scan_items(items: DataFrame, archives: DataFrame) -> DataFrame:
    """Items of the routed archives with their archive's columns.

    The archives are wide, so they are not repeated: adaptive execution splits a hot one.
    """
    routed = archives.where(F.col("route") == "routed").select(
        "archive_id", "type", "owner_upn", "legal_hold", "vault_store", "target_archive"
    )
    return lookup_join(items, routed, ["archive_id"], "inner", [F.col("item_id")], salts=1)


def wanted_refs(inputs: MigrationInputs, wanted: DataFrame) -> DataFrame:
    """Part references of the wanted items only.

    A plain semi-join: the scan of the references can drop the others by a filter of the keys.
    """
    if inputs.refs is None:
        return part_refs(wanted)
    return rows_with_keys(inputs.refs, wanted, ["item_id"])


def checked_refs(inputs: MigrationInputs, wanted: DataFrame, options: RunOptions) -> DataFrame:
    """Part references of the wanted items, each with its verified part."""
    refs = wanted_refs(inputs, wanted)
    own = options.extensions.check_parts
    if own is not None:
        return own(refs, inputs.parts, inputs.blob_hashes)
    return check_refs(refs, verify_parts(inputs.parts, inputs.blob_hashes))


def select_items(
    inputs: MigrationInputs, options: RunOptions, archives: DataFrame
) -> DataFrame:
    """Scanned items with policy decision and key."""
    scanned = scan_items(inputs.items, archives)
    decided = with_decision(
        scanned, options.filters, options.legal_hold, options.extensions.extra_rules
    )
    key = idempotency_key(F.col("vault_store"), F.col("archive_id"), F.col("item_id"))
    return decided.withColumn("idempotency_key", key)


def flag_history(inputs: MigrationInputs, selected: DataFrame) -> DataFrame:
    if inputs.records is None:
        return selected.withColumn("already_delivered", F.lit(False))
    return ing.flag_delivered(selected, inputs.records)


def goes_on() -> Column:
    return (
        ~F.col("outcome").isin(*SKIPPED)
        & F.col("idempotency_key").isNotNull()
        & ~F.col("already_delivered")
    )


def classify_items(
    selected: DataFrame, checked: DataFrame, options: RunOptions
) -> DataFrame:
    """Add part counts, the first error and the event each item ends in before delivery.

    An item ready for delivery gets ItemDryRun or the marker ``Deliver``.
    """
    exception = F.when(
        F.col("idempotency_key").isNull(), F.lit("ArgumentException")
    ).otherwise(transform_error())
    joined = with_content(selected, item_content(checked)).withColumn("exception", exception)
    event = (
        F.when(F.col("outcome").isin(*SKIPPED), "ItemSkipped")
        .when(F.col("idempotency_key").isNull(), "ItemUnexpectedError")
        .when(F.col("already_delivered"), "ItemAlreadyPresent")
        .when(F.col("error_code").isNotNull(), "ItemPermanentFailed")
        .when(F.col("exception").isNotNull(), "ItemUnexpectedError")
        .otherwise(F.lit("ItemDryRun" if options.dry_run else DELIVER))
    )
    return joined.withColumn("event_type", event).drop("content_part_ids")


def rejects(classified: DataFrame) -> DataFrame:
    """Items whose key cannot be formed."""
    return classified.where(F.col("idempotency_key").isNull())


def part_error_message() -> Column:
    """Text of a content error; without detail columns it names the position only."""
    part = F.coalesce(
        F.concat(F.lit("part '"), F.col("error_part"), F.lit("'")),
        F.concat(F.lit("the part at position "), F.col("error_pos").cast("string")),
    )
    code = F.col("error_code")
    hashes = F.concat(
        F.lit(": stored "),
        F.col("error_stored_sha256"),
        F.lit(", computed "),
        F.col("error_sha256"),
    )
    return (
        F.when(code == BLOB_NOT_FOUND, F.concat(F.lit("No bytes for "), part))
        .when(code == PART_NOT_FOUND, F.concat(F.lit("No metadata for "), part))
        .otherwise(
            F.concat(F.lit("Wrong hash of "), part, F.coalesce(hashes, F.lit("")))
        )
    )


def unexpected_message() -> Column:
    """Text of an unexpected error."""
    return (
        F.when(
            F.col("exception") == "ArgumentException",
            F.lit("A part of the item's key is missing or blank."),
        )
        .when(
            F.col("exception") == "ArgumentOutOfRangeException",
            F.lit("The archive type is unknown or the retention expires after year 9999."),
        )
        .otherwise(F.concat(F.lit("Delivery failed: "), F.col("delivery_error")))
    )


def without_detail(items: DataFrame) -> DataFrame:
    names = ("error_part", "error_stored_sha256", "error_sha256")
    return items.withColumns({c: F.lit(None).cast("string") for c in names})


def item_payload() -> Column:
    """JSON payload of an item's final event."""
    archive = F.col("archive_id")
    event = F.col("event_type")
    delivery_error = F.col("delivery_error")
    return (
        F.when(
            event == "ItemSkipped", audit_payload(archiveId=archive, reason=F.col("outcome"))
        )
        .when(
            event == "ItemAlreadyPresent",
            audit_payload(archiveId=archive, key=F.col("idempotency_key")),
        )
        .when(event == "ItemDryRun", audit_payload(archiveId=archive))
        .when(
            event == "ItemMigrated",
            audit_payload(
                archiveId=archive, targetId=F.col("target_id"), status=F.col("ingest_status")
            ),
        )
        .when(
            (event == "ItemPermanentFailed") & F.col("error_code").isNotNull(),
            audit_payload(
                archiveId=archive, errorCode=F.col("error_code"), message=part_error_message()
            ),
        )
        .when(
            event == "ItemUnexpectedError",
            audit_payload(
                archiveId=archive,
                error=F.coalesce("exception", "delivery_error"),
                message=unexpected_message(),
            ),
        )
        .otherwise(audit_payload(archiveId=archive, errorCode=delivery_error))
    )


def with_results(classified: DataFrame, results: DataFrame | None) -> DataFrame:
    """Replace the marker ``Deliver`` by the event the receipt leads to.

    Items still without a receipt keep the marker.
    """
    if results is None:
        return classified.withColumns(
            {
                "ingest_status": F.lit(None).cast("string"),
                "target_id": F.lit(None).cast("string"),
                "delivery_error": F.lit(None).cast("string"),
            }
        )
    applied = ing.apply_receipts(classified, results)
    event = F.col("event_type")
    final = event
    for status, name in RESULT_EVENTS.items():
        final = F.when(
            (event == DELIVER) & (F.col("ingest_status") == status), F.lit(name)
        ).otherwise(final)
    return applied.withColumn("event_type", final)


def archive_audit(
    archives: DataFrame, options: RunOptions, at: Column | None = None, scope: str = ""
) -> DataFrame:
    run, at = F.lit(options.run_id), utc(options.as_of) if at is None else at
    archive = F.col("archive_id")
    subject = F.concat(archive, F.lit(scope))
    held = a.audit_events(
        archives.where(F.col("route") == "held"),
        run,
        at,
        F.lit("ArchiveLegalHoldRetained"),
        F.lit(None).cast("string"),
        audit_payload(archiveId=archive),
        subject,
    )
    ownerless = F.col("orphan_reason") == "NullOwnerUpn"
    orphan = a.audit_events(
        archives.where(F.col("route") == "orphan"),
        run,
        at,
        F.lit("ArchiveOrphaned"),
        F.lit(None).cast("string"),
        F.when(
            ownerless, audit_payload(archiveId=archive, reason=F.col("orphan_reason"))
        ).otherwise(audit_payload(archiveId=archive, ownerUpn=F.col("owner_upn"))),
        subject,
    )
    return a.collect_audit([held, orphan])


def item_audit(
    results: DataFrame, options: RunOptions, at: Column | None = None, scope: str = ""
) -> DataFrame:
    """Final events of items; ``scope`` keeps the ids of different batches apart."""
    return a.audit_events(
        results.where(F.col("event_type") != DELIVER),
        F.lit(options.run_id),
        utc(options.as_of) if at is None else at,
        F.col("event_type"),
        F.col("item_id"),
        item_payload(),
        F.concat("item_id", F.lit(scope)),
    )


def _run_event(
    one_row: DataFrame,
    options: RunOptions,
    event: str,
    payload: Column,
    scope: str = "",
    at: datetime | None = None,
) -> DataFrame:
    return a.audit_events(
        one_row,
        F.lit(options.run_id),
        utc(at or options.as_of),
        F.lit(event),
        F.lit(None).cast("string"),
        payload,
        F.lit(scope),
    )


def run_started(
    spark: SparkSession, options: RunOptions, scope: str = "", at: datetime | None = None
) -> DataFrame:
    payload = audit_payload(runId=F.lit(options.run_id), dryRun=F.lit(options.dry_run))
    return _run_event(spark.range(1), options, "RunStarted", payload, scope, at)


def run_completed(
    archives: DataFrame,
    events: DataFrame,
    options: RunOptions,
    scope: str = "",
    at: datetime | None = None,
    pending: Column | None = None,
) -> DataFrame:
    """RunCompleted event with the counters of the run's archive and item events.

    ``pending`` is the number of scanned items that still await a receipt.
    """
    counted = events.agg(*outcome_counts())
    total = F.col("migrated") + F.col("already_present") + F.col("skipped") + F.col("failed")
    counted = counted.withColumns(
        {
            "total_items": total + (F.lit(0) if pending is None else pending),
            "total_archives": archives.agg(F.count(F.lit(1))).scalar(),
        }
    )
    payload = audit_payload(**{p: F.col(c) for c, p in COUNTERS.items()})
    return _run_event(counted, options, "RunCompleted", payload, scope, at)


def record_entries(
    results: DataFrame, options: RunOptions, at: Column | None = None
) -> DataFrame:
    """Record-log rows of delivered and failed items."""
    at = utc(options.as_of) if at is None else at
    success = F.col("event_type") == "ItemMigrated"
    failed = F.col("event_type").isin(*schemas.ERROR_EVENTS)
    code = F.coalesce("error_code", "exception", "delivery_error")
    # Attempts add up when the log is folded: an entry holds those that came with it.
    counted = next((c for c in ("tries", "attempts") if c in results.columns), None)
    tries = F.lit(1) if counted is None else F.col(counted).cast("int")
    return (
        results.where((success | failed) & F.col("idempotency_key").isNotNull())
        .select(
            "idempotency_key",
            F.col("item_id").alias("source_item_id"),
            "archive_id",
            "target_archive",
            F.when(success, F.col("target_id")).alias("target_id"),
            F.when(success, "Migrated").otherwise("Failed").alias("status"),
            at.alias("extracted_at_utc"),
            F.when(success, at).alias("ingested_at_utc"),
            at.alias("last_attempt_at_utc"),
            F.coalesce(tries, F.lit(1)).alias("attempt_count"),
            F.when(~success, code).alias("last_error_code"),
        )
        .select(*schemas.RECORDS.names)
    )


def messages_of(classified: DataFrame, checked: DataFrame, options: RunOptions) -> DataFrame:
    """Messages of the items ready for delivery (or, in a dry run, passed)."""
    ready = classified.where(F.col("event_type").isin(DELIVER, "ItemDryRun"))
    lists = assemble_parts(checked)
    build = options.extensions.build_messages or build_messages
    return build(ready, lists, options)


def pending_items(items: DataFrame) -> Column:
    """Number of items that are ready and have no receipt yet."""
    return items.agg(F.count_if(F.col("event_type") == DELIVER)).scalar()


@dataclass(frozen=True)
class MigrationPlan:
    """Lazy frames of one run without delivery."""

    options: RunOptions
    archives: DataFrame
    items: DataFrame
    checked: DataFrame
    audit: DataFrame

    def messages(self) -> DataFrame:
        """Nested messages, one per item."""
        return messages_of(self.items, self.checked, self.options)


def plan_migration(
    spark: SparkSession,
    inputs: MigrationInputs,
    options: RunOptions,
    results: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> MigrationPlan:
    """Build a run as lazy DataFrames; ``results`` are classified final receipts, if any.

    The log needs the items twice, messages and log the checked references; with
    ``keep=durable`` each is computed once. Messages alone are cheaper without it: items stay
    partitioned by their id, and nothing is written in between. Content errors in the audit log name the position; ``run_migration`` adds
    part and hashes.
    """
    prepare_session(spark)
    archives = route_archives(
        inputs.archives, inputs.identity_map, options, inputs.identity_order
    )
    selected = flag_history(inputs, select_items(inputs, options, archives))
    checked = keep(checked_refs(inputs, selected.where(goes_on()), options))
    classified = classify_items(selected, checked, options)
    items = keep(without_detail(with_results(classified, results)))
    outcome = a.collect_audit([archive_audit(archives, options), item_audit(items, options)])
    log = a.collect_audit(
        [
            run_started(spark, options),
            outcome,
            run_completed(archives, outcome, options, pending=pending_items(items)),
        ]
    )
    return MigrationPlan(options, archives, items, checked, log)


Deliver = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Execution:
    """One call of a run: the run's options, the store's folder and an id of its own.

    Every batch writes under an id no other attempt uses and is read by others only once
    its row is in the table of commits. So a run may be repeated, narrowed or resumed under
    its id, and a batch that died half-way leaves nothing that is ever read.
    """

    spark: SparkSession
    options: RunOptions
    root: str
    number: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def batch_id(self, kind: str) -> str:
        return f"{self.options.run_id}.{self.number}.{kind}.{uuid.uuid4().hex[:12]}"

    def read(
        self, table: str, schema: T.StructType, own: bool = False, run: bool = False
    ) -> DataFrame | None:
        """Rows of the committed batches with their batch_id; None if the table is not there.

        ``run`` keeps the batches of this run, ``own`` those of this execution.
        """

        def wanted(commit: Row) -> bool:
            if (run or own) and commit["run_id"] != self.options.run_id:
                return False
            return not own or commit["execution"] == self.number

        return read_committed(self.spark, self.root, table, schema, wanted)

    def done(self, name: str) -> bool:
        """Whether a batch of this name is committed in this run, by any execution."""
        run = self.options.run_id
        rows = commits_of(self.spark, self.root)
        return any(r["run_id"] == run and r["name"] == name for r in rows or [])

    def commit(self, batch_id: str, kind: str, name: str, at: datetime | None) -> None:
        row = self.spark.range(1).select(
            F.lit(batch_id).alias("batch_id"),
            F.lit(self.options.run_id).alias("run_id"),
            F.lit(self.number).alias("execution"),
            F.lit(kind).alias("kind"),
            F.lit(name).alias("name"),
            utc(at or self.options.as_of).alias("at_utc"),
            F.current_timestamp().alias("written_utc"),
        )
        row.coalesce(1).write.mode("append").parquet(self.path("commits"))


# Files of the tables of commits read so far, and their rows; a file never changes.
_COMMITS: dict[str, tuple[frozenset[str], list[Row]]] = {}
# Batches that are named in a filter; more are joined.
NAMED_BATCHES = 5000


def commits_of(spark: SparkSession, root: str) -> list[Row] | None:
    """Rows of the table of commits, one per batch; None if the table is not there.

    Only files that came since the last call are read.
    """
    commits = read_if_present(spark, schemas.COMMITS, f"{root}/commits")
    if commits is None:
        return None
    files = frozenset(commits.inputFiles())
    known, rows = _COMMITS.get(root, (frozenset(), []))
    fresh = sorted(files - known)
    if not known or not known <= files or any("%" in f for f in fresh):
        rows = commits.collect()
    elif fresh:
        rows = rows + spark.read.schema(schemas.COMMITS).parquet(*fresh).collect()
    _COMMITS[root] = files, rows
    return rows


def read_committed(
    spark: SparkSession,
    root: str,
    table: str,
    schema: T.StructType,
    wanted: Callable[[Row], bool] | None = None,
) -> DataFrame | None:
    """Rows of a store's table whose batch is committed (and ``wanted``); None without any.

    With ``wanted`` the batches are named in the filter of the folders, so no other folder is
    read and nothing is joined, unless they are very many.
    """
    rows = read_if_present(spark, schemas.with_batch(schema), f"{root}/{table}")
    if wanted is None:
        joined = read_if_present(spark, schemas.COMMITS, f"{root}/commits")
        if rows is None or joined is None:
            return None
        return rows.join(joined.select("batch_id").distinct(), "batch_id", "left_semi")
    commits = commits_of(spark, root)
    if rows is None or commits is None:
        return None
    named = sorted({r["batch_id"] for r in commits if wanted(r)})
    if len(named) > NAMED_BATCHES:
        batches = spark.createDataFrame([(b,) for b in named], "batch_id string")
        return rows.join(batches, "batch_id", "left_semi")
    return rows.where(F.col("batch_id").isin(named) if named else F.lit(False))


def records_of(spark: SparkSession, root: str) -> DataFrame | None:
    """The record log: the compacted table, if there is one, and what was written since.

    ``compact_store`` names the batches it holds; their rows in the log are not read again.
    """
    log = read_committed(spark, root, "records", schemas.RECORDS)
    if log is None:
        return None
    folded, batches = compacted_part(spark, root)
    if folded is None:
        return log.drop("batch_id")
    return folded.unionByName(log.join(batches, "batch_id", "left_anti").drop("batch_id"))


def write_key_index(execution: Execution, batch_id: str) -> None:
    """Index the keys of the records a batch wrote, beside them."""
    mine = writers.read_batch(
        execution.spark, schemas.RECORDS, execution.path("records"), batch_id
    )
    writers.write_batch(key_index(mine), execution.path("key_index"), batch_id)


def records_with(execution: Execution, keys: DataFrame) -> DataFrame | None:
    """Rows of the record log that have one of some keys.

    The key index tells which batches may hold one; the files of the others are not opened.
    """
    spark, root = execution.spark, execution.root
    log = execution.read("records", schemas.RECORDS)
    if log is None:
        return None
    index = execution.read("key_index", INDEX)
    if index is not None:
        sizes = index.select("batch_id", "bits").distinct().collect()
        log = prune(log, index, keys, sorted({r["batch_id"] for r in sizes}), {r["bits"] for r in sizes})
    folded, batches = compacted_part(spark, root)
    if folded is not None:
        log = log.join(batches, "batch_id", "left_anti")
    log = rows_with_keys(log.drop("batch_id"), keys, ["idempotency_key"])
    if folded is None:
        return log
    return log.unionByName(rows_with_keys(folded, keys, ["idempotency_key"]))


def compacted_part(spark: SparkSession, root: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The newest compacted records and the batches they hold, if there are any."""
    held = read_if_present(spark, schemas.COMPACTED, f"{root}/compacted")
    if held is None:
        return None, None
    newest = held.agg(F.max(F.struct("number", "folder")).alias("n")).first()["n"]
    batches = held.where(F.col("number") == newest["number"]).select("batch_id")
    return spark.read.schema(schemas.RECORDS).parquet(f"{root}/{newest['folder']}"), batches


def compact_store(spark: SparkSession, root: str) -> None:
    """Fold the committed record log into a new folder that later runs read instead."""
    log = read_committed(spark, root, "records", schemas.RECORDS)
    if log is None:
        return
    held = read_if_present(spark, schemas.COMPACTED, f"{root}/compacted")
    number = 0 if held is None else held.agg(F.max("number")).first()[0] + 1
    folder = f"records-{number}-{uuid.uuid4().hex[:12]}"
    batches = log.select("batch_id").distinct().cache()
    try:
        batches.count()
        writers.compact_records(records_of(spark, root), f"{root}/{folder}")
        batches.select(
            F.lit(number).alias("number"), F.lit(folder).alias("folder"), "batch_id"
        ).write.mode("append").parquet(f"{root}/compacted")
    finally:
        batches.unpersist()


def start_run(
    spark: SparkSession,
    inputs: MigrationInputs,
    options: RunOptions,
    store_root: str,
    at: datetime | None = None,
) -> Execution:
    """Write the archive routes of an execution, RunStarted and the archive events."""
    prepare_session(spark)
    execution = Execution(spark, options, store_root, uuid.uuid4().hex[:12])
    batch_id = execution.batch_id("start")
    routed = route_archives(
        inputs.archives, inputs.identity_map, options, inputs.identity_order
    )
    routes = writers.keep_batch(routed, execution.path("archives"), batch_id)
    scope = f".{execution.number}"
    log = a.collect_audit(
        [
            run_started(spark, options, scope, at),
            archive_audit(routes, options, utc(at or options.as_of), scope),
        ]
    )
    writers.append_audit(log, execution.path("audit"), batch_id)
    execution.commit(batch_id, "start", f"start-{execution.number}", at)
    return execution


def routes_of(execution: Execution) -> DataFrame:
    rows = execution.read("archives", schemas.ROUTES, own=True)
    assert rows is not None
    return rows.drop("batch_id")


def unchanged_parts(
    known: DataFrame, inputs: MigrationInputs, needed: DataFrame
) -> DataFrame:
    """Verified parts whose metadata, and version if there is one, are still as they were."""
    now = inputs.parts.join(needed, "part_id", "left_semi").select(
        "part_id",
        F.lower("sha256").alias("_sha256"),
        F.col("size_bytes").alias("_size"),
    )
    same = (F.lower("stored_sha256") == F.col("_sha256")) & F.col("size_bytes").eqNullSafe(
        F.col("_size")
    )
    if "version" in inputs.blob_hashes.columns:
        versions = inputs.blob_hashes.select("part_id", F.col("version").alias("_version"))
        now = now.join(versions.join(needed, "part_id", "left_semi"), "part_id", "left")
        same &= F.col("version").eqNullSafe(F.col("_version"))
    # As one value the comparison is no key of the join, so all steps share the part's partition.
    same = F.coalesce(same, F.lit(False))
    return known.join(now, "part_id").where(same).select(*schemas.VERIFIED.names)


def verified_for(
    execution: Execution, inputs: MigrationInputs, refs: DataFrame, batch_id: str
) -> DataFrame:
    """Verified parts behind some references; bytes are hashed for new and changed parts only.

    Parts found good are kept in the store, so no later batch or run reads their bytes, as long
    as the stated hash and size are the same, and the version of the bytes where the source
    has one. Parts with an error are looked at again each time, as their bytes or metadata may
    have come. What is known of each part is written once, so the parts that are left are read
    back without the references, and known parts are not joined again.
    """
    needed = distinct_part_ids(refs)
    known = execution.read("verified_parts", schemas.VERIFIED)
    if known is not None:
        known = rows_with_keys(known.drop("batch_id"), needed, ["part_id"])
        known = unchanged_parts(known, inputs, needed).dropDuplicates(["part_id"])
        known = known.withColumn("known", F.lit(True))
        found = needed.join(known, "part_id", "left").select(*schemas.VERIFIED.names, "known")
        found = writers.keep_batch(found, execution.path("known_parts"), batch_id)
        known = found.where("known").drop("known")
        needed = found.where(F.col("known").isNull()).select("part_id")
    parts = inputs.parts.join(needed, "part_id", "left_semi")
    hashes = inputs.blob_hashes.join(needed, "part_id", "left_semi")
    checked = verify_parts(parts, hashes)
    if "version" in hashes.columns:
        checked = checked.join(hashes.select("part_id", "version"), "part_id", "left")
    else:
        checked = checked.withColumn("version", F.lit(None).cast("string"))
    fresh = writers.keep_batch(
        checked.select(*schemas.VERIFIED.names), execution.path("checked_parts"), batch_id
    )
    good = fresh.where(F.col("error").isNull())
    writers.write_batch(good, execution.path("verified_parts"), batch_id)
    return fresh if known is None else fresh.unionByName(known)


def _mark(
    execution: Execution, events: DataFrame, batch_id: str, at: datetime | None
) -> None:
    """Progress row of a batch: items of the run processed so far."""
    options = execution.options
    processed = F.col("event_type").isin("ItemMigrated", "ItemDryRun", *schemas.ERROR_EVENTS)
    before = execution.read("checkpoints", schemas.CHECKPOINTS)
    done = F.lit(0).cast("bigint")
    if before is not None:
        mine = before.where(F.col("run_id") == options.run_id)
        done = F.coalesce(
            mine.agg(F.max(payload_long(F.col("metadata"), "processedCount"))).scalar(), done
        )
    mark = events.agg(F.count_if(processed).alias("n")).select(
        F.lit(options.run_id).alias("run_id"),
        F.lit("Ingest").alias("phase"),
        utc(at or options.as_of).alias("created_at_utc"),
        audit_payload(processedCount=F.col("n") + done).alias("metadata"),
    )
    writers.save_checkpoints(mark, execution.path("checkpoints"), batch_id)


def migrate_batch(
    execution: Execution,
    inputs: MigrationInputs,
    name: str | None = None,
    at: datetime | None = None,
) -> DataFrame | None:
    """Take a batch of items up to the outbox; returns the items ready for delivery.

    Selected items, checked references and classified items are written and read back, so
    each later table is built from the same rows and a lost executor repeats only its own
    step. History tables are first cut down to the batch's keys. A batch with a ``name`` runs
    once in a run: when it is committed, nothing is done and None is returned.
    """
    if name is not None and execution.done(name):
        return None
    spark, options = execution.spark, execution.options
    batch_id = execution.batch_id("items")
    when = utc(at or options.as_of)

    def keep(table: str, rows: DataFrame) -> DataFrame:
        return writers.keep_batch(rows, execution.path(table), batch_id)

    def keep_all(table: str, rows: DataFrame) -> DataFrame:
        """``keep`` for joins of tables of this batch alone, where a filter drops nothing."""
        with without_key_filters(rows.sparkSession):
            return keep(table, rows)

    selected = keep("selected", select_items(inputs, options, routes_of(execution)))
    if inputs.records is not None:
        history = rows_with_keys(inputs.records, selected, ["idempotency_key"])
    else:
        history = records_with(execution, selected)
    if history is not None:
        # Keys of the batch that were delivered, found once; without any, nothing is joined.
        found = keep("delivered", ing.delivered_keys(history).withColumn("status", F.lit(schemas.DELIVERED[0])))
        history = None if found.isEmpty() else found
    flagged = flag_history(replace(inputs, records=history), selected)
    wanted = flagged.where(goes_on())
    if options.extensions.check_parts is not None:
        checked = keep("checked", checked_refs(inputs, wanted, options))
    else:
        refs = keep("refs", wanted_refs(inputs, wanted))
        verified = verified_for(execution, inputs, refs, batch_id)
        checked = keep_all("checked", check_refs(refs, verified))
    classified = keep_all("classified", classify_items(flagged, checked, options))
    ready = classified.where(F.col("event_type") == DELIVER)
    if not options.dry_run:
        messages = messages_of(classified, checked, options)
        with without_key_filters(messages.sparkSession):
            writers.write_outbox(messages, execution.path("outbox"), batch_id)
    items = with_results(classified, None)
    if not options.dry_run:
        entries = record_entries(items, options, when)
        writers.append_records(entries, execution.path("records"), batch_id)
        write_key_index(execution, batch_id)
    events = item_audit(with_error_detail(items, checked), options, when, f".{batch_id}")
    with without_key_filters(events.sparkSession):
        writers.append_audit(events, execution.path("audit"), batch_id)
    _mark(execution, items.where(F.col("event_type") != DELIVER), batch_id, at)
    execution.commit(batch_id, "items", name or batch_id, at)
    return ready


def times_of(execution: Execution) -> DataFrame:
    """Committed batches of the run with the time they were written."""
    commits = read_if_present(execution.spark, schemas.COMMITS, execution.path("commits"))
    assert commits is not None
    mine = commits.where(F.col("run_id") == execution.options.run_id)
    return mine.groupBy("batch_id").agg(F.max("written_utc").alias("written_utc"))


def attempts_to_count(execution: Execution, rollup: DataFrame) -> DataFrame:
    """Attempts per key that no record entry holds yet: all so far less those counted."""
    counted = execution.read("answered", schemas.ANSWERED)
    total = rollup.select("idempotency_key", "attempts", "at_utc")
    if counted is None:
        return total.withColumn("tries", F.col("attempts"))
    counted = rows_with_keys(counted, rollup, ["idempotency_key"])
    before = counted.groupBy("idempotency_key").agg(F.sum("tries").alias("_before"))
    left = F.col("attempts") - F.coalesce("_before", F.lit(0))
    return total.join(before, "idempotency_key", "left").withColumn("tries", left).drop("_before")


def awaiting(execution: Execution, keys: DataFrame) -> DataFrame | None:
    """Items of this run with one of the keys that were sent and are not delivered yet.

    Delivered keys are left out first, so only the rows of open keys are gathered.
    """
    rows = execution.read("classified", schemas.CLASSIFIED, run=True)
    if rows is None:
        return None
    records = records_with(execution, keys)
    if records is not None:
        keys = keys.join(ing.delivered_keys(records), "idempotency_key", "left_anti")
    sent = rows.where(F.col("event_type") == DELIVER)
    sent = rows_with_keys(sent, keys, ["idempotency_key"]).join(times_of(execution), "batch_id")
    rest = [c for c in schemas.CLASSIFIED.names if c != "idempotency_key"]
    one = sent.groupBy("idempotency_key").agg(
        F.max(F.struct("written_utc", "batch_id", *rest)).alias("_i")
    )
    return one.select("idempotency_key", "_i.*").select(*schemas.CLASSIFIED.names)


def apply_delivery(
    execution: Execution,
    receipts: DataFrame,
    name: str | None = None,
    at: datetime | None = None,
) -> None:
    """Apply a batch of the target's receipts to the items that await one.

    Attempts are rolled up per key over all receipts so far; the last one decides. Audit
    events and records carry the receipt's time. Keys worth another try are written to the
    retry queue, and keys that were tried before and need no more are marked as settled
    (``plans.retries`` reads both). Receipts of unknown or delivered keys are kept and change nothing.
    """
    if name is not None and execution.done(name):
        return
    options = execution.options
    batch_id = execution.batch_id("receipts")
    new = writers.keep_batch(
        receipts.select(*schemas.RECEIPTS.names), execution.path("receipts"), batch_id
    )
    keys = new.select("idempotency_key").distinct()
    earlier = execution.read("receipts", schemas.RECEIPTS)
    attempts = new
    if earlier is not None:
        earlier = rows_with_keys(earlier.drop("batch_id"), keys, ["idempotency_key"])
        attempts = new.unionByName(earlier)
    waiting = awaiting(execution, keys)
    if waiting is not None:
        rollup = attempt_rollup(attempts, ["at_utc", "attempt_no"])
        rollup = writers.keep_batch(rollup, execution.path("rollups"), batch_id)
        more = attempts_to_count(execution, rollup)
        answered = with_results(waiting, rollup).join(more, "idempotency_key")
        items = writers.keep_batch(answered, execution.path("answered"), batch_id)
        when = F.coalesce("at_utc", utc(at or options.as_of))
        entries = record_entries(items, options, when)
        writers.append_records(entries, execution.path("records"), batch_id)
        write_key_index(execution, batch_id)
        events = item_audit(without_detail(items), options, when, f".{batch_id}")
        writers.append_audit(events, execution.path("audit"), batch_id)
        mine = rollup.join(items.select("idempotency_key"), "idempotency_key", "left_semi")
        writers.write_batch(retry_queue(mine), execution.path("retry_queue"), batch_id)
        ended = ~F.col("retryable") | F.col("exhausted")
        settled = mine.where(ended & (F.col("attempts") > 1)).select(
            "idempotency_key", "attempts", F.lit("settled").alias("mark")
        )
        writers.write_batch(settled, execution.path("retry_marks"), batch_id)
        _mark(execution, items, batch_id, at)
    execution.commit(batch_id, "receipts", name or batch_id, at)


def audit_of(execution: Execution, whole_run: bool = False) -> DataFrame:
    """Committed events of this execution, or of all executions of its run."""
    rows = execution.read("audit", schemas.AUDIT, own=not whole_run, run=True)
    assert rows is not None
    return rows.where(F.col("run_id") == execution.options.run_id)


def last_events(events: DataFrame) -> DataFrame:
    """The last event of every item, and every archive event once."""
    order = F.struct("timestamp_utc", F.col("event_type") == "ItemMigrated", "id")
    items = events.where(F.col("item_id").isNotNull())
    last = items.groupBy("item_id").agg(F.max_by("event_type", order).alias("event_type"))
    archives = events.where(F.col("event_type").startswith("Archive"))
    once = archives.select("event_type", "payload").distinct()
    return last.select("event_type").unionByName(once.select("event_type"))


def finish_run(
    execution: Execution, at: datetime | None = None, whole_run: bool = False
) -> DataFrame:
    """Write RunCompleted and return the summary.

    Each scanned item counts once, by its last event or as pending. With ``whole_run`` the
    counters cover all executions of the run, as those of a stream that was started again.
    """
    options = execution.options
    log = audit_of(execution, whole_run)
    classified = execution.read("classified", schemas.CLASSIFIED, own=not whole_run, run=True)
    pending = F.lit(0).cast("bigint")
    if classified is not None:
        seen = log.where(F.col("item_id").isNotNull()).select("item_id")
        sent = classified.where(F.col("event_type") == DELIVER).select("item_id").distinct()
        pending = sent.join(seen, "item_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    batch_id = execution.batch_id("end")
    done = run_completed(
        routes_of(execution), last_events(log), options, f".{batch_id}", at, pending
    )
    writers.append_audit(done, execution.path("audit"), batch_id)
    execution.commit(batch_id, "end", batch_id, at)
    return run_summary(audit_of(execution, whole_run).drop("batch_id"), latest=True)


def _end(execution: Execution, event: str, payload: Column, at: datetime | None) -> None:
    batch_id = execution.batch_id("end")
    one = execution.spark.range(1)
    log = _run_event(one, execution.options, event, payload, f".{batch_id}", at)
    writers.append_audit(log, execution.path("audit"), batch_id)
    execution.commit(batch_id, "end", batch_id, at)


def fail_run(execution: Execution, error: str, at: datetime | None = None) -> None:
    """Write RunFailed; the run can be resumed under its id."""
    _end(execution, "RunFailed", audit_payload(error=F.lit(error)), at)


def cancel_run(execution: Execution, at: datetime | None = None) -> None:
    """Write RunCancelled; the run can be resumed under its id."""
    _end(execution, "RunCancelled", audit_payload(runId=F.lit(execution.options.run_id)), at)


def run_migration(
    spark: SparkSession,
    inputs: MigrationInputs,
    options: RunOptions,
    store_root: str,
    deliver: Deliver | None = None,
    at: datetime | None = None,
) -> DataFrame:
    """A whole run in one batch; returns its summary.

    ``deliver`` gets the items that are ready and returns the target's receipts; without it
    the items stay pending. An error ends the run with RunFailed.
    """
    execution = start_run(spark, inputs, options, store_root, at)
    try:
        ready = migrate_batch(execution, inputs, at=at)
        if deliver is not None and ready is not None and not options.dry_run:
            apply_delivery(execution, deliver(ready), at=at)
        return finish_run(execution, at)
    except Exception as error:
        fail_run(execution, str(error)[:500], at)
        raise


__all__ = [
    "Execution",
    "MigrationInputs",
    "MigrationPlan",
    "apply_delivery",
    "cancel_run",
    "classify_items",
    "compact_store",
    "fail_run",
    "finish_run",
    "migrate_batch",
    "plan_migration",
    "read_committed",
    "rejects",
    "run_migration",
    "select_items",
    "start_run",
]
