"""Table schemas and value domains. Readers use these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS, _L = T.StringType(), T.TimestampType(), T.LongType()
_LIST = T.ArrayType(_S)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


ARCHIVES = _schema(
    ("archive_id", _S, False),
    ("type", _S, False),
    ("owner_upn", _S, True),
    ("legal_hold", T.BooleanType(), False),
    ("vault_store", _S, False),
)

ROUTES = T.StructType(
    [
        *ARCHIVES.fields,
        T.StructField("target_archive", _S),
        T.StructField("orphan_reason", _S),
        T.StructField("route", _S, False),
    ]
)

ITEMS = _schema(
    ("item_id", _S, False),
    ("archive_id", _S, False),
    ("folder_path", _S, False),
    ("subject", _S, False),
    ("sent_date_utc", _TS, False),
    ("from", _S, False),
    ("to", _LIST, False),
    ("cc", _LIST, False),
    ("bcc", _LIST, False),
    ("content_part_ids", _LIST, False),
    ("retention_category", _S, False),
    ("size_bytes", _L, False),
    ("message_class", _S, False),
)

PARTS = _schema(
    ("part_id", _S, False),
    ("sha256", _S, False),
    ("size_bytes", _L, False),
    ("data_ref", _S, False),
)

RECORDS = _schema(
    ("idempotency_key", _S, False),
    ("source_item_id", _S, False),
    ("archive_id", _S, False),
    ("target_archive", _S, False),
    ("target_id", _S, True),
    ("status", _S, False),
    ("extracted_at_utc", _TS, False),
    ("ingested_at_utc", _TS, True),
    ("last_attempt_at_utc", _TS, False),
    ("attempt_count", T.IntegerType(), False),
    ("last_error_code", _S, True),
)

AUDIT = _schema(
    ("id", _S, False),
    ("timestamp_utc", _TS, False),
    ("event_type", _S, False),
    ("item_id", _S, True),
    ("payload", _S, False),
    ("run_id", _S, False),
)

CHECKPOINTS = _schema(
    ("run_id", _S, False),
    ("phase", _S, False),
    ("created_at_utc", _TS, False),
    ("metadata", _S, True),
)

IDENTITY_MAP = _schema(("upn", _S, False), ("target_archive", _S, False))

REGISTRY = _schema(
    ("idempotency_key", _S, False),
    ("target_id", _S, False),
    ("target_archive", _S, False),
    ("deduped", T.BooleanType(), False),
)

PART_STORE = _schema(("sha256", _S, False), ("part_id", _S, False), ("size_bytes", _L, False))

RECEIPTS = _schema(
    ("idempotency_key", _S, False),
    ("attempt_no", T.IntegerType(), False),
    ("http_status", T.IntegerType(), True),
    ("target_id", _S, True),
    ("deduped", T.BooleanType(), True),
    ("already_present", T.BooleanType(), True),
    ("retry_after", T.DoubleType(), True),
    ("exception", _S, True),
    ("at_utc", _TS, True),
)

# What a run's store holds beside the tables above.
COMMITS = _schema(
    ("batch_id", _S, False),
    ("run_id", _S, False),
    ("execution", _S, False),
    ("kind", _S, False),
    ("name", _S, False),
    ("at_utc", _TS, False),
    # Wall-clock time, to tell which of two batches came later.
    ("written_utc", _TS, True),
)
COMPACTED = _schema(
    ("number", T.IntegerType(), False), ("folder", _S, False), ("batch_id", _S, False)
)
VERIFIED = _schema(
    ("part_id", _S, False),
    ("sha256", _S, True),
    ("stored_sha256", _S, True),
    ("size_bytes", _L, True),
    ("error", _S, True),
    ("version", _S, True),
)
# Attempts that the record entries of answered items counted.
ANSWERED = _schema(("idempotency_key", _S, False), ("tries", _L, True))
# Keys to try again, and what became of them: sent again, or settled.
RETRIES = _schema(("idempotency_key", _S, False), ("attempts", _L, False), ("due_at_utc", _TS, True))
RETRY_MARKS = _schema(
    ("idempotency_key", _S, False), ("attempts", _L, False), ("mark", _S, False)
)
OUTBOX = _schema(("message", _S, False), ("archive_class", _S, True))
# The columns of a classified item that its delivery needs.
CLASSIFIED = _schema(
    ("item_id", _S, False),
    ("archive_id", _S, False),
    ("target_archive", _S, True),
    ("idempotency_key", _S, True),
    ("outcome", _S, False),
    ("error_code", _S, True),
    ("error_pos", _L, True),
    ("exception", _S, True),
    ("event_type", _S, False),
)


def with_batch(schema: T.StructType) -> T.StructType:
    """The schema with the batch folder as a column."""
    return T.StructType([*schema.fields, T.StructField("batch_id", _S)])


# The value domains, error codes and event types of the data model.
ARCHIVE_TYPES = ("Mailbox", "Journal", "Fsa")
ARCHIVE_CLASSES = {
    "Mailbox": "user_mailbox",
    "Journal": "compliance_journal",
    "Fsa": "file_archive",
}
MIGRATION_STATUSES = (
    "Discovered",
    "Mapped",
    "Orphaned",
    "SkippedByPolicy",
    "Rehydrated",
    "Transformed",
    "Ingesting",
    "Migrated",
    "Failed",
    "AlreadyPresent",
)
STATUS_TRANSITIONS = {
    "Discovered": ("Mapped", "Orphaned", "SkippedByPolicy"),
    "Mapped": ("Rehydrated",),
    "Rehydrated": ("Transformed",),
    "Transformed": ("Ingesting",),
    "Ingesting": ("Migrated", "Failed", "AlreadyPresent"),
    "Failed": ("Rehydrated",),
}
POLICY_OUTCOMES = ("Proceed", "Orphaned", "LegalHoldRetain", "LegalHoldMigrate", "SkippedByFilter")
DELIVERED = ("Migrated", "AlreadyPresent")
PART_ERRORS = ("BLOB_NOT_FOUND", "PART_NOT_FOUND", "HASH_MISMATCH")
EVENT_TYPES = (
    "RunStarted",
    "RunCompleted",
    "RunFailed",
    "RunCancelled",
    "ArchiveLegalHoldRetained",
    "ArchiveOrphaned",
    "ItemSkipped",
    "ItemAlreadyPresent",
    "ItemDryRun",
    "ItemMigrated",
    "ItemTransientFailed",
    "ItemPermanentFailed",
    "ItemUnexpectedError",
)
ERROR_EVENTS = ("ItemPermanentFailed", "ItemTransientFailed", "ItemUnexpectedError")
RUN_EVENTS = {
    "RunStarted": "Running",
    "RunCompleted": "Completed",
    "RunFailed": "Failed",
    "RunCancelled": "Cancelled",
}
