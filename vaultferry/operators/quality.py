"""Table constraints and status transitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry import schemas
from vaultferry.operators.lookups import with_previous


@dataclass(frozen=True)
class Rules:
    """Constraints of one table."""

    key: Sequence[str]
    required: Sequence[str] = ()
    max_length: Mapping[str, int] = field(default_factory=dict)
    domain: Mapping[str, Sequence[str]] = field(default_factory=dict)


# Lengths of the declared columns.
ARCHIVE_RULES = Rules(
    key=("archive_id",),
    required=("archive_id", "type", "legal_hold", "vault_store"),
    max_length={"archive_id": 200, "type": 50, "owner_upn": 320, "vault_store": 200},
    domain={"type": schemas.ARCHIVE_TYPES},
)
ITEM_RULES = Rules(
    key=("item_id",),
    required=(
        "item_id",
        "archive_id",
        "folder_path",
        "subject",
        "sent_date_utc",
        "from",
        "retention_category",
        "size_bytes",
        "message_class",
    ),
    max_length={
        "item_id": 200,
        "archive_id": 200,
        "folder_path": 1000,
        "subject": 998,
        "from": 320,
        "retention_category": 200,
        "message_class": 100,
    },
)
PART_RULES = Rules(
    key=("part_id",),
    required=("part_id", "sha256", "size_bytes", "data_ref"),
    max_length={"part_id": 200, "sha256": 64, "data_ref": 2048},
)
RECORD_RULES = Rules(
    key=("idempotency_key",),
    required=(
        "idempotency_key",
        "source_item_id",
        "archive_id",
        "target_archive",
        "status",
        "extracted_at_utc",
        "attempt_count",
    ),
    max_length={
        "idempotency_key": 200,
        "source_item_id": 200,
        "archive_id": 200,
        "target_archive": 200,
        "target_id": 200,
        "status": 50,
        "last_error_code": 100,
    },
    domain={"status": schemas.MIGRATION_STATUSES},
)
AUDIT_RULES = Rules(
    key=("id",),
    required=("id", "timestamp_utc", "event_type", "payload", "run_id"),
    max_length={"id": 36, "event_type": 100, "item_id": 200, "run_id": 36},
    domain={"event_type": schemas.EVENT_TYPES},
)
CHECKPOINT_RULES = Rules(
    key=("run_id", "phase"),
    required=("run_id", "phase", "created_at_utc"),
    max_length={"run_id": 36, "phase": 100},
)


def broken_rules(df: DataFrame, rules: Rules) -> DataFrame:
    """One row per broken row rule: key columns (as text) and the rule's name."""
    present = set(df.columns)
    checks = [
        F.when(F.col(c).isNull(), F.lit(f"required:{c}")) for c in rules.required if c in present
    ]
    checks += [
        F.when(F.length(c) > n, F.lit(f"max_length:{c}"))
        for c, n in rules.max_length.items()
        if c in present
    ]
    checks += [
        F.when(~F.col(c).isin(*values), F.lit(f"domain:{c}"))
        for c, values in rules.domain.items()
        if c in present
    ]
    # One text per row, empty for a good row: cheap to build and to test, unlike an array.
    broken = df.select(_key_text(rules).alias("row_key"), F.concat_ws("|", *checks).alias("_r"))
    return broken.where(F.col("_r") != "").select(
        "row_key", F.explode(F.split("_r", "[|]")).alias("rule")
    )


def duplicate_keys(df: DataFrame, rules: Rules) -> DataFrame:
    """One row per key that occurs more than once."""
    repeated = df.groupBy(*rules.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.select(
        _key_text(rules).alias("row_key"), F.lit("unique:" + ",".join(rules.key)).alias("rule")
    )


def _key_text(rules: Rules) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rules.key])


def check_constraints(df: DataFrame, rules: Rules) -> DataFrame:
    return broken_rules(df, rules).unionByName(duplicate_keys(df, rules))


def illegal_transitions(history: DataFrame, order: Sequence[str]) -> DataFrame:
    """History rows whose step from the previous status of the key is not allowed."""
    allowed = [
        f"{a}>{b}" for a, nexts in schemas.STATUS_TRANSITIONS.items() for b in nexts
    ]
    stepped = with_previous(history, ["key"], order, "status", "previous_status")
    step = F.concat_ws(">", "previous_status", "status")
    return stepped.where(F.col("previous_status").isNotNull() & ~step.isin(*allowed))
