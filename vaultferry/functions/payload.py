"""JSON payloads of audit events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def audit_payload(**fields: Column) -> Column:
    """JSON object with the given properties; nulls are kept."""
    body = F.struct(*[c.alias(name) for name, c in fields.items()])
    return F.to_json(body, {"ignoreNullFields": "false"})


def payload_text(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def payload_long(payload: Column, name: str) -> Column:
    """Whole-number property, 0 when absent."""
    return F.coalesce(payload_text(payload, name).try_cast("bigint"), F.lit(0).cast("bigint"))
