"""Messages and the target's answers as two streams that run together.

A message waits for an answer between its sending and a limit after it. Both streams have a
watermark: state is kept for as long as an answer may still come, and a message whose time is
over is returned without one. That becomes an event like any other outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.operators.delivery import error_code, ingest_status
from vaultferry.streaming.jobs import drain

NO_ANSWER = "NO_ANSWER"
# Key of the rows a quiet stream sends to move its watermark; no message has it.
HEARTBEAT = "-"
# The event of each kind of answer.
EVENTS = {
    "Ingested": "ItemMigrated",
    "AlreadyPresent": "ItemMigrated",
    "TransientError": "ItemTransientFailed",
    "PermanentError": "ItemPermanentFailed",
    "UnexpectedError": "ItemUnexpectedError",
}


def awaited(sent: DataFrame, receipts: DataFrame, within: str, late: str) -> DataFrame:
    """Every sent message (idempotency_key, sent_at) with its answers in time, or none.

    Works on streams and on tables. A message with several answers has a row for each.
    """
    asked = sent.withWatermark("sent_at", late).select("idempotency_key", "sent_at")
    came = receipts.withWatermark("at_utc", late).select(
        F.col("idempotency_key").alias("answer_key"),
        F.col("at_utc").alias("answered_at"),
        "http_status",
        "exception",
        "already_present",
    )
    in_time = (
        (F.col("idempotency_key") == F.col("answer_key"))
        & (F.col("answered_at") >= F.col("sent_at"))
        & (F.col("answered_at") <= F.col("sent_at") + F.expr(f"interval {within}"))
    )
    return asked.join(came, in_time, "left_outer").drop("answer_key")


def answer_event() -> tuple[Column, Column]:
    """Event type and error code of an awaited message."""
    status = ingest_status(F.col("http_status"), F.col("already_present"), F.col("exception"))
    event = F.when(F.col("answered_at").isNull(), EVENTS["TransientError"])
    for name, kind in EVENTS.items():
        event = event.when(status == name, kind)
    code = F.when(F.col("answered_at").isNull(), NO_ANSWER).otherwise(
        error_code(F.col("http_status"), F.col("exception"))
    )
    return event, code


def first_answers(rows: DataFrame) -> DataFrame:
    """The outcome of every message: its first answer, or that none came in time."""
    event, code = answer_event()
    values = ["answered_at", "http_status", "exception", "already_present"]
    first = rows.groupBy("idempotency_key", "sent_at").agg(
        F.min_by(F.struct(*values), F.struct(*values)).alias("_a")
    )
    return first.select("idempotency_key", "sent_at", "_a.*").select(
        "idempotency_key",
        "sent_at",
        "answered_at",
        event.alias("event_type"),
        code.alias("error_code"),
    )


def answers(sent: DataFrame, receipts: DataFrame, within: str) -> DataFrame:
    """Outcomes of a table of messages."""
    return first_answers(awaited(sent, receipts, within, "0 seconds"))


def drain_answers(
    sent: DataFrame, receipts: DataFrame, within: str, late: str, path: str, checkpoint: str
) -> DataFrame:
    """Join two streams as far as they go; returns the outcomes decided so far.

    Outcomes are appended once each. A message without an answer is decided when both streams
    have gone past its limit and ``late``; a quiet stream should send a row with the key
    ``HEARTBEAT`` from time to time, which moves its watermark and is left out here.
    """
    rows = awaited(sent, receipts, within, late)

    def handle(batch: DataFrame, number: int) -> None:
        keyed = batch.where(F.col("idempotency_key") != HEARTBEAT)
        keyed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    drain(rows, handle, checkpoint)
    found = sent.sparkSession.read.schema(rows.schema).parquet(path)
    return first_answers(found.drop("batch"))
