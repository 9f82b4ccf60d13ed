"""Writers for the audit log, records, checkpoints, exports and the outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultferry.functions.keys import camel_case_columns
from vaultferry.operators.audit import AUDIT_COLUMNS, filter_events, order_audit
from vaultferry.operators.state import fold_checkpoints, fold_records
from vaultferry.schemas import with_batch

JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def write_batch(df: DataFrame, path: str, batch_id: str, *partitions: str) -> None:
    """Append a batch; writing the same batch again replaces it and adds nothing."""
    (
        df.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", *partitions)
        .parquet(path)
    )


def read_batch(spark: SparkSession, schema: T.StructType, path: str, batch_id: str) -> DataFrame:
    """Rows of one batch; none when the batch was empty."""
    rows = spark.read.schema(with_batch(schema)).parquet(path)
    return rows.where(F.col("batch_id") == F.lit(batch_id)).drop("batch_id")


def keep_batch(df: DataFrame, path: str, batch_id: str) -> DataFrame:
    """Write a batch and return it as read back, cut off from the plan that made it."""
    write_batch(df, path, batch_id)
    return read_batch(df.sparkSession, df.schema, path, batch_id)


def append_audit(events: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Append events below one folder per run."""
    columns = events.select(*AUDIT_COLUMNS)
    if batch_id is None:
        columns.write.mode("append").partitionBy("run_id").parquet(path)
        return
    (
        columns.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "batch_id")
        .parquet(path)
    )


def append_records(entries: DataFrame, path: str, batch_id: str) -> None:
    """Add a batch of record rows to the log; readers fold it with ``fold_records``."""
    write_batch(entries, path, batch_id)


def compact_records(log: DataFrame, new_path: str) -> None:
    """Write the folded log to a new folder; the folder being read is left alone."""
    fold_records(log).write.mode("errorifexists").parquet(new_path)


def save_checkpoints(rows: DataFrame, path: str, batch_id: str) -> None:
    write_batch(rows, path, batch_id)


def compact_checkpoints(log: DataFrame, new_path: str) -> None:
    fold_checkpoints(log).write.mode("errorifexists").parquet(new_path)


def audit_export(events: DataFrame, run_id: str) -> DataFrame:
    """A run's events in time order with the export's columns and time text."""
    ordered = order_audit(filter_events(events, run_id))
    return ordered.select(
        "id",
        F.date_format("timestamp_utc", JSON_TIME).alias("timestamp_utc"),
        "event_type",
        "item_id",
        "payload",
        "run_id",
    )


def export_audit_csv(events: DataFrame, run_id: str, path: str) -> None:
    """CSV files in time order, part by part; quotes inside values are doubled."""
    header = ("Id", "TimestampUtc", "EventType", "ItemId", "Payload", "RunId")
    (
        audit_export(events, run_id)
        .toDF(*header)
        .write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def export_audit_json(events: DataFrame, run_id: str, path: str) -> None:
    """JSON lines in time order with camelCase names; nulls are left out."""
    camel_case_columns(audit_export(events, run_id)).write.json(path)


def outbox_rows(messages: DataFrame) -> DataFrame:
    """archive_class and the message as JSON text; nulls are left out."""
    body = F.to_json(
        F.struct(*[F.col(c) for c in messages.columns]), {"timestampFormat": JSON_TIME}
    )
    return messages.select(F.col("archiveClass").alias("archive_class"), body.alias("message"))


def write_outbox(messages: DataFrame, path: str, batch_id: str) -> None:
    """One JSON message per line, below one folder per batch and archive class."""
    write_outbox_lines(outbox_rows(messages), path, batch_id)


def write_outbox_lines(lines: DataFrame, path: str, batch_id: str) -> None:
    """Messages that are text already (archive_class, message), packed with gzip at its fastest."""
    (
        lines.select("archive_class", "message")
        .withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .partitionBy("batch_id", "archive_class")
        .text(path)
    )
