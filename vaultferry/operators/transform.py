"""Target messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultferry.functions import messages as m
from vaultferry.functions.keys import idempotency_key
from vaultferry.functions.times import utc
from vaultferry.options import RunOptions

# Fixed value of the message.
SOURCE_SYSTEM = "EnterpriseVault"
PART_LIST = T.ArrayType(
    T.StructType(
        [
            T.StructField("partId", T.StringType()),
            T.StructField("sha256", T.StringType()),
            T.StructField("sizeBytes", T.LongType()),
        ]
    )
)


def build_messages(
    archive_items: DataFrame, part_lists: DataFrame | None, options: RunOptions
) -> DataFrame:
    """Nested target message, one per item.

    ``archive_items`` are items joined with their archive and target; ``part_lists`` holds their
    ordered part lists. Rows that cannot be transformed must be left out before (see
    ``transform_error``).
    """
    if part_lists is None:
        listed = archive_items.withColumn("parts", F.lit(None).cast(PART_LIST))
    else:
        listed = archive_items.join(part_lists, "item_id", "left")
    col = F.col
    return listed.select(
        idempotency_key(col("vault_store"), col("archive_id"), col("item_id")).alias(
            "idempotencyKey"
        ),
        col("target_archive").alias("targetArchive"),
        m.archive_class(col("type")).alias("archiveClass"),
        F.struct(
            F.lit(SOURCE_SYSTEM).alias("system"),
            col("archive_id").alias("archiveId"),
            col("item_id").alias("itemId"),
            col("vault_store").alias("vaultStore"),
        ).alias("source"),
        m.build_metadata(
            col("type"),
            col("subject"),
            col("from"),
            col("message_class"),
            col("folder_path"),
            col("sent_date_utc"),
            col("to"),
            col("cc"),
            col("bcc"),
        ).alias("metadata"),
        F.struct(
            col("retention_category").alias("category"),
            m.retention_expiry(col("retention_category"), col("sent_date_utc")).alias(
                "expiresUtc"
            ),
        ).alias("retention"),
        col("legal_hold").alias("legalHold"),
        F.struct(
            F.coalesce(col("parts"), F.array().cast(PART_LIST)).alias("parts"),
        ).alias("content"),
        F.struct(
            utc(options.as_of).alias("extractedAtUtc"),
            F.lit(options.run_id).alias("runId"),
            F.lit(options.tool_version).alias("toolVersion"),
        ).alias("chainOfCustody"),
    )


def transform_error() -> Column:
    """Exception name for an item that has no valid message, else null."""
    unknown_type = m.archive_class(F.col("type")).isNull()
    too_late = ~m.expiry_in_range(F.col("retention_category"), F.col("sent_date_utc"))
    return F.when(unknown_type | too_late, F.lit("ArgumentOutOfRangeException"))
