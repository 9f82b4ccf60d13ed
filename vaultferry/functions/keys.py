"""Keys and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_BLANK = r"(?U)\S"


def not_blank(c: Column) -> Column:
    """True when the text has a non-white-space character; null counts as blank."""
    return F.coalesce(c.rlike(NOT_BLANK), F.lit(False))


def idempotency_key(vault: Column, archive: Column, item: Column) -> Column:
    """``ev:<vault>:<archive>:<item>``, or null when a part is blank."""
    usable = not_blank(vault) & not_blank(archive) & not_blank(item)
    return F.when(usable, F.concat(F.lit("ev:"), vault, F.lit(":"), archive, F.lit(":"), item))


def key_parts(key: Column) -> Column:
    """Struct of the three parts of a key, or null when the text is no key.

    The item part keeps any further colons.
    """
    pieces = F.split(key, ":", 4)
    valid = not_blank(key) & (F.size(pieces) == 4) & (F.get(pieces, F.lit(0)) == "ev")
    return F.when(
        valid,
        F.struct(
            F.get(pieces, F.lit(1)).alias("vault_store"),
            F.get(pieces, F.lit(2)).alias("archive_id"),
            F.get(pieces, F.lit(3)).alias("item_id"),
        ),
    )


def parse_keys(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Split a frame into rows with a parsed key and rows to set aside."""
    parsed = df.withColumn("parsed_key", key_parts(F.col(key)))
    good = parsed.where(F.col("parsed_key").isNotNull()).select(
        *[F.col(c) for c in df.columns],
        F.col("parsed_key.vault_store").alias("key_vault_store"),
        F.col("parsed_key.archive_id").alias("key_archive_id"),
        F.col("parsed_key.item_id").alias("key_item_id"),
    )
    bad = parsed.where(F.col("parsed_key").isNull()).drop("parsed_key")
    return good, bad


def target_id(key: Column) -> Column:
    """Repeatable target id: ``sx-`` and 128 bits of the key's digest."""
    return F.concat(F.lit("sx-"), F.substring(F.sha2(key, 256), 1, 32))


def event_id(*parts: Column) -> Column:
    """Repeatable GUID-shaped id from the parts that make an event unique."""
    digest = F.sha2(F.to_json(F.array(*[F.coalesce(p, F.lit("")) for p in parts])), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def short_run_id(run_id: Column) -> Column:
    return F.substring(run_id, 1, 8)


def snake_case(name: str) -> str:
    """``UTCDate`` -> ``utc_date``, ``MyField`` -> ``my_field``."""
    spaced = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return spaced.lower()


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def camel_case(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(t[:1].upper() + t[1:] for t in tail)


def camel_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[camel_case(c) for c in df.columns])
