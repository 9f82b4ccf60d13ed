"""Content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.functions.keys import not_blank


def content_hash(content: Column) -> Column:
    """Lower-case hex SHA-256 of bytes or UTF-8 text."""
    return F.sha2(content, 256)


def normalize_hash(hex_digest: Column) -> Column:
    """The digest in lower case, or null unless it is 64 UTF-16 units long.

    Whether the characters are hex digits is left unchecked.
    """
    sized = F.octet_length(F.encode(hex_digest, "UTF-16BE")) == 128
    return F.when(not_blank(hex_digest) & sized, F.lower(hex_digest))


def split_hashes(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a normalised digest, and the rows whose digest is malformed."""
    tagged = df.withColumn("normalized_hash", normalize_hash(F.col(column)))
    good = tagged.where(F.col("normalized_hash").isNotNull())
    bad = tagged.where(F.col("normalized_hash").isNull()).drop("normalized_hash")
    return good, bad


def packed_hash(text: Column) -> Column:
    """A text as bytes, 64 lower-case hex digits as 32 of them; different texts stay different."""
    raw = F.when(F.octet_length(text) == 64, F.unhex(text))
    plain = F.concat(F.lit(b"\x00"), F.encode(text, "UTF-8"))
    return F.when(F.lower(F.hex(raw)) == text, F.concat(F.lit(b"\x01"), raw)).otherwise(plain)


def unpacked_hash(packed: Column) -> Column:
    """The text behind ``packed_hash``."""
    rest = F.substring(packed, 2, 2147483647)
    hashed = F.substring(packed, 1, 1) == F.lit(b"\x01")
    return F.when(hashed, F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))
