"""Content parts: verification, ordered lookup and per-item result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultferry.operators.lookups import lookup_join
from vaultferry.schemas import PART_ERRORS

BLOB_NOT_FOUND, PART_NOT_FOUND, HASH_MISMATCH = PART_ERRORS


def verify_parts(parts: DataFrame, blob_hashes: DataFrame) -> DataFrame:
    """Check every part once: part_id, sha256 (of the bytes), size_bytes, error, message.

    A part whose bytes are missing reports that before missing metadata, and missing
    metadata before a wrong hash. The size is the one the metadata states.
    """
    stored = parts.select("part_id", F.col("sha256").alias("stored_sha256"), "size_bytes")
    read = blob_hashes.select("part_id", F.col("sha256").alias("sha256"))
    both = stored.join(read, "part_id", "full")
    error = (
        F.when(F.col("sha256").isNull(), BLOB_NOT_FOUND)
        .when(F.col("stored_sha256").isNull(), PART_NOT_FOUND)
        .when(F.lower("stored_sha256") != F.col("sha256"), HASH_MISMATCH)
    )
    return both.select("part_id", "sha256", "stored_sha256", "size_bytes", error.alias("error"))


def part_refs(items: DataFrame) -> DataFrame:
    """One row per entry of an item's part list, with its position; repeats are kept."""
    return items.select("item_id", F.posexplode("content_part_ids").alias("pos", "part_id"))


def distinct_part_ids(refs: DataFrame) -> DataFrame:
    return refs.select("part_id").distinct()


def check_refs(refs: DataFrame, verified: DataFrame) -> DataFrame:
    """Every reference with the verified part behind it, or the error it runs into.

    ``pos`` is a whole number that grows along an item's list. Verified parts are wide and may be
    nearly as many as the references of a batch, so they are not repeated: adaptive execution
    splits a partition with a hot part.
    """
    known = verified.withColumn("known", F.lit(True))
    joined = lookup_join(
        refs, known, ["part_id"], "left", [F.col("item_id"), F.col("pos")], salts=1
    )
    error = F.when(F.col("known").isNull(), F.lit(BLOB_NOT_FOUND)).otherwise(F.col("error"))
    return joined.select(
        "item_id", "pos", "part_id", "sha256", "stored_sha256", "size_bytes", error.alias("error")
    )


def item_content(checked: DataFrame) -> DataFrame:
    """Per item: part count, bytes, and code and position of the first error in list order.

    Position and error code share one whole number, so that count, sum and minimum run in
    a hash aggregate that combines before the shuffle; an item may own any number of parts.
    The number is a decimal with room for every position, made for references with an error only.
    """
    code = F.lit(None).cast("int")
    for number, name in enumerate(PART_ERRORS):
        code = F.when(F.col("error") == name, F.lit(number)).otherwise(code)
    base = len(PART_ERRORS)
    place = F.col("pos").cast("decimal(19,0)") * F.lit(base).cast("decimal(2,0)")
    number = (place + code.cast("decimal(2,0)")).cast("decimal(22,0)")
    first = F.min(F.when(F.col("error").isNotNull(), number))
    names = F.array(*[F.lit(name) for name in PART_ERRORS])
    return (
        checked.groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("n_parts"), F.sum("size_bytes").alias("bytes"), first.alias("_e"))
        .select(
            "item_id",
            "n_parts",
            F.coalesce("bytes", F.lit(0)).alias("bytes"),
            F.get(names, F.pmod("_e", F.lit(base)).cast("int")).alias("error_code"),
            F.floor(F.col("_e") / F.lit(base).cast("decimal(2,0)")).cast("bigint").alias("error_pos"),
        )
    )


def with_content(items: DataFrame, content: DataFrame) -> DataFrame:
    """Items with their content figures; an item without parts is valid."""
    return items.join(content, "item_id", "left").withColumns(
        {
            "n_parts": F.coalesce("n_parts", F.lit(0)).cast("bigint"),
            "bytes": F.coalesce("bytes", F.lit(0)).cast("bigint"),
        }
    )


def rehydrate(
    items: DataFrame, refs: DataFrame, parts: DataFrame, blob_hashes: DataFrame
) -> DataFrame:
    """Items with n_parts, bytes and, where a part is bad, the first error."""
    checked = check_refs(refs, verify_parts(parts, blob_hashes))
    return with_content(items, item_content(checked))


def with_error_detail(items: DataFrame, checked: DataFrame) -> DataFrame:
    """Add part id and hashes behind each item's first error.

    Only references with an error are read, one per position, and only items with an error
    are joined; the others do not travel.
    """
    detail = F.struct(
        F.col("part_id").alias("error_part"),
        F.col("stored_sha256").alias("error_stored_sha256"),
        F.col("sha256").alias("error_sha256"),
    )
    bad = (
        checked.where(F.col("error").isNotNull())
        .groupBy("item_id", F.col("pos").cast("bigint").alias("error_pos"))
        .agg(F.min(detail).alias("_d"))
        .select("item_id", "error_pos", "_d.*")
    )
    joined = lookup_join(
        items.where(F.col("error_pos").isNotNull()),
        bad,
        ["item_id", "error_pos"],
        "left",
        [F.col("item_id")],
        salts=1,
    )
    names = ("error_part", "error_stored_sha256", "error_sha256")
    good = items.where(F.col("error_pos").isNull())
    return joined.unionByName(good.withColumns({c: F.lit(None).cast("string") for c in names}))


def assemble_parts(checked: DataFrame) -> DataFrame:
    """The ordered part list of every item: ``item_id, parts``.

    A list is one value of its message, as it was one value of its item at the source; steps
    that must not gather use ``checked`` itself. Positions need not be dense.
    """
    part = F.struct(
        "pos",
        F.struct(
            F.col("part_id").alias("partId"),
            F.col("sha256").alias("sha256"),
            F.col("size_bytes").alias("sizeBytes"),
        ).alias("part"),
    )
    grouped = checked.groupBy("item_id").agg(F.sort_array(F.collect_list(part)).alias("_ordered"))
    return grouped.select("item_id", F.col("_ordered.part").alias("parts"))
