"""Table, blob and identity-map readers. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultferry import schemas
from vaultferry.functions.hashing import content_hash

LIST_COLUMNS = ("to", "cc", "bcc", "content_part_ids")


def read_table(
    spark: SparkSession, schema: T.StructType, location: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Read files of any Spark format, a catalog table (``table``) or a database (``jdbc``)."""
    if fmt == "table":
        return spark.table(location).select(*schema.names)
    if fmt == "jdbc":
        reader = spark.read.format("jdbc").options(**options).option("dbtable", location)
        return reader.load().select(*schema.names)
    return spark.read.format(fmt).options(**options).schema(schema).load(location)


def read_if_present(
    spark: SparkSession, schema: T.StructType, location: str, fmt: str = "parquet", **options: str
) -> DataFrame | None:
    """Like ``read_table``, but None when there is nothing at the location."""
    try:
        return read_table(spark, schema, location, fmt, **options)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            return None
        raise


def read_archives(spark: SparkSession, location: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return read_table(spark, schemas.ARCHIVES, location, fmt, **options)


def parse_json_list(text: Column) -> Column:
    """JSON text to a list of strings; JSON null and missing text give an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def to_json_list(values: Column) -> Column:
    return F.to_json(values)


def parse_json_lists(df: DataFrame, columns: Sequence[str] = LIST_COLUMNS) -> DataFrame:
    return df.withColumns({c: parse_json_list(F.col(c)) for c in columns})


def read_items(
    spark: SparkSession,
    location: str,
    fmt: str = "parquet",
    json_lists: bool = False,
    **options: str,
) -> DataFrame:
    """All items; with ``json_lists`` the list columns are JSON text in the source."""
    if not json_lists:
        return read_table(spark, schemas.ITEMS, location, fmt, **options)
    text = T.StructType(
        [
            T.StructField(f.name, T.StringType(), True) if f.name in LIST_COLUMNS else f
            for f in schemas.ITEMS.fields
        ]
    )
    return parse_json_lists(read_table(spark, text, location, fmt, **options))


def read_parts(spark: SparkSession, location: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return read_table(spark, schemas.PARTS, location, fmt, **options)


def blob_hashes(blobs: DataFrame) -> DataFrame:
    """part_id, sha256 and byte count of (part_id, content) rows; the bytes are dropped at once.

    A ``version`` of the bytes (a time, a length) is kept, so that changed bytes are read again.
    """
    return blobs.select(
        "part_id",
        content_hash(F.col("content")).alias("sha256"),
        F.octet_length("content").cast("bigint").alias("blob_bytes"),
        *[c for c in ("version",) if c in blobs.columns],
    )


def read_blobs(spark: SparkSession, directory: str, listing: DataFrame) -> DataFrame:
    """Hash and size of every ``<part_id>.bin`` file in a folder.

    Spark's file scan leaves out files without bytes, so the store's ``listing`` (part_id,
    length) is needed: an empty blob is in it with length 0, a missing one is not. Without a
    listing keep (part_id, content) tables and use ``blob_hashes``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(directory)
    named = files.select(
        F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("part_id"), F.col("content")
    )
    empty = listing.where("length = 0").select("part_id", F.lit("").cast("binary").alias("content"))
    return blob_hashes(named.unionByName(empty))


IDENTITY_DOCUMENT = "mappings array<struct<upn: string, targetArchiveId: string>>"


def identity_entries(documents: DataFrame) -> DataFrame:
    """(upn, target_archive, pos) rows of identity-map documents."""
    return documents.select(F.posexplode("mappings").alias("pos", "m")).select(
        F.col("m.upn").alias("upn"),
        F.col("m.targetArchiveId").alias("target_archive"),
        "pos",
    )


def read_identity_map(spark: SparkSession, location: str, fmt: str = "json", **options: str) -> DataFrame:
    """Identity map as (upn, target_archive, pos) rows, in file order for JSON documents.

    One JSON document is read by one task; keep large maps as a two-column table.
    """
    if fmt == "json":
        documents = spark.read.schema(IDENTITY_DOCUMENT).json(location, multiLine=True)
        return identity_entries(documents)
    table = read_table(spark, schemas.IDENTITY_MAP, location, fmt, **options)
    return table.withColumn("pos", F.lit(0))


def read_records(
    spark: SparkSession, location: str, status: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    records = read_table(spark, schemas.RECORDS, location, fmt)
    return records if status is None else records.where(F.col("status") == status)


def read_audit(
    spark: SparkSession,
    location: str,
    run_id: str | None = None,
    event_types: Sequence[str] | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Audit events; files are partitioned by run, so a run filter reads only its folders."""
    events = read_table(spark, schemas.AUDIT, location, fmt)
    if run_id is not None:
        events = events.where(F.col("run_id") == run_id)
    if event_types is not None:
        events = events.where(F.col("event_type").isin(*event_types))
    return events


def read_checkpoints(
    spark: SparkSession, location: str, run_id: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    rows = read_table(spark, schemas.CHECKPOINTS, location, fmt)
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


def read_target_registry(
    spark: SparkSession, registry: str, part_store: str, fmt: str = "parquet"
) -> tuple[DataFrame | None, DataFrame | None]:
    """(registry, part store) of the target, None for what does not exist yet."""
    return (
        read_if_present(spark, schemas.REGISTRY, registry, fmt),
        read_if_present(spark, schemas.PART_STORE, part_store, fmt),
    )


def read_receipts(
    spark: SparkSession, location: str, fmt: str = "parquet", stream: bool = False, **options: str
) -> DataFrame:
    """Delivery receipts, as a table or as a stream of arriving files."""
    if not stream:
        return read_table(spark, schemas.RECEIPTS, location, fmt, **options)
    return spark.readStream.format(fmt).options(**options).schema(schemas.RECEIPTS).load(location)
