"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A split of a hot join partition is worth one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming state on disk instead of the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # One state store per join task instead of four.
    "spark.sql.streaming.join.stateFormatVersion": "3",
    # A micro-batch writes what it changed; whole snapshots follow in the background.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Parquet files shrink several times; judge broadcast sizes by the unpacked size.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # A large table that is cut by the keys of a batch drops most other rows in its scan, by a
    # Bloom filter of 4 MB, instead of shuffling them all.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "64m",
    # Keys that take more are too many for the filter: it would let nearly all rows pass, while
    # each task that makes it sends its 4 MB to a single one.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "128m",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(1 << 25),
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan in this package relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def without_key_filters(spark: SparkSession) -> Iterator[None]:
    """No Bloom filters in the queries that run inside."""
    name = "spark.sql.optimizer.runtime.bloomFilter.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a fresh local one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="vaultferry-")
    sc.setCheckpointDir(local)
    return scratch_root(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared scratch root; never one in use before."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so every reader sees the same rows."""
    spark = df.sparkSession
    root = scratch_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once to a new scratch folder, packed, and return them as read back.

    ``durable`` writes plain rows, several times as large; it keeps their order.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
