"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultferry.session import scratch_path

# Rows of one id column that may be sent to every executor (8 bytes each, 8 MB).
BROADCAST_IDS = 1_000_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit words over all 64 bits (splitmix finalizer)."""
    z = values.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= MIX_A
    z ^= z >> np.uint64(27)
    z *= MIX_B
    z ^= z >> np.uint64(31)
    return z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Send at most ``rows`` rows to Python at once while the block runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, batch: int = 2000) -> DataFrame:
    """Write the rows below the shared scratch folder and read them back.

    Cuts the lineage: every reader sees the same rows, and a lost executor costs no
    recomputation of the steps before. Python steps get ``batch`` rows at a time, so that
    whole texts fit in the memory of a worker.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    with arrow_rows(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def restrict(docs: DataFrame, ids: DataFrame, column: str, keep: bool) -> DataFrame:
    """Rows of ``docs`` whose ``column`` is (or is not) among the ids of a stored table.

    ``ids`` has one column named as none of ``docs``. The id list is counted: a short one
    goes to every executor and the texts stay where they are; a longer one is shuffled.
    """
    name = ids.columns[0]
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    how = "left_semi" if keep else "left_anti"
    return docs.join(ids, docs[column] == ids[name], how)
