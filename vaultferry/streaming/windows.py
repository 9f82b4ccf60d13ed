"""Windowed aggregates of a stream, finished and open windows apart.

A window that the watermark has passed is appended once and never touched again. The others are
a small table that every micro-batch writes anew, so reading folds no revisions, and what is kept
does not grow with the number of times a window changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultferry.sources.readers import read_if_present
from vaultferry.streaming.jobs import drain


def _with_number(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def open_windows(df: DataFrame, path: str, before: int | None = None) -> DataFrame | None:
    """The open windows that the newest micro-batch (before some number) left."""
    rows = read_if_present(df.sparkSession, _with_number(df.schema), f"{path}/open")
    if rows is None:
        return None
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    newest = rows.agg(F.max("batch")).first()[0]
    return None if newest is None else rows.where(F.col("batch") == newest).drop("batch")


def drain_windows(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    length: str,
    late: str,
    path: str,
    checkpoint: str,
) -> DataFrame:
    """Drain a windowed aggregate with a watermark of ``late``; returns all windows.

    ``start`` is the window's first moment and among ``keys``. A window is finished when it
    ends ``late`` before the newest window begins: the stream's own watermark is never behind
    that, so no later row can reach it. A repeated micro-batch replaces what it wrote.
    """

    def handle(batch: DataFrame, number: int) -> None:
        earlier = open_windows(df, path, number)
        rows = batch if earlier is None else earlier.join(batch, list(keys), "left_anti").unionByName(batch)
        newest = rows.agg(F.max(start)).first()[0]
        if newest is None:
            return
        limit = F.lit(newest) - F.expr(f"interval {late}")
        ended = F.col(start) + F.expr(f"interval {length}") <= limit
        rows.where(ended).write.mode("overwrite").parquet(f"{path}/final/batch={number}")
        rows.where(~ended).write.mode("overwrite").parquet(f"{path}/open/batch={number}")

    drain(df, handle, checkpoint, "update")
    final = read_if_present(df.sparkSession, _with_number(df.schema), f"{path}/final")
    still = open_windows(df, path)
    if final is None or still is None:
        return df.sparkSession.createDataFrame([], df.schema)
    return final.drop("batch").unionByName(still)
