"""Trigram index of the audit log, so that a search opens few batches.

For every batch of the log the index lists the three-letter pieces of its item ids and event
types. A text can be inside one of them only if all its pieces are in the batch; batches that
lack one are not opened, the others are searched exactly. Batches without an index are always
opened, and so are all batches for a text of fewer than three letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.operators.audit import search_events

PIECE = 3


def pieces(text: Column) -> Column:
    """Distinct pieces of the lower-cased text; none if it is null or too short."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(low) - (PIECE - 1))
    cut = F.transform(starts, lambda i: F.substring(low, i, F.lit(PIECE)))
    return F.when(F.length(low) >= PIECE, F.array_distinct(cut)).otherwise(
        F.array().cast("array<string>")
    )


def trigram_index(events: DataFrame, batch: str = "batch_id") -> DataFrame:
    """``(batch, piece)`` of the batches in ``events``; an empty piece marks each indexed batch.

    Pieces are made distinct before the shuffle, which holds a batch's vocabulary at most. The
    rows of a new batch are appended to those of the others; a batch indexed twice does no harm.
    """
    found = F.concat(F.array(F.lit("")), pieces(F.col("item_id")), pieces(F.col("event_type")))
    return events.select(batch, F.explode(found).alias("piece")).distinct()


def ruled_out(index: DataFrame, text: str, batch: str = "batch_id") -> DataFrame:
    """Indexed batches in which the text cannot be."""
    spark = index.sparkSession
    asked = [p for (row,) in spark.range(1).select(pieces(F.lit(text))).collect() for p in row]
    there = F.count_distinct(F.when(F.col("piece").isin(asked), F.col("piece")))
    return index.groupBy(batch).agg(there.alias("there")).where(F.col("there") < len(asked)).select(batch)


def indexed_search(
    log: DataFrame,
    index: DataFrame,
    text: str = "",
    event_type: str | None = None,
    batch: str = "batch_id",
) -> DataFrame:
    """Same rows as ``search_events(log, text, event_type)``; ``log`` is partitioned by batch.

    Only names of batches reach the driver, where files are listed; the filter on them is a
    partition filter.
    """
    gone = [r[0] for r in ruled_out(index, text, batch).collect() if r[0] is not None]
    if gone:
        log = log.where(F.col(batch).isNull() | ~F.col(batch).isin(gone))
    return search_events(log, text, event_type)
