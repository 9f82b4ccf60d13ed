"""Folds and training samples for the classifiers."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A model is fitted on at most this many labelled rows, picked by a hash of their ids. Their
# texts may be of any length, as long as all together have at most this many bytes a row.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 16_384
# Rows of a rare label that are considered in any case.
LEAST = 20


def fold(doc_id: Column, folds: int) -> Column:
    """Fold of a row: CRC-32 of its id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    column: str,
    folds: int,
    held_out: int,
    rows: int = SAMPLE_ROWS,
    size: int = SAMPLE_BYTES,
) -> tuple[list[bytes], list[int]]:
    """Texts and 0/1 labels of a bounded sample outside the held-out fold, in a fixed order.

    Repeated labels of an id are averaged; ids without a text are left out. The first ``rows``
    rows by hash are considered, and of a label that is rare among them the first ``LEAST``.
    Texts up to half the mean bound are all taken. Longer ones, the labels by turns, are taken
    as far as the bound of ``rows * size`` bytes allows: one that does not fit is passed over
    and the next is tried, so no text keeps the others out. Only ids and lengths are shuffled,
    and only the rows of the sample reach the driver.
    """
    own = (
        labels.where((fold(F.col("doc_id"), folds) != held_out) & F.col(column).isNotNull())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.avg(F.col(column).cast("double")).alias("label"))
    )
    limit = rows * size
    sized = docs.withColumn("bytes", F.octet_length("text")).where(F.col("bytes") <= limit)
    texts = sized.select(F.col("doc_id").alias("id"), "bytes")
    order = [F.xxhash64("id"), F.col("id"), F.col("bytes")]
    known = own.join(texts, "id").withColumn("one", F.col("label") >= 0.5)
    first = known.orderBy(*order).limit(rows).collect()
    for one in (True, False):
        if 0 < len(first) and sum(r["one"] == one for r in first) < min(LEAST, rows):
            seen = {(r["id"], r["bytes"]) for r in first}
            more = known.where(F.col("one") == one).orderBy(*order).limit(LEAST).collect()
            first += [r for r in more if (r["id"], r["bytes"]) not in seen]
    picked = within(first, limit, size // 2)
    if not picked:
        return [], []
    kind = f"id {dict(known.dtypes)['id']}, bytes int, label double"
    chosen = docs.sparkSession.createDataFrame(picked, kind)
    sample = (
        sized.select(F.col("doc_id").alias("id"), "bytes", "text")
        .join(F.broadcast(chosen), ["id", "bytes"])
        .orderBy(*order, "text")
        .limit(rows + 2 * LEAST)
        .collect()
    )
    return [r["text"].encode() for r in sample], [int(r["label"] >= 0.5) for r in sample]


def within(rows: list, limit: int, short: int) -> list[tuple]:
    """(id, bytes, label) of the rows, in their order, that fit into ``limit`` bytes together.

    Rows that repeat an id and a length count once for each.
    """
    repeats = Counter((r["id"], r["bytes"], r["label"]) for r in rows)
    turns: dict[bool, int] = {}
    keyed = []
    for place, key in enumerate(repeats):
        long = key[1] > short
        turn = 0
        if long:
            turn = turns[key[2] >= 0.5] = turns.get(key[2] >= 0.5, 0) + 1
        keyed.append((long, turn, place, key))
    taken, used = [], 0
    for _, _, _, key in sorted(keyed):
        cost = key[1] * repeats[key]
        if used + cost <= limit:
            taken.append(key)
            used += cost
    return taken
