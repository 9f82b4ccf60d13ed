"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Slots per shard: shares differ from each other by less than one part in this number.
SLOTS_PER_SHARD = 128
# Rows of the lookup table that may be sent to every executor (12 bytes each).
BROADCAST_SLOTS = 1_000_000


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def table_size(shards: int) -> int:
    """Smallest prime with at least ``SLOTS_PER_SHARD`` slots for each shard."""
    size = max(2, shards * SLOTS_PER_SHARD)
    while not _is_prime(size):
        size += 1
    return size


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: Sequence[str], size: int) -> np.ndarray:
    """Owner (index into ``names``) of every slot.

    Each shard prefers the slots ``offset, offset + skip, ...`` modulo the prime size, a
    permutation of all slots. The shards take turns; each claims its first free choice.
    When a shard comes or goes, few slots of the others change their owner.
    """
    if not names or len(set(names)) != len(names) or not _is_prime(size) or size < len(names):
        raise ValueError("needs distinct shard names and a prime table size of at least as many")
    owner = np.full(size, -1, np.int64)
    place = [_number(f"offset:{n}") % size for n in names]
    skip = [_number(f"skip:{n}") % (size - 1) + 1 for n in names]
    free = size
    while True:
        for shard in range(len(names)):
            at = place[shard]
            while owner[at] >= 0:
                at = (at + skip[shard]) % size
            owner[at] = shard
            place[shard] = (at + skip[shard]) % size
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, size: int) -> Column:
    """Slot of a text key: its digest modulo the table size. Null counts as empty."""
    digest = F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(size).cast("bigint"))


def _slots(spark: SparkSession, names: Sequence[str], size: int) -> DataFrame:
    owner = lookup_table(names, size)
    if size > BROADCAST_SLOTS:
        raise ValueError(f"the lookup table is broadcast and may have {BROADCAST_SLOTS} slots")
    rows = [(slot, int(shard)) for slot, shard in enumerate(owner)]
    return spark.createDataFrame(rows, "llm_slot bigint, llm_shard int")


def placed(
    docs: DataFrame, names: Sequence[str], size: int | None = None, column: str = "shard"
) -> DataFrame:
    """Rows of ``docs`` with the index of their shard in ``column``; a column of that name is
    replaced. Nothing is shuffled: the table has a fixed size and is broadcast.

    The key is ``doc_id``; rows without one are placed by their text, so they spread. Equal
    keys get equal shards. An empty table gives no rows.
    """
    size = size or table_size(len(names))
    key = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text:"), docs["text"]))
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    rows = docs.select(
        F.struct(*[docs[c] for c in kept]).alias("row"), slot_of(key, size).alias("llm_slot")
    )
    slots = F.broadcast(_slots(docs.sparkSession, names, size))
    return rows.join(slots, "llm_slot").select(
        *[F.col("row")[c].alias(c) for c in kept], F.col("llm_shard").alias(column)
    )


def write_shards(docs: DataFrame, path: str, names: Sequence[str], files: int = 1) -> None:
    """Write one folder per shard, each of ``files`` files, so that no task holds a shard whole."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
    rows = placed(docs, names).repartition(len(names) * files, "shard", part)
    rows.write.partitionBy("shard").parquet(path)
