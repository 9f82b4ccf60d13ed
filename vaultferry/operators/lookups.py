"""Joins against a table with one row per key, and row order inside large groups.

Both are written so that one key may hold a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultferry.session import durable

SALTS = 4


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Sequence[Column] = (),
    salts: int = SALTS,
) -> DataFrame:
    """Join facts with a lookup table on equal column names.

    Rows of a hot key go to ``salts`` reducers, picked by the ``spread`` columns, and the
    lookup rows are repeated once per salt. The salted lookup always needs its own
    exchange, so adaptive execution can split what is still too large, or send a lookup
    found to be small at run time to all executors. No size is assumed here. Where a key has
    few facts, as an item or a message key, ``salts=1`` keeps the lookup from being copied.
    Facts without a key cannot match and are spread over all reducers.
    """
    keys = list(on)
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    mix = F.xxhash64(*(spread or [F.col(c) for c in facts.columns]))
    salted = facts.withColumn("_salt", F.when(no_key, mix).otherwise(F.pmod(mix, F.lit(salts))))
    repeated = lookup.withColumn(
        "_salt", F.explode(F.array(*[F.lit(s).cast("bigint") for s in range(salts)]))
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def rows_with_keys(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a large table whose key occurs in ``keys``.

    Used on history tables before they are joined with a batch: a batch that the optimizer
    finds small is sent to the table's scan, so the table itself is not shuffled.
    """
    return table.join(keys.select(*on), list(on), "left_semi")


def _slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Sort the frame and return it with its slices: the part of a group in one partition.

    A range sort on key and order cuts a large group over many partitions. The row id
    grows with the sort order and carries the partition in its upper bits. The sorted rows
    are checkpointed, so a lost executor cannot change ids between the two readers.
    """
    placed = df.orderBy(*keys, *order).withColumn("_row", F.monotonically_increasing_id())
    placed = durable(placed).withColumn("_slice", F.shiftright("_row", 33))
    last = F.lit(None) if value is None else F.max_by(F.struct(value.alias("v")), "_row")
    slices = placed.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), last.alias("_last")
    )
    return placed, slices


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos"
) -> DataFrame:
    """Add the zero-based position of each row in its group.

    ``order`` must order the rows of a group without ties that matter.
    """
    placed, slices = _slices(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = (
        slices.withColumn("_earlier", F.sum("_rows").over(before))
        .where(F.col("_earlier").isNotNull())
        .select(*keys, "_slice", "_earlier")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("_row")
    numbered = placed.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = numbered.join(earlier, [*keys, "_slice"], "left")
    position = F.col("_inside") + F.coalesce("_earlier", F.lit(0))
    return joined.withColumn(name, position.cast("bigint")).select(*df.columns, name)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add the value of the preceding row of the group, null for the first row."""
    placed, slices = _slices(df, keys, order, F.col(value))
    across = Window.partitionBy(*keys).orderBy("_slice")
    handed_on = (
        slices.withColumn("_before", F.lag("_last").over(across))
        .where(F.col("_before").isNotNull())
        .select(*keys, "_slice", "_before")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("_row")
    local = placed.withColumn("_own", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    joined = local.join(handed_on, [*keys, "_slice"], "left")
    previous = F.coalesce("_own", "_before")["v"]
    return joined.withColumn(name, previous).select(*df.columns, name)
