"""What was delivered before, what the target accepts, and how receipts are applied."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.functions.hashing import packed_hash, unpacked_hash
from vaultferry.functions.keys import target_id
from vaultferry.operators.lookups import lookup_join
from vaultferry.schemas import DELIVERED


def delivered_keys(records: DataFrame) -> DataFrame:
    return records.where(F.col("status").isin(*DELIVERED)).select("idempotency_key").distinct()


def flag_delivered(items: DataFrame, records: DataFrame) -> DataFrame:
    """Add already_delivered: the key has a record that ended well."""
    done = delivered_keys(records).withColumn("_done", F.lit(True))
    joined = lookup_join(items, done, ["idempotency_key"], "left", [F.col("item_id")], salts=1)
    return joined.withColumn("already_delivered", F.col("_done").isNotNull()).drop("_done")


def skip_migrated(items: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items still to do, items already delivered)."""
    flagged = flag_delivered(items, records)
    return (
        flagged.where(~F.col("already_delivered")).drop("already_delivered"),
        flagged.where("already_delivered").drop("already_delivered"),
    )


@dataclass(frozen=True)
class Ingested:
    """Result of one accepted batch."""

    receipts: DataFrame
    new_records: DataFrame
    new_parts: DataFrame
    part_rollup: DataFrame


def new_parts_per_message(first_uses: DataFrame) -> DataFrame:
    return first_uses.groupBy("idempotency_key", "seq").agg(F.count(F.lit(1)).alias("n_new"))


def has_known_part() -> Column:
    """Some part of the message arrived earlier: fewer new parts than parts."""
    return F.col("n_parts") > F.coalesce("n_new", F.lit(0))


def judged_messages(parts: DataFrame, first_uses: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted messages with part count, bytes, and whether any part was known already.

    These are null for a message without parts. All joins are by message, so each side is
    shuffled once.
    """
    message = ["idempotency_key", "seq"]
    totals = parts.groupBy(*message).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("size_bytes").alias("bytes")
    )
    fresh = new_parts_per_message(first_uses)
    return (
        accepted.join(totals, message, "left")
        .join(fresh, message, "left")
        .select(*accepted.columns, "n_parts", "bytes", has_known_part().alias("deduped"))
    )


def part_rollup(judged: DataFrame) -> DataFrame:
    """Per accepted message that has parts: part count, bytes, whether any was known already."""
    rows = judged.where(F.col("n_parts").isNotNull())
    return rows.select("idempotency_key", "seq", "n_parts", "bytes", "deduped")


def first_part_uses(parts: DataFrame) -> DataFrame:
    """The first arrival of every hash.

    The minimum by (seq, pos) combines before the shuffle, so a hash shared by a large
    share of all parts costs one row per task.
    """
    arrival = F.struct("seq", "pos", "idempotency_key", "part_id", "size_bytes")
    firsts = parts.groupBy("sha256").agg(F.min(arrival).alias("_first"))
    return firsts.select("sha256", "_first.*")


def not_stored(firsts: DataFrame, part_store: DataFrame | None) -> DataFrame:
    """Arrivals of the hashes that the store does not hold yet."""
    if part_store is None:
        return firsts
    return firsts.join(part_store.select("sha256"), "sha256", "left_anti")


def ingest_batch(
    messages: DataFrame,
    parts: DataFrame,
    registry: DataFrame | None = None,
    part_store: DataFrame | None = None,
    keep: Callable[[str, DataFrame], DataFrame] = lambda _, rows: rows,
) -> Ingested:
    """Accept a batch by the target's rules, in ``seq`` order.

    ``messages``: idempotency_key, seq, target_archive and, if it is known, n_parts.
    ``parts``: idempotency_key, seq, pos, part_id, sha256, size_bytes. A known key returns its
    stored result and its parts are not recorded; among equal keys in the batch the lowest
    ``seq`` is accepted.
    ``keep(table, rows)`` may write the rows of a step (winners, part_store, judged) and
    return them as read back, so that later steps need not compute them again.
    """
    counted = "n_parts" in messages.columns
    facts = ["target_archive", "n_parts"] if counted else ["target_archive"]
    winners = messages.groupBy("idempotency_key").agg(
        F.min(F.struct("seq", *facts)).alias("_w")
    )
    winners = winners.select("idempotency_key", "_w.*")
    if registry is not None:
        held = registry.select(
            "idempotency_key",
            F.col("target_id").alias("held_target_id"),
            F.col("deduped").alias("held_deduped"),
        )
        winners = winners.join(held, "idempotency_key", "left")
    else:
        winners = winners.withColumns(
            {
                "held_target_id": F.lit(None).cast("string"),
                "held_deduped": F.lit(None).cast("boolean"),
            }
        )
    winners = keep("winners", winners)
    unheld = winners.where(F.col("held_target_id").isNull()).drop("held_target_id", "held_deduped")
    accepted = unheld.select("idempotency_key", "seq")
    # The parts travel with their hash as bytes; a part without a key matches nothing and stays.
    packed = parts.withColumn("sha256", packed_hash(F.col("sha256")))
    accepted_parts = packed.join(accepted, ["idempotency_key", "seq"], "left_semi")
    firsts = first_part_uses(accepted_parts).withColumn("sha256", unpacked_hash(F.col("sha256")))
    uses = keep("part_store", not_stored(firsts, part_store))
    if counted:
        rollup = part_rollup(judged_messages(parts, uses, accepted))
        judged = unheld.join(new_parts_per_message(uses), ["idempotency_key", "seq"], "left")
        judged = keep("judged", judged.withColumn("deduped", has_known_part()))
    else:
        judged = keep("judged", judged_messages(parts, uses, unheld))
        rollup = part_rollup(judged)
    new_records = judged.select(
        "idempotency_key",
        target_id(F.col("idempotency_key")).alias("target_id"),
        "target_archive",
        F.coalesce("deduped", F.lit(False)).alias("deduped"),
        F.col("seq").alias("first_seq"),
    )
    held = winners.where(F.col("held_target_id").isNotNull()).select(
        "idempotency_key",
        F.col("held_target_id").alias("target_id"),
        F.coalesce("held_deduped", F.lit(False)).alias("deduped"),
        F.lit(True).alias("_known"),
        F.col("seq").alias("first_seq"),
    )
    # The new ids follow from the keys, so they need not travel.
    fresh = new_records.select(
        "idempotency_key",
        F.lit(None).cast("string").alias("target_id"),
        "deduped",
        F.lit(False).alias("_known"),
        "first_seq",
    )
    answered = messages.select("idempotency_key", "seq").join(
        held.unionByName(fresh), "idempotency_key"
    )
    new_id = F.when(~F.col("_known"), target_id(F.col("idempotency_key")))
    answered = answered.withColumn("target_id", F.coalesce(new_id, "target_id"))
    receipts = answered.select(
        "idempotency_key",
        "seq",
        F.lit(200).alias("http_status"),
        "target_id",
        "deduped",
        (F.col("_known") | (F.col("seq") > F.col("first_seq"))).alias("already_present"),
    )
    return Ingested(receipts, new_records, uses, rollup)


def apply_receipts(items: DataFrame, results: DataFrame) -> DataFrame:
    """Join items with the classified final receipt of their key.

    Items without a receipt keep a null ingest_status: they still await delivery.
    """
    final = results.select("idempotency_key", "ingest_status", "target_id", "error_code")
    final = final.withColumnRenamed("error_code", "delivery_error")
    return lookup_join(items, final, ["idempotency_key"], "left", [F.col("item_id")], salts=1)
