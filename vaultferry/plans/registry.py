"""Named queries over the star-schema tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultferry import fixtures as fx
from vaultferry import schemas
from vaultferry.functions import keys, messages
from vaultferry.functions.hashing import content_hash, normalize_hash
from vaultferry.functions.payload import payload_long
from vaultferry.operators import audit as au
from vaultferry.operators import delivery, identity, ingest, policy, quality, reconcile
from vaultferry.operators import rehydrate as rh
from vaultferry.operators import report, search_index, state
from vaultferry.operators.digest_tree import digest_tree, reconcile_by_digest
from vaultferry.operators.transform import build_messages, transform_error
from vaultferry.options import MIGRATE, RETAIN, MigrationFilters
from vaultferry.plans import migration as mg
from vaultferry.plans import retries
from vaultferry.session import durable, prepare_session, scratch_path, stored
from vaultferry.sinks import writers
from vaultferry.sinks.outbox_sink import register_outbox
from vaultferry.sources import readers
from vaultferry.sources.identity_file import register_identity_map
from vaultferry.sources.part_files import register_part_files
from vaultferry.streaming import answers, jobs, tracker, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FILTERS = MigrationFilters(
    from_utc=datetime(1994, 1, 1),
    to_utc=datetime(2000, 1, 1),
    folder_path="inbox",
    retention_category="LEGAL-7y",
)
NO_FILTERS = MigrationFilters()


def query(fn: Query) -> Query:
    """Register a query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare_session(spark), sf_dir.rstrip("/"))

    QUERIES[fn.__name__] = run
    return fn


def text_time(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def timed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: text_time(c) for c in columns})


# Sources


@query
def read_archives(spark: SparkSession, d: str) -> DataFrame:
    """Archives written to and read back from parquet with the fixed schema."""
    path = scratch_path(spark, "archives")
    fx.archives(spark, d).write.parquet(path)
    return readers.read_archives(spark, path)


@query
def read_items(spark: SparkSession, d: str) -> DataFrame:
    """Items whose lists are stored as JSON text, written as JSON lines and read back."""
    path = scratch_path(spark, "items")
    stored = fx.items(spark, d).withColumn(
        "content_part_ids", F.array(F.concat(F.lit("body-"), "item_id"))
    )
    stored = stored.withColumns(
        {c: readers.to_json_list(F.col(c)) for c in readers.LIST_COLUMNS}
    ).withColumn("bcc", F.when(F.col("bcc") == "[]", F.lit("null")).otherwise(F.col("bcc")))
    stored.write.json(path)
    items = readers.read_items(spark, path, "json", json_lists=True)
    return items.select(
        "item_id",
        "archive_id",
        text_time("sent_date_utc").alias("sent"),
        F.size("to").cast("bigint").alias("n_to"),
        F.size("cc").cast("bigint").alias("n_cc"),
        F.size("bcc").cast("bigint").alias("n_bcc"),
        F.array_join("content_part_ids", "|").alias("part_ids"),
        "size_bytes",
    )


@query
def read_parts(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "parts")
    fx.parts(spark, d).write.orc(path)
    return readers.read_parts(spark, path, "orc")


@query
def read_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Receipts written as a table, read back and classified."""
    path = scratch_path(spark, "receipts")
    receipts = fx.attempts(spark, d).withColumns(
        {"attempt_no": F.lit(1), "deduped": F.lit(None).cast("boolean")}
    )
    receipts.select(*schemas.RECEIPTS.names).write.parquet(path)
    classified = delivery.classify_receipts(readers.read_receipts(spark, path))
    return classified.groupBy("ingest_status").agg(
        F.count(F.lit(1)).alias("receipts"), F.count_distinct("idempotency_key").alias("keys")
    )


@query
def order_items(spark: SparkSession, d: str) -> DataFrame:
    items = fx.items(spark, d).select("archive_id", "item_id", "size_bytes")
    return items.orderBy("archive_id", "item_id")


@query
def blob_hashes(spark: SparkSession, d: str) -> DataFrame:
    return readers.blob_hashes(fx.blobs(spark, d))


@query
def identity_entries(spark: SparkSession, d: str) -> DataFrame:
    """Identity-map documents, one per vault's first letter group; the last entry wins."""
    entry = F.struct(
        F.col("c_name").alias("upn"), fx.tagged("tgt-", "c_custkey").alias("targetArchiveId")
    )
    again = F.struct(
        F.upper("c_name").alias("upn"), fx.tagged("new-", "c_custkey").alias("targetArchiveId")
    )
    customer = fx.table(spark, d, "customer")
    documents = customer.select(F.array(entry, again).alias("mappings"))
    entries = readers.identity_entries(documents)
    return identity.unique_map(entries, "pos")


@query
def recipient_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists stored as JSON text, parsed, joined and written back as text."""
    items = fx.items(spark, d)
    stored = items.select(
        "item_id", *[readers.to_json_list(F.col(c)).alias(c) for c in ("to", "cc", "bcc")]
    )
    parsed = readers.parse_json_lists(stored, ("to", "cc", "bcc"))
    return parsed.select(
        "item_id",
        *[messages.join_recipients(F.col(c)).alias(f"{c}_line") for c in ("to", "cc", "bcc")],
        readers.to_json_list(F.col("cc")).alias("cc_json"),
    )


# Policy


def _archive_items(spark: SparkSession, d: str) -> DataFrame:
    """Items joined with all archives, whatever their route."""
    archives = fx.archives(spark, d).withColumns(
        {"route": F.lit("routed"), "target_archive": F.lit(None).cast("string")}
    )
    return mg.scan_items(fx.items(spark, d), archives)


def _outcomes(spark: SparkSession, d: str, filters: MigrationFilters, hold: str) -> DataFrame:
    decided = policy.with_decision(_archive_items(spark, d), filters, hold)
    return decided.groupBy("type", "outcome", "reason").agg(F.count(F.lit(1)).alias("items"))


@query
def policy_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d, NO_FILTERS, RETAIN)


@query
def policy_outcomes_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d, FILTERS, RETAIN)


@query
def policy_outcomes_hold_migrate(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d, NO_FILTERS, MIGRATE)


@query
def policy_extra_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [("Item is too large.", F.col("size_bytes") > 300000)]
    decided = policy.with_decision(_archive_items(spark, d), NO_FILTERS, RETAIN, rules)
    return decided.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("items"))


@query
def items_in_scope(spark: SparkSession, d: str) -> DataFrame:
    kept = policy.in_scope(fx.items(spark, d), FILTERS)
    return kept.select("item_id", "folder_path", text_time("sent_date_utc").alias("sent"))


@query
def archive_scope(spark: SparkSession, d: str) -> DataFrame:
    """One archive chosen at archive level and, as a skip reason, at item level."""
    chosen = MigrationFilters(archive_id="arc-7")
    routes = identity.route_archives(
        fx.archives(spark, d), fx.identity_map(spark, d), fx.options(filters=chosen)
    )
    decided = policy.with_decision(_archive_items(spark, d), chosen)
    at_item = decided.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    at_archive = routes.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    return at_item.select(F.concat(F.lit("item:"), "outcome").alias("scope"), "n").unionByName(
        at_archive.select(F.concat(F.lit("archive:"), "route").alias("scope"), "n")
    )


@query
def routed_item_counts(spark: SparkSession, d: str) -> DataFrame:
    go, skipped = policy.route_items(policy.with_decision(_archive_items(spark, d), FILTERS))
    return go.agg(
        F.lit("go").alias("branch"), F.count(F.lit(1)).alias("items"), F.sum("size_bytes").alias("bytes")
    ).unionByName(
        skipped.agg(
            F.lit("skipped").alias("branch"),
            F.count(F.lit(1)).alias("items"),
            F.sum("size_bytes").alias("bytes"),
        )
    )


# Identity


@query
def archive_routing(spark: SparkSession, d: str) -> DataFrame:
    routes = identity.route_archives(
        fx.archives(spark, d), fx.identity_map(spark, d), fx.options()
    )
    return routes.select("archive_id", "type", "target_archive", "orphan_reason", "route")


@query
def orphan_archives(spark: SparkSession, d: str) -> DataFrame:
    resolved = identity.resolve_targets(fx.archives(spark, d), fx.identity_map(spark, d))
    return resolved.where(F.col("orphan_reason").isNotNull()).select(
        "archive_id", "owner_upn", "orphan_reason"
    )


@query
def held_archives(spark: SparkSession, d: str) -> DataFrame:
    return policy.retain_legal_hold(fx.archives(spark, d)).select("archive_id", "vault_store")


@query
def identity_map_stats(spark: SparkSession, d: str) -> DataFrame:
    return identity.identity_map_stats(fx.archives(spark, d), fx.identity_map(spark, d))


@query
def orphaned_owners(spark: SparkSession, d: str) -> DataFrame:
    return identity.orphaned_owners(fx.archives(spark, d), fx.identity_map(spark, d))


# Keys and hashes


@query
def idempotency_keys(spark: SparkSession, d: str) -> DataFrame:
    joined = _archive_items(spark, d)
    key = keys.idempotency_key(F.col("vault_store"), F.col("archive_id"), F.col("item_id"))
    return joined.select(
        "item_id", key.alias("idempotency_key"), keys.target_id(key).alias("target_id")
    )


def _foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    own = fx.table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 10 == 0, fx.tagged("ev:only-two-", "o_orderkey"))
        .when(
            F.col("o_orderkey") % 10 == 1,
            F.concat(F.lit("ev:VS:arc:itm:"), F.col("o_orderpriority"), F.lit(":x")),
        )
        .when(F.col("o_orderkey") % 10 == 2, F.lit("   "))
        .otherwise(
            F.concat(
                F.lit("ev:VS:"), fx.tagged("arc-", "o_custkey"), fx.tagged(":itm-", "o_orderkey")
            )
        )
        .alias("key_text")
    )
    urls = fx.table(spark, d, "pages").select(F.col("url").alias("key_text"))
    sources = fx.table(spark, d, "documents").select(F.col("source").alias("key_text"))
    return own.unionByName(urls).unionByName(sources)


@query
def parse_keys(spark: SparkSession, d: str) -> DataFrame:
    good, _ = keys.parse_keys(_foreign_keys(spark, d), "key_text")
    return good


@query
def invalid_keys(spark: SparkSession, d: str) -> DataFrame:
    _, bad = keys.parse_keys(_foreign_keys(spark, d), "key_text")
    return bad.groupBy("key_text").agg(F.count(F.lit(1)).alias("n"))


@query
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", content_hash(F.col("text")).alias("sha256"))


@query
def hash_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents")
    return (
        docs.groupBy(content_hash(F.col("text")).alias("sha256"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
        .where("copies > 1")
    )


@query
def normalized_hashes(spark: SparkSession, d: str) -> DataFrame:
    digest = content_hash(F.col("text"))
    given = (
        F.when(F.col("doc_id") % 4 == 0, F.upper(digest))
        .when(F.col("doc_id") % 4 == 1, F.substring(digest, 1, 63))
        .when(F.col("doc_id") % 4 == 2, F.repeat(F.lit(" "), F.lit(64)))
        .otherwise(digest)
    )
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", normalize_hash(given).alias("sha256"))


@query
def short_run_ids(spark: SparkSession, d: str) -> DataFrame:
    runs = report.run_list(fx.audit(spark, d))
    long_id = F.concat(F.col("run_id"), F.lit("-0000-0000"))
    return runs.select(keys.short_run_id(long_id).alias("short_id"), "status")


@query
def snake_case_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("OrderKey"),
        F.col("l_linenumber").alias("lineNUMBERValue"),
        F.col("l_returnflag").alias("UTCFlag"),
    )
    return keys.snake_case_columns(lines)


# Content parts


@query
def part_verification(spark: SparkSession, d: str) -> DataFrame:
    verified = rh.verify_parts(fx.parts(spark, d), readers.blob_hashes(fx.blobs(spark, d)))
    return verified.select("part_id", "sha256", "size_bytes", "error")


def _rehydrated(spark: SparkSession, d: str) -> DataFrame:
    return rh.rehydrate(
        fx.items(spark, d).select("item_id"),
        fx.part_refs_in_order(spark, d),
        fx.parts(spark, d),
        readers.blob_hashes(fx.blobs(spark, d)),
    )


@query
def rehydrated_items(spark: SparkSession, d: str) -> DataFrame:
    return _rehydrated(spark, d).select("item_id", "n_parts", "bytes", "error_code")


@query
def rehydration_error_parts(spark: SparkSession, d: str) -> DataFrame:
    """Items with a bad part: where it is in the list, which one, and its hashes."""
    verified = rh.verify_parts(fx.parts(spark, d), readers.blob_hashes(fx.blobs(spark, d)))
    checked = rh.check_refs(fx.part_refs(spark, d), verified)
    failed = rh.item_content(checked).where(F.col("error_code").isNotNull())
    return rh.with_error_detail(failed, checked).select(
        "item_id", "error_code", "error_pos", "error_part", "error_stored_sha256", "error_sha256"
    )


@query
def rehydration_errors(spark: SparkSession, d: str) -> DataFrame:
    status = F.coalesce("error_code", F.lit("OK"))
    return (
        _rehydrated(spark, d)
        .groupBy(status.alias("status"))
        .agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("n_parts") == 0).alias("empty"))
    )


@query
def checked_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every part reference with its position, verified part and error."""
    verified = rh.verify_parts(fx.parts(spark, d), readers.blob_hashes(fx.blobs(spark, d)))
    return rh.check_refs(fx.part_refs(spark, d), verified).select(
        "item_id", "pos", "part_id", "sha256", "size_bytes", "error"
    )


@query
def distinct_part_ids(spark: SparkSession, d: str) -> DataFrame:
    return rh.distinct_part_ids(fx.part_refs_in_order(spark, d))


def _list_text(parts: str) -> Column:
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.concat(p["partId"], F.lit("="), F.coalesce(p["sha256"], F.lit("?"))),
        ),
        ";",
    )


@query
def item_part_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ordered part list of every item, from positions that only grow."""
    verified = rh.verify_parts(fx.parts(spark, d), readers.blob_hashes(fx.blobs(spark, d)))
    lists = rh.assemble_parts(rh.check_refs(fx.part_refs_in_order(spark, d), verified))
    return lists.select("item_id", _list_text("parts").alias("part_list"))


@query
def conversation_assembly(spark: SparkSession, d: str) -> DataFrame:
    lists = rh.assemble_parts(fx.conversation_parts(spark, d))
    return lists.select(
        "item_id",
        F.size("parts").cast("bigint").alias("n_parts"),
        _list_text("parts").alias("part_list"),
    )


# Messages


@query
def archive_class(spark: SparkSession, d: str) -> DataFrame:
    return fx.archives(spark, d).select(
        "archive_id",
        messages.archive_class(F.col("type")).alias("archive_class"),
        messages.type_target(F.col("type"), F.col("archive_id")).alias("type_target"),
    )


def _map_text(c: str) -> Column:
    entries = F.array_sort(F.map_entries(c))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|"
    )


def _messages(spark: SparkSession, d: str) -> DataFrame:
    routed = identity.resolve_targets(fx.archives(spark, d), fx.identity_map(spark, d))
    routed = routed.withColumn(
        "route", F.when(F.col("orphan_reason").isNull(), "routed").otherwise("orphan")
    )
    items = mg.scan_items(fx.items(spark, d), routed).withColumn("n_parts", F.lit(0))
    return build_messages(items.where(transform_error().isNull()), None, fx.options())


@query
def item_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select(
        F.col("source.itemId").alias("item_id"), _map_text("metadata").alias("metadata")
    )


@query
def retention_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Expiry of several categories per item, from leap days to years out of range."""
    leap = F.when(F.col("o_orderkey") % 4 == 0, F.lit("2024-02-29 10:11:12.123456").cast("timestamp"))
    sent = F.coalesce(leap, F.col("o_orderdate"))
    category = (
        F.when(F.col("o_orderkey") % 5 == 0, "Legal-7Y")
        .when(F.col("o_orderkey") % 5 == 1, "short1y")
        .when(F.col("o_orderkey") % 5 == 2, "NoExpiry")
        .when(F.col("o_orderkey") % 5 == 3, "Keep-9000Y")
        .otherwise("Huge-99999999999Y")
    )
    return fx.table(spark, d, "orders").select(
        "o_orderkey",
        messages.retention_years(category).cast("bigint").alias("years"),
        text_time(messages.retention_expiry(category, sent)).alias("expires"),
        messages.expiry_in_range(category, sent).alias("in_range"),
        messages.iso_timestamp(sent).alias("sent_iso"),
    )


@query
def messages_flat(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select(
        F.col("idempotencyKey").alias("idempotency_key"),
        F.col("targetArchive").alias("target_archive"),
        F.col("archiveClass").alias("archive_class"),
        F.col("source.vaultStore").alias("vault_store"),
        F.col("retention.category").alias("category"),
        text_time("retention.expiresUtc").alias("expires"),
        F.col("legalHold").alias("legal_hold"),
        text_time("chainOfCustody.extractedAtUtc").alias("extracted"),
        F.col("chainOfCustody.runId").alias("run_id"),
        F.col("chainOfCustody.toolVersion").alias("tool_version"),
    )


# Delivered before


@query
def already_migrated(spark: SparkSession, d: str) -> DataFrame:
    _, done = ingest.skip_migrated(fx.keyed_items(spark, d), fx.delivered_records(spark, d))
    return done.select("item_id", "idempotency_key")


@query
def pending_items(spark: SparkSession, d: str) -> DataFrame:
    todo, _ = ingest.skip_migrated(fx.keyed_items(spark, d), fx.delivered_records(spark, d))
    return todo.select("item_id", "idempotency_key")


# Target


def _documents_in(spark: SparkSession, d: str) -> ingest.Ingested:
    return ingest.ingest_batch(*fx.document_messages(spark, d))


def _replay(spark: SparkSession, d: str) -> ingest.Ingested:
    """Item messages of which each fifth is known and each key of a third comes twice.

    Every fortieth part's hash is in the target's store already.
    """
    orders = fx.table(spark, d, "orders")
    key = fx.tagged("ev:VS-1:itm-", "o_orderkey")
    once = orders.select(
        key.alias("idempotency_key"),
        F.col("o_orderkey").alias("seq"),
        fx.tagged("tgt-", "o_custkey").alias("target_archive"),
    )
    again = once.where(F.col("seq") % 3 == 0).withColumn("seq", F.col("seq") + 1000000000000)
    batch = once.unionByName(again)
    lines = fx.table(spark, d, "lineitem").select(
        fx.tagged("ev:VS-1:itm-", "l_orderkey").alias("idempotency_key"),
        F.col("l_orderkey").alias("seq"),
        F.struct(*fx.PART_ORDER).alias("pos"),
        fx.tagged("prt-", "l_partkey").alias("part_id"),
        content_hash(fx.tagged("part ", F.floor(F.col("l_partkey") / 4))).alias("sha256"),
        F.col("l_quantity").cast("bigint").alias("size_bytes"),
    )
    lines_again = lines.where(F.col("seq") % 3 == 0).withColumn(
        "seq", F.col("seq") + 1000000000000
    )
    store = (
        fx.table(spark, d, "part")
        .select(
            F.when(
                F.col("p_partkey") % 40 == 0,
                content_hash(fx.tagged("part ", F.floor(F.col("p_partkey") / 4))),
            )
            .otherwise(content_hash(fx.tagged("other ", "p_partkey")))
            .alias("sha256")
        )
    )
    return ingest.ingest_batch(
        batch,
        lines.unionByName(lines_again),
        fx.registry(spark, d),
        store,
        lambda table, rows: stored(rows, table),
    )


@query
def ingest_receipts(spark: SparkSession, d: str) -> DataFrame:
    return _documents_in(spark, d).receipts.select(
        "idempotency_key", "target_id", "deduped", "already_present"
    )


@query
def ingest_replay(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d).receipts.select(
        "idempotency_key", "seq", "target_id", "deduped", "already_present"
    )


@query
def item_part_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d).part_rollup.select(
        "idempotency_key", "n_parts", F.col("bytes").cast("bigint").alias("bytes"), "deduped"
    )


@query
def part_store_after(spark: SparkSession, d: str) -> DataFrame:
    return _documents_in(spark, d).new_parts.select("sha256", "part_id", "size_bytes")


@query
def replay_new_parts(spark: SparkSession, d: str) -> DataFrame:
    """New parts of the replayed batch: the first arrival of every hash."""
    return _replay(spark, d).new_parts.select("sha256", "part_id", "size_bytes")


@query
def target_stats(spark: SparkSession, d: str) -> DataFrame:
    result = _documents_in(spark, d)
    return reconcile.target_stats(
        result.new_records, result.new_parts, fx.attempts(spark, d)
    )


@query
def ingested_by_target(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.ingested_by_target(_documents_in(spark, d).new_records)


# Receipts


@query
def classify_receipts(spark: SparkSession, d: str) -> DataFrame:
    classified = delivery.classify_receipts(fx.attempts(spark, d))
    return classified.groupBy("http_status", "exception", "ingest_status", "error_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("target_id").alias("with_target"),
        F.count("retry_after").alias("with_delay"),
    )


@query
def attempt_rollup(spark: SparkSession, d: str) -> DataFrame:
    rolled = delivery.attempt_rollup(fx.attempts(spark, d), ["attempt_order"])
    return rolled.select(
        "idempotency_key",
        "attempts",
        "ingest_status",
        "error_code",
        "target_id",
        "retryable",
        "exhausted",
    )


@query
def retry_queue(spark: SparkSession, d: str) -> DataFrame:
    rolled = delivery.attempt_rollup(fx.attempts(spark, d), ["attempt_order"])
    return delivery.retry_queue(rolled).select(
        "idempotency_key",
        "attempts",
        F.round("delay_seconds", 3).alias("delay_seconds"),
        text_time("due_at_utc").alias("due_at"),
    )


def _ratio_columns(ratio: DataFrame) -> DataFrame:
    return ratio.select(
        text_time("window_start").alias("window_start"),
        "deliveries",
        "failures",
        F.round("failure_ratio", 6).alias("failure_ratio"),
        "tripped",
    )


@query
def failure_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _ratio_columns(delivery.failure_ratio(fx.attempts(spark, d)))


@query
def sliding_failure_share(spark: SparkSession, d: str) -> DataFrame:
    share = delivery.sliding_failure_share(fx.attempts(spark, d), seconds=3600, least=2)
    return share.select(
        text_time("at_utc").alias("at_utc"),
        "deliveries",
        "failures",
        F.round("failure_share", 6).alias("failure_share"),
        "tripped",
    )


@query
def apply_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as items, matched with the final receipt of their key."""
    items = fx.table(spark, d, "documents").select(
        fx.tagged("itm-", "doc_id").alias("item_id"),
        fx.tagged("key-", F.col("doc_id") * 3 % 5000).alias("idempotency_key"),
    )
    rolled = delivery.attempt_rollup(fx.attempts(spark, d), ["attempt_order"])
    applied = mg.with_results(
        items.withColumn("event_type", F.lit(mg.DELIVER)), rolled
    )
    return applied.select("item_id", "event_type", "target_id", "delivery_error")


# State


@query
def merge_records(spark: SparkSession, d: str) -> DataFrame:
    folded = state.fold_records(fx.record_log(spark, d))
    return timed(folded, "extracted_at_utc", "ingested_at_utc", "last_attempt_at_utc").withColumn(
        "attempt_count", F.col("attempt_count").cast("bigint")
    )


@query
def records_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Early records folded and written, then folded again together with the later ones."""
    log = fx.record_log(spark, d)
    early = F.col("last_attempt_at_utc") < F.lit("2024-01-15").cast("timestamp")
    path = scratch_path(spark, "records")
    writers.compact_records(log.where(early), path)
    snapshot = readers.read_records(spark, path)
    later = log.where(~early).select(*schemas.RECORDS.names)
    folded = state.fold_records(snapshot.unionByName(later))
    return timed(folded, "extracted_at_utc", "ingested_at_utc", "last_attempt_at_utc").withColumn(
        "attempt_count", F.col("attempt_count").cast("bigint")
    )


@query
def records_by_status(spark: SparkSession, d: str) -> DataFrame:
    folded = state.fold_records(fx.record_log(spark, d))
    return state.records_by_status(folded, "Failed").select("idempotency_key", "last_error_code")


@query
def count_by_status(spark: SparkSession, d: str) -> DataFrame:
    return state.count_by_status(state.fold_records(fx.record_log(spark, d)))


@query
def find_by_keys(spark: SparkSession, d: str) -> DataFrame:
    wanted = fx.table(spark, d, "documents").select(
        keys.idempotency_key(
            F.lit("VS-1"),
            fx.tagged("arc-", F.expr("doc_id div 40")),
            fx.tagged("itm-", "doc_id"),
        ).alias("idempotency_key")
    )
    folded = state.fold_records(fx.record_log(spark, d))
    return state.find_by_keys(folded, wanted).select("idempotency_key", "status")


@query
def find_by_key(spark: SparkSession, d: str) -> DataFrame:
    folded = state.fold_records(fx.record_log(spark, d))
    found = state.find_by_key(folded, "ev:VS-1:arc-1:itm-47")
    return found.select("idempotency_key", "status", F.col("attempt_count").cast("bigint"))


@query
def save_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return timed(state.fold_checkpoints(fx.checkpoint_log(spark, d)), "created_at_utc")


@query
def latest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return timed(state.latest_checkpoint(fx.checkpoint_log(spark, d)), "created_at_utc")


# Reports


@query
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return report.run_counters(fx.audit(spark, d))


@query
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return timed(report.run_summary(fx.audit(spark, d)), "started_at_utc", "finished_at_utc")


@query
def archive_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.archive_summary(fx.audit(spark, d))


@query
def run_list(spark: SparkSession, d: str) -> DataFrame:
    return timed(report.run_list(fx.audit(spark, d)), "started_at_utc")


@query
def run_detail(spark: SparkSession, d: str) -> DataFrame:
    return timed(report.run_detail(fx.audit(spark, d)), "started_at_utc", "finished_at_utc")


@query
def run_kpis(spark: SparkSession, d: str) -> DataFrame:
    return report.run_kpis(report.run_list(fx.audit(spark, d)))


@query
def resumable_runs(spark: SparkSession, d: str) -> DataFrame:
    return report.resumable_runs(report.run_list(fx.audit(spark, d))).select("run_id", "status")


@query
def filter_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = report.filter_runs(report.run_list(fx.audit(spark, d)), "COMPL")
    return runs.select("run_id", "status")


@query
def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return timed(report.recent_runs(report.run_list(fx.audit(spark, d)), 3), "started_at_utc")


@query
def last_completed_run(spark: SparkSession, d: str) -> DataFrame:
    runs = report.last_completed_run(report.run_list(fx.audit(spark, d)))
    return timed(runs, "started_at_utc")


@query
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    return timed(report.status_changes(fx.audit(spark, d)), "timestamp_utc")


@query
def archive_catalog(spark: SparkSession, d: str) -> DataFrame:
    return report.archive_catalog(fx.archives(spark, d))


# Audit log


@query
def audit_for_run(spark: SparkSession, d: str) -> DataFrame:
    ordered = au.order_audit(au.filter_events(fx.audit(spark, d), "run-2"))
    return timed(ordered, "timestamp_utc")


@query
def audit_by_type(spark: SparkSession, d: str) -> DataFrame:
    chosen = au.filter_events(fx.audit(spark, d), "run-1", ["ItemMigrated", "RunStarted"])
    return chosen.select("id", "event_type", "payload")


@query
def collect_audit(spark: SparkSession, d: str) -> DataFrame:
    return fx.audit(spark, d).groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def audit_search(spark: SparkSession, d: str) -> DataFrame:
    found = au.search_events(fx.audit(spark, d), "ITM-99", "ItemMigrated")
    return found.select("id", "item_id", "event_type")


@query
def audit_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The log written in batches of a run and a month, searched by the pieces of each batch."""
    month = F.date_format("timestamp_utc", "yyyy-MM")
    log = fx.audit(spark, d).withColumn("batch_id", F.concat_ws("_", "run_id", month))
    path = scratch_path(spark, "audit-log")
    log.write.partitionBy("batch_id").parquet(path)
    log = spark.read.schema(log.schema).parquet(path)
    pieces = scratch_path(spark, "audit-pieces")
    search_index.trigram_index(log).write.parquet(pieces)
    found = search_index.indexed_search(log, spark.read.parquet(pieces), "ITM-99", "ItemMigrated")
    return found.select("id", "item_id", "event_type")


@query
def filtered_ratio(spark: SparkSession, d: str) -> DataFrame:
    return au.filtered_ratio(fx.audit(spark, d), "fail")


@query
def error_events(spark: SparkSession, d: str) -> DataFrame:
    return au.error_events(fx.audit(spark, d)).select("id", "event_type", "payload")


@query
def error_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return au.error_breakdown(fx.audit(spark, d))


@query
def event_types(spark: SparkSession, d: str) -> DataFrame:
    return au.event_types(fx.audit(spark, d))


@query
def ingest_histogram(spark: SparkSession, d: str) -> DataFrame:
    return timed(au.ingest_histogram(fx.audit(spark, d)), "minute")


@query
def ingest_histogram_of_day(spark: SparkSession, d: str) -> DataFrame:
    return au.ingest_histogram(fx.audit(spark, d), "minute_of_day")


@query
def cumulative_ingested(spark: SparkSession, d: str) -> DataFrame:
    running = au.cumulative_ingested(au.ingest_histogram(fx.audit(spark, d)))
    return timed(running, "minute")


@query
def progress_marks(spark: SparkSession, d: str) -> DataFrame:
    return timed(report.progress_marks(fx.audit(spark, d), 10), "timestamp_utc")


# Reconciliation and quality


@query
def reconcile_totals(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile_totals(fx.audit(spark, d), fx.table(spark, d, "documents"))


@query
def reconcile_totals_unavailable(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile_totals(fx.audit(spark, d), None)


@query
def reconcile_items(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile_items(fx.local_side(spark, d), fx.target_side(spark, d))


def _with_parts(spark: SparkSession, d: str) -> DataFrame:
    ours, theirs = fx.list_sides(spark, d)
    return reconcile.reconcile_items(
        fx.local_side(spark, d), fx.target_side(spark, d), ours, theirs
    )


@query
def reconcile_parts(spark: SparkSession, d: str) -> DataFrame:
    return _with_parts(spark, d).where(F.contains("detail", F.lit("parts")))


@query
def reconciliation_verdict(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconciliation_verdict(_with_parts(spark, d))


def _broken_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as records that break every kind of rule."""
    lines = fx.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("idempotency_key"),
        F.when(F.col("l_partkey") % 100 != 0, fx.tagged("itm-", "l_orderkey")).alias(
            "source_item_id"
        ),
        F.when(F.col("l_suppkey") % 50 == 0, F.repeat(F.lit("a"), F.lit(201)))
        .otherwise(F.lit("arc"))
        .alias("archive_id"),
        F.lit("tgt").alias("target_archive"),
        F.when(F.col("l_linestatus") == "F", "Migrated").otherwise("Lost").alias("status"),
        F.col("l_shipdate").alias("extracted_at_utc"),
        F.lit(1).alias("attempt_count"),
    )
    return quality.check_constraints(lines, quality.RECORD_RULES)


@query
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    broken = _broken_lines(spark, d)
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query
def constraint_violation_rows(spark: SparkSession, d: str) -> DataFrame:
    return _broken_lines(spark, d)


@query
def illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    found = quality.illegal_transitions(fx.status_history(spark, d), ["at_utc", "event_id"])
    return found.select("key", "event_id", "previous_status", "status")


# Runs


def _inputs_with(spark: SparkSession, d: str, refs: DataFrame) -> mg.MigrationInputs:
    return mg.MigrationInputs(
        archives=fx.archives(spark, d),
        items=fx.items(spark, d),
        identity_map=fx.identity_map(spark, d),
        parts=fx.parts(spark, d),
        blob_hashes=readers.blob_hashes(fx.blobs(spark, d)),
        refs=refs,
    )


def _inputs(spark: SparkSession, d: str) -> mg.MigrationInputs:
    return _inputs_with(spark, d, fx.part_refs_in_order(spark, d))


def _dry_plan(spark: SparkSession, d: str) -> mg.MigrationPlan:
    return mg.plan_migration(spark, _inputs(spark, d), fx.options(dry_run=True), keep=durable)


def _deliver(spark: SparkSession, d: str) -> mg.Deliver:
    """A target whose receipts are in the table of events."""
    return lambda ready: fx.receipts(spark, d)


@query
def dry_run_events(spark: SparkSession, d: str) -> DataFrame:
    plan = _dry_plan(spark, d)
    return plan.audit.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def dry_run_archive_summary(spark: SparkSession, d: str) -> DataFrame:
    plan = _dry_plan(spark, d)
    return report.archive_summary(plan.audit)


@query
def dry_run_error_payloads(spark: SparkSession, d: str) -> DataFrame:
    plan = _dry_plan(spark, d)
    failed = au.error_events(plan.audit)
    return failed.select(
        "item_id",
        F.get_json_object("payload", "$.archiveId").alias("archive_id"),
        F.get_json_object("payload", "$.errorCode").alias("error_code"),
    )


def _summary(summary: DataFrame) -> DataFrame:
    return timed(summary, "started_at_utc", "finished_at_utc")


@query
def migration_run(spark: SparkSession, d: str) -> DataFrame:
    """A full run up to the target's receipts; items without a receipt stay pending."""
    store = scratch_path(spark, "run")
    deliver = _deliver(spark, d)
    return _summary(mg.run_migration(spark, _inputs(spark, d), fx.options(), store, deliver))


@query
def migration_resume(spark: SparkSession, d: str) -> DataFrame:
    """The second run over the same store: what was delivered is found by its key."""
    store = scratch_path(spark, "resume")
    inputs, deliver = _inputs(spark, d), _deliver(spark, d)
    mg.run_migration(spark, inputs, fx.options(), store, deliver)
    second = replace(fx.options(), run_id="run-second")
    return _summary(mg.run_migration(spark, inputs, second, store, deliver))


@query
def resume_same_run(spark: SparkSession, d: str) -> DataFrame:
    """A run, repeated under its id with a narrower filter, then in full.

    Nothing delivered is lost or delivered again: the records say so after each step.
    """
    store = scratch_path(spark, "same-run")
    inputs, deliver = _inputs(spark, d), _deliver(spark, d)
    narrow = replace(fx.options(), filters=MigrationFilters(folder_path="inbox"))
    steps = []
    for n, options in enumerate((fx.options(), narrow, fx.options())):
        summary = mg.run_migration(spark, inputs, options, store, deliver)
        records = mg.records_of(spark, store)
        assert records is not None
        good = state.fold_records(records).where("status = 'Migrated'")
        outcome = ("migrated", "already_present", "skipped", "failed", "total_items")
        step = summary.select(F.lit(n).alias("step"), *outcome)
        steps.append(durable(step.withColumn("delivered", good.agg(F.count("*")).scalar())))
        if n == 0:
            mg.compact_store(spark, store)
    return steps[0].union(steps[1]).union(steps[2])


@query
def run_retry_queue(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a run that are worth another try, as written beside its records."""
    store = scratch_path(spark, "retries")
    execution = mg.start_run(spark, _inputs(spark, d), fx.options(), store)
    mg.migrate_batch(execution, _inputs(spark, d))
    mg.apply_delivery(execution, fx.receipts(spark, d))
    queue = spark.read.parquet(execution.path("retry_queue"))
    return queue.select("idempotency_key", "attempts", text_time("due_at_utc").alias("due_at"))


@query
def own_run_reports(spark: SparkSession, d: str) -> DataFrame:
    """Progress and rate of an own run of thirteen batches: the last checkpoint holds the
    running total, and the delivered items lie at their receipts' minutes."""
    store = scratch_path(spark, "own-run")
    inputs, options = _inputs(spark, d), fx.options()
    execution = mg.start_run(spark, inputs, options, store)
    for n in range(12):
        archive = F.substring_index("archive_id", "-", -1).cast("bigint")
        mine = inputs.items.where(archive % 12 == n)
        mg.migrate_batch(execution, replace(inputs, items=mine), f"part-{n}")
    mg.apply_delivery(execution, fx.receipts(spark, d))
    marks = readers.read_checkpoints(spark, execution.path("checkpoints"), fx.RUN_ID)
    last = state.latest_checkpoint(marks).select(
        F.lit("checkpoint").alias("what"),
        "phase",
        payload_long(F.col("metadata"), "processedCount").alias("n"),
    )
    minutes = au.ingest_histogram(mg.audit_of(execution).drop("batch_id"))
    rate = minutes.select(
        F.lit("rate").alias("what"), text_time("minute").alias("phase"), F.col("ingested").alias("n")
    )
    return last.union(rate)


@query
def outbox_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a run as written to the outbox, read back as text."""
    store = scratch_path(spark, "outbox")
    plan = mg.plan_migration(spark, _inputs(spark, d), fx.options())
    writers.write_outbox(plan.messages(), store, "0")
    fields = (
        "idempotencyKey string, targetArchive string, metadata map<string, string>, "
        "retention struct<expiresUtc: string>, content struct<parts: array<struct<partId: string>>>"
    )
    lines = spark.read.text(store)
    body = lines.withColumn("m", F.from_json("value", fields))
    return body.select(
        F.col("m.idempotencyKey").alias("idempotency_key"),
        "archive_class",
        F.col("m.targetArchive").alias("target_archive"),
        F.col("m.metadata")["cc"].alias("cc"),
        F.col("m.metadata")["sentDateUtc"].alias("sent"),
        F.col("m.retention.expiresUtc").alias("expires"),
        F.size("m.content.parts").cast("bigint").alias("n_parts"),
        F.get("m.content.parts", F.lit(0))["partId"].alias("first_part"),
        F.contains("value", F.lit(":null")).alias("has_null"),
    )


@query
def outbox_long_lists(spark: SparkSession, d: str) -> DataFrame:
    """Items with thousands of parts: one message each, all parts in order."""
    items, checked = fx.long_lists(spark, d)
    store = scratch_path(spark, "outbox-long")
    messages = build_messages(items, rh.assemble_parts(checked), fx.options())
    writers.write_outbox(messages, store, "0")
    fields = "idempotencyKey string, content struct<parts: array<struct<partId: string>>>"
    body = spark.read.text(store).select(F.from_json("value", fields).alias("m"))
    return body.select(
        F.col("m.idempotencyKey").alias("idempotency_key"),
        F.size("m.content.parts").cast("bigint").alias("n_parts"),
        F.sha2(F.array_join("m.content.parts.partId", ","), 256).alias("parts_sha256"),
    )


@query
def audit_csv_export(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "audit-csv")
    writers.export_audit_csv(fx.audit(spark, d), "run-0", path)
    header = "Id string, TimestampUtc string, EventType string, ItemId string, Payload string, RunId string"
    rows = spark.read.schema(header).csv(path, header=True, quote='"', escape='"')
    return keys.snake_case_columns(rows)


@query
def audit_json_export(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "audit-json")
    writers.export_audit_json(fx.audit(spark, d), "run-0", path)
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.id").alias("id"),
        F.get_json_object("value", "$.timestampUtc").alias("timestamp_utc"),
        F.get_json_object("value", "$.eventType").alias("event_type"),
        F.contains("value", F.lit('"itemId"')).alias("has_item"),
        F.get_json_object("value", "$.payload").alias("payload"),
    )


@query
def read_state(spark: SparkSession, d: str) -> DataFrame:
    """Audit events written per run and read back by run and type."""
    path = scratch_path(spark, "audit")
    writers.append_audit(fx.audit(spark, d), path)
    events = readers.read_audit(spark, path, "run-1", ["ItemMigrated", "ItemSkipped"])
    return events.select("id", "run_id", "event_type", "item_id")


@query
def target_registry(spark: SparkSession, d: str) -> DataFrame:
    """Registry written and read back by its reader; the part store does not exist."""
    path = scratch_path(spark, "registry")
    fx.registry(spark, d).write.parquet(path)
    held, parts = readers.read_target_registry(spark, path, path + "-parts")
    assert held is not None and parts is None
    return held


# Streams


@query
def stream_migration(spark: SparkSession, d: str) -> DataFrame:
    """Items and receipts that arrive in several micro-batches."""
    root = scratch_path(spark, "stream-run")
    summary = jobs.stream_migration(
        spark,
        fx.items(spark, d, fx.stream),
        _inputs(spark, d),
        fx.options(),
        f"{root}/store",
        f"{root}/checkpoint",
        fx.receipts(spark, d, fx.stream),
    )
    return _summary(summary)


@query
def stream_restart(spark: SparkSession, d: str) -> DataFrame:
    """A stream that is stopped after the items and started again for the receipts."""
    root = scratch_path(spark, "stream-restart")
    inputs, options = _inputs(spark, d), fx.options()
    arrivals, receipts = fx.items(spark, d, fx.stream), fx.receipts(spark, d, fx.stream)
    at = (f"{root}/store", f"{root}/checkpoint")
    jobs.stream_migration(spark, arrivals, inputs, options, *at)
    return _summary(jobs.stream_migration(spark, arrivals, inputs, options, *at, receipts))


@query
def stream_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Progress rows of a dry streaming run: the newest holds the running total."""
    root = scratch_path(spark, "stream-marks")
    jobs.stream_migration(
        spark,
        fx.items(spark, d, fx.stream),
        _inputs(spark, d),
        fx.options(dry_run=True),
        f"{root}/store",
        f"{root}/checkpoint",
    )
    marks = readers.read_checkpoints(spark, f"{root}/store/checkpoints", fx.RUN_ID)
    return state.latest_checkpoint(marks).select(
        "run_id", "phase", payload_long(F.col("metadata"), "processedCount").alias("processed")
    )


@query
def stream_ingest_rate(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "stream-rate")
    rate = jobs.ingest_rate(fx.item_events(spark, d, fx.stream))
    keys_ = ["run_id", "minute"]
    return timed(jobs.upsert_stream(rate, keys_, f"{root}/rate", f"{root}/checkpoint"), "minute")


@query
def stream_failure_ratio(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "stream-ratio")
    ratio = jobs.failure_ratio_stream(fx.attempts(spark, d, fx.stream))
    newest = jobs.upsert_stream(
        ratio, ["window_start"], f"{root}/ratio", f"{root}/checkpoint"
    )
    return _ratio_columns(newest)


@query
def stream_dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "stream-dedup")
    keyed = fx.attempts(spark, d, fx.stream).select("idempotency_key", "attempt_order")
    firsts = jobs.dedup_keys(
        spark, keyed, ["attempt_order"], f"{root}/keys", f"{root}/checkpoint"
    )
    return firsts.select("idempotency_key", F.col("attempt_order.event_id").alias("event_id"))


@query
def stream_dedup_watermark(spark: SparkSession, d: str) -> DataFrame:
    """First row per key, state dropped a day after: keys here never repeat later than that."""
    root = scratch_path(spark, "stream-watermark")
    keyed = fx.attempts(spark, d, fx.stream).select("idempotency_key", "at_utc")
    firsts = jobs.dedup_within_watermark(keyed, "at_utc", "1 day")
    out = f"{root}/keys"
    jobs.drain(
        firsts,
        lambda batch, n: batch.write.mode("append").parquet(out),
        f"{root}/checkpoint",
    )
    rows = spark.read.schema(firsts.schema).parquet(out)
    return rows.groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("rows"))


@query
def status_tracker(spark: SparkSession, d: str) -> DataFrame:
    """Status, changes and illegal moves per key of a status stream."""
    root = scratch_path(spark, "stream-status")
    return jobs.track_status(
        spark,
        fx.status_history(spark, d, fx.stream),
        ["at_utc", "event_id"],
        f"{root}/status",
        f"{root}/checkpoint",
    )


@query
def status_tracker_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    """Status per key of a stream whose neighbouring slices of time are mixed."""
    root = scratch_path(spark, "stream-shuffled")
    history, step = fx.arriving(fx.status_history(spark, d), "at_utc", mixed=True)
    late = f"{2 * step} microseconds"
    return tracker.track_out_of_order(
        spark, history, f"{root}/status", f"{root}/checkpoint", late
    )


@query
def stream_answers(spark: SparkSession, d: str) -> DataFrame:
    """Messages and answers that arrive together; none within twelve hours is an outcome.

    A heartbeat at the end of both streams decides the last messages.
    """
    root = scratch_path(spark, "stream-answers")
    end = F.lit(datetime(2100, 1, 1)).cast("timestamp")
    beat = F.lit(answers.HEARTBEAT).alias("idempotency_key")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (
        ("http_status", "int"), ("exception", "string"), ("already_present", "boolean")
    )]
    sent, step = fx.arriving(fx.sent_messages(spark, d), "sent_at", last=[beat, end.alias("sent_at")])
    came, _ = fx.arriving(
        fx.answers_to_messages(spark, d), "at_utc", last=[beat, end.alias("at_utc"), *nothing]
    )
    late = f"{2 * step} microseconds"
    found = answers.drain_answers(
        sent, came, "12 hours", late, f"{root}/rows", f"{root}/checkpoint"
    )
    return timed(found, "sent_at", "answered_at")


@query
def stream_second_source(spark: SparkSession, d: str) -> DataFrame:
    """Two item streams, each with its folder and checkpoint, feed one run; the second one is
    then started again. Every item counts once."""
    root = scratch_path(spark, "stream-second")
    inputs, options, store = _inputs(spark, d), fx.options(), f"{root}/store"
    odd = F.substring_index("item_id", "-", -1).cast("bigint") % 2 == 1
    halves = partial(fx.stream, arrivals=2)
    first, second = fx.items(spark, d, halves).where(odd), fx.items(spark, d, halves).where(~odd)
    receipts = fx.receipts(spark, d, halves)
    jobs.stream_migration(spark, first, inputs, options, store, f"{root}/a")
    jobs.stream_migration(spark, second, inputs, options, store, f"{root}/b")
    return _summary(
        jobs.stream_migration(spark, second, inputs, options, store, f"{root}/b", receipts)
    )


@query
def retry_loop(spark: SparkSession, d: str) -> DataFrame:
    """Receipts in three batches, each followed by a pass that sends the due keys again."""
    store = scratch_path(spark, "retry-loop")
    inputs, receipts = _inputs(spark, d), fx.receipts(spark, d, tries=3)
    execution = mg.start_run(spark, inputs, fx.options(), store)
    mg.migrate_batch(execution, inputs)
    for n in (1, 2, 3):
        mg.apply_delivery(execution, receipts.where(F.col("attempt_no") == n))
        retries.retry_pass(execution, datetime(2100, 1, 1))
    records = mg.records_of(spark, store)
    left = retries.open_retries(execution)
    assert records is not None and left is not None
    folded = state.fold_records(records).groupBy(F.col("status").alias("what"))
    kept = folded.agg(
        F.count(F.lit(1)).alias("n"), F.sum("attempt_count").cast("bigint").alias("attempts")
    )
    none = F.lit(0).cast("bigint").alias("attempts")
    waiting = left.select(F.lit("open").alias("what")).groupBy("what").count()
    sent = spark.read.text(execution.path("outbox")).select(F.lit("sent").alias("what"))
    return kept.union(waiting.select("what", "count", none)).union(
        sent.groupBy("what").count().select("what", "count", none)
    )


def _changed_blobs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(blobs, parts) after a third of the parts were replaced and some bytes damaged."""
    number = F.substring_index("part_id", "-", -1).cast("bigint")
    replaced, damaged = number % 3 == 0, number % 31 == 0
    bytes_ = F.col("content").cast("string")
    bytes_ = F.when(replaced, F.concat(bytes_, F.lit("-v2"))).otherwise(bytes_)
    good = fx.blobs(spark, d).select("part_id", bytes_.alias("content"))
    stated = good.where(replaced).select(
        "part_id",
        F.sha2("content", 256).alias("_sha256"),
        F.octet_length("content").cast("bigint").alias("_size"),
    )
    parts = fx.parts(spark, d).join(stated, "part_id", "left").withColumns(
        {"sha256": F.coalesce("_sha256", "sha256"), "size_bytes": F.coalesce("_size", "size_bytes")}
    )
    hit = F.when(damaged, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    blobs = good.select("part_id", hit.cast("binary").alias("content")).withColumn(
        "version", F.when(replaced | damaged, "2").otherwise("1")
    )
    return blobs, parts.select(*schemas.PARTS.names)


@query
def replaced_parts(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over one store; between them parts are replaced and bytes damaged.

    The parts of the second run's items, as that run saw them.
    """
    store = scratch_path(spark, "replaced")
    inputs = _inputs(spark, d)
    odd = F.substring_index("item_id", "-", -1).cast("bigint") % 2 == 1
    before = fx.blobs(spark, d).withColumn("version", F.lit("1"))
    first = replace(
        inputs, items=inputs.items.where(~odd), blob_hashes=readers.blob_hashes(before)
    )
    mg.run_migration(spark, first, fx.options(), store)
    blobs, parts = _changed_blobs(spark, d)
    second = replace(
        inputs, items=inputs.items.where(odd), blob_hashes=readers.blob_hashes(blobs), parts=parts
    )
    mg.run_migration(spark, second, replace(fx.options(), run_id="run-second"), store)
    checked = spark.read.parquet(f"{store}/checked").where(odd)
    return checked.select("part_id", "sha256", "size_bytes", "error").distinct()


@query
def blob_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as one file each, every tenth without bytes, read without a listing."""
    register_part_files(spark)
    path = scratch_path(spark, "blob-files")
    text = F.when(F.col("doc_id") % 10 != 0, F.col("text"))
    rows = fx.table(spark, d, "documents").select(
        fx.tagged("doc-", "doc_id").alias("part_id"),
        F.coalesce(text, F.lit("")).cast("binary").alias("content"),
    )
    rows.repartition(8).write.format("part_files").mode("append").save(path)
    files = spark.read.format("part_files").option("partitions", 8).load(path)
    return files.select("part_id", "sha256", "blob_bytes")


@query
def outbox_sink(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a run delivered through the sink, a batch of it written twice."""
    register_outbox(spark)
    path = scratch_path(spark, "outbox-sink")
    plan = mg.plan_migration(spark, _inputs(spark, d), fx.options())
    rows = stored(writers.outbox_rows(plan.messages()), "outbox-rows")
    for _ in range(2):
        rows.write.format("outbox").mode("append").option("batch", "all").save(path)
    held = spark.read.format("outbox").load(path)
    return held.select(
        F.get_json_object("message", "$.idempotencyKey").alias("idempotency_key"),
        "archive_class",
        F.get_json_object("message", "$.targetArchive").alias("target_archive"),
    )


@query
def outbox_sink_stream(spark: SparkSession, d: str) -> DataFrame:
    """Documents that arrive in several micro-batches, delivered through the sink."""
    register_outbox(spark)
    root = scratch_path(spark, "outbox-stream")
    rows = fx.stream(spark, d, "documents").select(
        F.col("lang").alias("archive_class"),
        F.to_json(F.struct("doc_id", "source", "n_chars")).alias("message"),
    )
    writer = rows.writeStream.format("outbox").option("path", f"{root}/outbox")
    writer = writer.option("stream", "documents").option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    held = spark.read.format("outbox").load(f"{root}/outbox")
    return held.select(
        F.get_json_object("message", "$.doc_id").cast("bigint").alias("doc_id"),
        "archive_class",
        F.get_json_object("message", "$.n_chars").cast("bigint").alias("n_chars"),
    )


@query
def reconcile_digests(spark: SparkSession, d: str) -> DataFrame:
    """Discrepancies found through digest trees, the target's tree having been stored."""
    path = scratch_path(spark, "digest-tree")
    target = fx.target_side(spark, d)
    digest_tree(target).write.parquet(path)
    stored = spark.read.parquet(path)
    return reconcile_by_digest(fx.local_side(spark, d), target, target_tree=stored)


@query
def target_parts_approx(spark: SparkSession, d: str) -> DataFrame:
    """Different parts from the sketches of four batches, and whether they are near enough."""
    path = scratch_path(spark, "sketches")
    parts = fx.table(spark, d, "documents").select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")
    )
    for n in range(4):
        mine = parts.where(F.pmod("doc_id", F.lit(4)) == n)
        writers.write_batch(reconcile.part_sketch(mine), path, str(n))
    exact = parts.agg(F.count_distinct("sha256")).scalar()
    found = reconcile.target_stats_approx(spark.read.parquet(path))
    return found.select("parts", (F.abs(F.col("unique_parts") / exact - 1) <= 0.03).alias("near"))


@query
def stream_rate_windows(spark: SparkSession, d: str) -> DataFrame:
    """The ingest rate with finished minutes appended once and open ones replaced."""
    root = scratch_path(spark, "stream-windows")
    rate = jobs.ingest_rate(fx.item_events(spark, d, fx.stream))
    found = windows.drain_windows(
        rate, ["run_id", "minute"], "minute", "1 minute", "10 minutes", root, f"{root}/checkpoint"
    )
    return timed(found, "minute")


@query
def identity_document(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document of all customers, each twice, read in ranges; the last entry wins."""
    register_identity_map(spark)
    path = scratch_path(spark, "identity")
    owners = fx.table(spark, d, "customer").withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    entry = F.to_json(
        F.struct(
            F.col("c_name").alias("upn"),
            F.concat_ws("-", F.lit("tgt"), "c_custkey", "again").alias("targetArchiveId"),
        )
    )
    lines = owners.orderBy("again", "c_custkey").select(F.concat(entry, F.lit(",")).alias("value"))
    head = spark.range(1).select(F.lit('{"mappings": [').alias("value"))
    last = spark.range(1).select(F.lit('{"upn": "nobody", "targetArchiveId": "none"}]}').alias("value"))
    head.union(lines).union(last).coalesce(1).write.text(path)
    (file,) = [r[0] for r in spark.read.text(path).select(F.input_file_name()).distinct().collect()]
    rows = spark.read.format("identity_map").option("rangeBytes", 4096).load(file)
    newest = rows.groupBy("upn").agg(F.max_by("target_archive", "pos").alias("target_archive"))
    return newest.where("upn <> 'nobody'")


FLAGSHIP = "dry_run_archive_summary"
