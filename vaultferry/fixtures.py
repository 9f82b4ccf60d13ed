"""Archive-migration views over the star-schema tables used in tests and benchmarks.

Each view takes the folder of the tables. Time columns become session-zone timestamps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultferry.functions.hashing import content_hash
from vaultferry.functions.keys import idempotency_key
from vaultferry.functions.payload import audit_payload
from vaultferry.operators.audit import collect_audit
from vaultferry.operators.lookups import with_position
from vaultferry.operators.report import outcome_counts
from vaultferry.options import RunOptions
from vaultferry.schemas import RECEIPTS
from vaultferry.session import scratch_path

AS_OF = datetime(2024, 6, 1)
RUN_ID = "run-batch"
PART_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def options(**changes: object) -> RunOptions:
    return RunOptions(run_id=RUN_ID, as_of=AS_OF, **changes)  # type: ignore[arg-type]


# Columns of the tables.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _zoned(df: DataFrame) -> DataFrame:
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _zoned(spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet"))


# Micro-batches that a table is streamed in.
ARRIVALS = 4


# Rows of a file of an arrival, at least.
FILE_ROWS = 100_000
# Files of an arrival by time, at most; each is written by a task.
ARRIVAL_FILES = 16


def stream(spark: SparkSession, sf_dir: str, name: str, arrivals: int = ARRIVALS) -> DataFrame:
    """The table as files that arrive one after the other, in the order of its first column.

    Each arrival is one micro-batch, in as many files as every other one.
    """
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    key = rows.columns[0]
    low, high = rows.agg(F.min(key), F.max(key)).first()
    step = 1 if low is None else (high - low) // arrivals + 1
    number = F.lit(0) if low is None else F.expr(f"({key} - {low}) div {step}")
    sizes = rows.agg(*[F.count_if(number == n) for n in range(arrivals)]).first()
    files_each = max(1, min(sizes) // FILE_ROWS)
    path = scratch_path(spark, f"arrivals-{name}")
    for n in range(arrivals):
        part = rows.where(number == n)
        # Rows are dealt out one by one, so with this many rows no file stays away.
        part = part.coalesce(1) if files_each == 1 else part.repartition(files_each)
        part.write.mode("append").parquet(path)
    files = spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", files_each)
    return _zoned(files.parquet(path))


Reader = Callable[[SparkSession, str, str], DataFrame]


def arriving(
    rows: DataFrame,
    time: str,
    slices: int = 6,
    mixed: bool = False,
    last: Sequence[Column] | None = None,
) -> tuple[DataFrame, int]:
    """The rows as files that arrive by time, and the microseconds of a slice.

    With ``mixed``, half of a slice comes with the next one, so neighbouring slices are out of
    order. ``last`` is a row that comes in a file of its own at the end. Every slice comes in as
    many files as the others, so it is one micro-batch; a small slice has empty ones among them.
    """
    spark = rows.sparkSession
    micros = F.unix_micros(time)
    low, high = rows.agg(F.min(micros), F.max(micros)).first()
    step = 1 if low is None else (high - low) // slices + 1
    path = scratch_path(spark, "arriving")
    number = F.lit(0) if low is None else F.expr(f"(unix_micros({time}) - {low}) div {step}")
    if mixed:
        number = number + F.pmod(F.xxhash64(*rows.columns), F.lit(2))
    placed = rows.withColumn("_slice", number)
    each = range(slices + 1)
    sizes = placed.agg(*[F.count_if(F.col("_slice") == n) for n in each]).first()
    files_each = min(max(1, max(sizes) // FILE_ROWS), ARRIVAL_FILES)
    empty = spark.createDataFrame([], rows.schema)
    for n in each:
        files = min(max(1, sizes[n] // FILE_ROWS), files_each)
        part = placed.where(F.col("_slice") == n).drop("_slice")
        # Rows are dealt out one by one, so with this many rows no file stays away.
        part.repartition(files).write.mode("append").parquet(path)
        for _ in range(files_each - files):
            empty.coalesce(1).write.mode("append").parquet(path)
    if last is not None:
        spark.range(1).select(*last).write.mode("append").parquet(path)
    files = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_each)
    return files.parquet(path), step


def sent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per order, evenly over the month of the events; the last orders come later."""
    events = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    seconds = F.col("o_orderkey") * (30 * 86400 // (events + 1))
    return table(spark, sf_dir, "orders").select(
        tagged("itm-", "o_orderkey").alias("idempotency_key"),
        F.timestamp_micros(F.lit(1704067200000000) + seconds * 1000000).alias("sent_at"),
    )


def answers_to_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per event, to the message of the same number."""
    return attempts(spark, sf_dir).select(
        tagged("itm-", "attempt_order.event_id").alias("idempotency_key"),
        "at_utc",
        "http_status",
        "exception",
        "already_present",
    )


def tagged(prefix: str, c: str | Column) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(prefix), column.cast("string"))


def _choose(subject: Column, answers: dict[str, str], other: str | None = None) -> Column:
    result = F.lit(other).cast("string")
    for value, answer in answers.items():
        result = F.when(subject == value, answer).otherwise(result)
    return result


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    kind = _choose(
        F.col("c_mktsegment"), {"MACHINERY": "Journal", "FURNITURE": "Fsa"}, "Mailbox"
    )
    owned = (kind == "Mailbox") & (F.col("c_acctbal") >= 0)
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        tagged("arc-", "c_custkey").alias("archive_id"),
        kind.alias("type"),
        F.when(owned, F.concat("c_name", F.lit("@Contoso.com"))).alias("owner_upn"),
        (F.col("c_custkey") % 10 == 0).alias("legal_hold"),
        tagged("VS-", "n_name").alias("vault_store"),
    )


def identity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mailbox = table(spark, sf_dir, "customer").where(
        ~F.col("c_mktsegment").isin("MACHINERY", "FURNITURE") & (F.col("c_custkey") % 7 != 0)
    )
    return mailbox.select(
        F.concat(F.lower("c_name"), F.lit("@contoso.com")).alias("upn"),
        tagged("tgt-", "c_custkey").alias("target_archive"),
    )


# Folder and category by order priority.
FOLDERS = {
    "1": "Inbox",
    "2": "INBOX/Projects",
    "3": "Sent Items",
    "4": "Inbox/Legal",
    "5": "Archive",
}
CATEGORIES = {
    "1": "Legal-7Y",
    "2": "Finance-10y",
    "3": "Standard-3Y",
    "4": "NoExpiry",
    "5": "Archive-1Y",
}


def items(spark: SparkSession, sf_dir: str, read: Reader = table) -> DataFrame:
    """Items with the columns every order has; part lists are a table of their own."""
    priority = F.substring("o_orderpriority", 1, 1)
    sender = F.concat(tagged("user", "o_custkey"), F.lit("@contoso.com"))
    team = F.concat(tagged("team", F.col("o_orderkey") % 50), F.lit("@contoso.com"))
    nobody = F.array().cast("array<string>")
    return read(spark, sf_dir, "orders").select(
        tagged("itm-", "o_orderkey").alias("item_id"),
        tagged("arc-", "o_custkey").alias("archive_id"),
        _choose(priority, FOLDERS).alias("folder_path"),
        tagged("Order ", "o_orderkey").alias("subject"),
        F.col("o_orderdate").alias("sent_date_utc"),
        sender.alias("from"),
        F.array(sender, team).alias("to"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(team)).otherwise(nobody).alias("cc"),
        F.when(F.col("o_orderkey") % 11 == 0, F.array(sender)).otherwise(nobody).alias("bcc"),
        _choose(priority, CATEGORIES).alias("retention_category"),
        F.floor("o_totalprice").cast("bigint").alias("size_bytes"),
        _choose(F.col("o_orderstatus"), {"F": "IPM.Note", "O": "IPM.Appointment"}, "IPM.Post").alias(
            "message_class"
        ),
    )


def part_refs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part references whose ``pos`` grows along the list but leaves gaps.

    Line number and part key decide which part comes first; further columns only order
    references to the same part.
    """
    return table(spark, sf_dir, "lineitem").select(
        tagged("itm-", "l_orderkey").alias("item_id"),
        (F.col("l_linenumber").cast("bigint") * F.lit(1 << 50) + F.col("l_partkey")).alias("pos"),
        tagged("prt-", "l_partkey").alias("part_id"),
    )


def part_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part references with whole-number positions."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *PART_ORDER)
    return with_position(lines, ["l_orderkey"], PART_ORDER).select(
        tagged("itm-", "l_orderkey").alias("item_id"),
        "pos",
        tagged("prt-", "l_partkey").alias("part_id"),
    )


def _part_payload() -> Column:
    return F.concat("p_name", F.lit("|"), "p_brand")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "part").where(F.col("p_partkey") % 97 != 0)
    return kept.select(
        tagged("prt-", "p_partkey").alias("part_id"),
        F.encode(_part_payload(), "UTF-8").alias("content"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "part").where(F.col("p_partkey") % 89 != 0)
    stored = F.when(F.col("p_partkey") % 50 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(
        F.upper(content_hash(_part_payload()))
    )
    part_id = tagged("prt-", "p_partkey")
    return kept.select(
        part_id.alias("part_id"),
        stored.alias("sha256"),
        F.octet_length(_part_payload()).cast("bigint").alias("size_bytes"),
        F.concat(part_id, F.lit(".bin")).alias("data_ref"),
    )


# Audit event type by event type.
AUDIT_TYPES = {
    "purchase": "ItemMigrated",
    "signup": "ItemAlreadyPresent",
    "view": "ItemSkipped",
    "click": "ItemTransientFailed",
    "error": "ItemPermanentFailed",
}


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def item_events(spark: SparkSession, sf_dir: str, read: Reader = table) -> DataFrame:
    kind = _choose(F.col("event_type"), AUDIT_TYPES)
    archive = tagged("arc-", "user_id")
    failed = F.col("event_type").isin("click", "error")
    payload = F.when(
        failed, audit_payload(archiveId=archive, errorCode=tagged("E", props_k()))
    ).otherwise(audit_payload(archiveId=archive))
    return read(spark, sf_dir, "events").select(
        tagged("evt-", "event_id").alias("id"),
        F.col("ts").alias("timestamp_utc"),
        kind.alias("event_type"),
        tagged("itm-", "event_id").alias("item_id"),
        payload.alias("payload"),
        tagged("run-", F.col("user_id") % 5).alias("run_id"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item events of five runs with their run events; run-3 failed, run-4 still runs."""
    events = item_events(spark, sf_dir)
    runs = events.groupBy("run_id").agg(
        F.min("timestamp_utc").alias("first"),
        F.max("timestamp_utc").alias("last"),
        F.count(F.lit(1)).alias("total_items"),
        *outcome_counts(),
    )
    started = runs.select(
        F.concat(F.lit("start-"), "run_id").alias("id"),
        F.col("first").alias("timestamp_utc"),
        F.lit("RunStarted").alias("event_type"),
        F.lit(None).cast("string").alias("item_id"),
        audit_payload(runId=F.col("run_id"), dryRun=F.lit(False)).alias("payload"),
        "run_id",
    )
    failed = F.col("run_id") == "run-3"
    counters = audit_payload(
        totalItems=F.col("total_items"),
        migrated=F.col("migrated"),
        alreadyPresent=F.col("already_present"),
        orphaned=F.col("orphaned"),
        skipped=F.col("skipped"),
        failed=F.col("failed"),
    )
    ended = runs.where(F.col("run_id") != "run-4").select(
        F.concat(F.lit("end-"), "run_id").alias("id"),
        F.col("last").alias("timestamp_utc"),
        F.when(failed, "RunFailed").otherwise("RunCompleted").alias("event_type"),
        F.lit(None).cast("string").alias("item_id"),
        F.when(failed, F.lit("{}")).otherwise(counters).alias("payload"),
        "run_id",
    )
    return collect_audit([events, started, ended])


def attempts(spark: SparkSession, sf_dir: str, read: Reader = table) -> DataFrame:
    """Delivery attempts, five or twenty per key; ``attempt_order`` sorts those of a key."""
    k = props_k()
    status = (
        F.when(k < 60, 200).when(k < 75, 503).when(k < 85, 429).when(k < 93, 422).cast("int")
    )
    exception = (
        F.when(k < 93, F.lit(None)).when(k < 97, "HttpRequestException").otherwise(
            "TaskCanceledException"
        )
    )
    long = F.expr("event_id div 20 % 4 = 0")
    number = F.when(long, F.concat(F.lit("long-"), F.expr("event_id div 20"))).otherwise(
        F.expr("cast(event_id div 5 as string)")
    )
    return read(spark, sf_dir, "events").select(
        tagged("key-", number).alias("idempotency_key"),
        F.struct("ts", "event_id").alias("attempt_order"),
        status.alias("http_status"),
        exception.alias("exception"),
        F.when(status == 200, k % 10 == 0).alias("already_present"),
        F.when(status == 200, tagged("sx-", number)).alias("target_id"),
        F.when(status == 429, (k % 5 + 1).cast("double")).alias("retry_after"),
        F.col("ts").alias("at_utc"),
    )


def receipts(
    spark: SparkSession, sf_dir: str, read: Reader = table, tries: int = 2
) -> DataFrame:
    """Receipts of the target: some attempts for each of the first items, by events."""
    tried = attempts(spark, sf_dir, read).select(
        tagged("itm-", F.expr(f"attempt_order.event_id div {tries}")).alias("item_id"),
        F.expr(f"cast(attempt_order.event_id % {tries} + 1 as int)").alias("attempt_no"),
        "http_status",
        F.when(F.col("http_status") == 200, tagged("sx-", "attempt_order.event_id")).alias(
            "target_id"
        ),
        F.lit(None).cast("boolean").alias("deduped"),
        "already_present",
        "retry_after",
        "exception",
        "at_utc",
    )
    stores = archives(spark, sf_dir).select("archive_id", "vault_store")
    key = idempotency_key(F.col("vault_store"), F.col("archive_id"), F.col("item_id"))
    keyed = items(spark, sf_dir).select("item_id", "archive_id").join(stores, "archive_id")
    keyed = keyed.select("item_id", key.alias("idempotency_key"))
    return tried.join(keyed, "item_id").select(*RECEIPTS.names)


def long_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items, checked parts): the lines of fifty customers are one item's part list."""
    group = F.expr("o_custkey div 50")
    orders = table(spark, sf_dir, "orders").withColumn("item_id", tagged("grp-", group))
    owned = orders.groupBy("item_id").agg(F.max("o_orderdate").alias("sent_date_utc"))
    none = F.array().cast("array<string>")
    whole = owned.select(
        "item_id",
        F.lit("arc-1").alias("archive_id"),
        F.lit("Journal").alias("type"),
        F.lit("VS-1").alias("vault_store"),
        F.lit("tgt-1").alias("target_archive"),
        F.lit(False).alias("legal_hold"),
        "sent_date_utc",
        *[F.lit(c).alias(c) for c in ("subject", "from", "message_class", "folder_path")],
        *[none.alias(c) for c in ("to", "cc", "bcc")],
        F.lit("NoExpiry").alias("retention_category"),
    )
    lines = table(spark, sf_dir, "lineitem").join(
        orders.select("item_id", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"
    )
    checked = lines.select(
        "item_id",
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"),
        tagged("prt-", "l_partkey").alias("part_id"),
        content_hash(tagged("part ", "l_partkey")).alias("sha256"),
        F.lit(1).cast("bigint").alias("size_bytes"),
    )
    return whole, checked


# Item status by event type.
HISTORY_STATUS = {
    "signup": "Discovered",
    "view": "Mapped",
    "click": "Rehydrated",
    "purchase": "Ingesting",
    "error": "Failed",
}


def status_history(spark: SparkSession, sf_dir: str, read: Reader = table) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        tagged("key-", "user_id").alias("key"),
        _choose(F.col("event_type"), HISTORY_STATUS).alias("status"),
        F.col("ts").alias("at_utc"),
        "event_id",
    )


def record_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-log rows of purchases (delivered) and errors (failed); keys repeat."""
    item = F.expr("event_id div 3")
    good = F.col("event_type") == "purchase"
    archive = tagged("arc-", F.expr("event_id div 120"))
    item_id = tagged("itm-", item)
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("purchase", "error"))
        .select(
            idempotency_key(F.lit("VS-1"), archive, item_id).alias("idempotency_key"),
            item_id.alias("source_item_id"),
            archive.alias("archive_id"),
            tagged("tgt-", F.col("event_id") % 7).alias("target_archive"),
            F.when(good, tagged("sx-", "event_id")).alias("target_id"),
            F.when(good, "Migrated").otherwise("Failed").alias("status"),
            F.col("ts").alias("extracted_at_utc"),
            F.when(good, F.col("ts")).alias("ingested_at_utc"),
            F.col("ts").alias("last_attempt_at_utc"),
            F.lit(1).alias("attempt_count"),
            F.when(~good, tagged("E", props_k())).alias("last_error_code"),
        )
    )


def checkpoint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint rows per run and phase, written again and again."""
    return table(spark, sf_dir, "events").select(
        tagged("run-", F.col("user_id") % 5).alias("run_id"),
        _choose(
            F.col("event_type"), {"view": "ArchiveScan", "click": "ItemExtract"}, "Ingest"
        ).alias("phase"),
        F.col("ts").alias("created_at_utc"),
        audit_payload(processedCount=F.col("event_id")).alias("metadata"),
    )


def document_messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(messages, parts): one message per document with its text as the only part."""
    docs = table(spark, sf_dir, "documents")
    key = tagged("ev:docs:all:", "doc_id")
    messages = docs.select(
        key.alias("idempotency_key"), F.col("doc_id").alias("seq"), F.col("source").alias("target_archive")
    )
    parts_ = docs.select(
        key.alias("idempotency_key"),
        F.col("doc_id").alias("seq"),
        F.lit(0).alias("pos"),
        tagged("doc-", "doc_id").alias("part_id"),
        content_hash(F.col("text")).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    )
    return messages, parts_


def conversation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parts of their conversation."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        content_hash(F.col("text")).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    )
    return turns.select(
        tagged("conv-", "conv_id").alias("item_id"),
        F.col("turn").alias("pos"),
        F.concat(tagged("conv-", "conv_id"), F.lit("-"), F.col("turn").cast("string")).alias(
            "part_id"
        ),
        "sha256",
        "size_bytes",
    )


def delivered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of earlier runs: every third order delivered, every third of the rest failed."""
    key = idempotency_key(F.lit("VS-1"), tagged("arc-", "o_custkey"), tagged("itm-", "o_orderkey"))
    status = (
        F.when(F.col("o_orderkey") % 3 != 0, "Failed")
        .when(F.col("o_orderkey") % 2 == 0, "Migrated")
        .otherwise("AlreadyPresent")
    )
    kept = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 != 2)
    return kept.select(key.alias("idempotency_key"), status.alias("status"))


def keyed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the key they would have in a single vault."""
    return items(spark, sf_dir).withColumn(
        "idempotency_key",
        idempotency_key(F.lit("VS-1"), F.col("archive_id"), F.col("item_id")),
    )


def local_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the source says was delivered: every order but each fourth."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 4 != 0)
    return orders.select(
        tagged("ev:VS-1:itm-", "o_orderkey").alias("idempotency_key"),
        tagged("tgt-", "o_custkey").alias("target_archive"),
        (F.col("o_custkey") % 10 == 0).alias("legal_hold"),
    )


def target_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the target holds: every order but each fifth, some in another archive or hold."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 5 != 0)
    moved = F.col("o_orderkey") % 9 == 0
    flipped = F.col("o_orderkey") % 13 == 0
    return orders.select(
        tagged("ev:VS-1:itm-", "o_orderkey").alias("idempotency_key"),
        F.when(moved, F.lit("tgt-moved")).otherwise(tagged("tgt-", "o_custkey")).alias(
            "target_archive"
        ),
        ((F.col("o_custkey") % 10 == 0) != flipped).alias("legal_hold"),
    )


def list_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part lists of both sides, from conversations; the target lost or changed some turns."""
    turns = table(spark, sf_dir, "conversations")
    key = tagged("ev:VS-1:itm-", "conv_id")
    ours = turns.select(
        key.alias("idempotency_key"),
        F.col("turn").alias("pos"),
        content_hash(F.col("text")).alias("sha256"),
    )
    changed = (F.col("conv_id") + F.col("turn")) % 17 == 0
    lost = (F.col("conv_id") * 7 + F.col("turn")) % 19 == 0
    theirs = turns.where(~lost).select(
        key.alias("idempotency_key"),
        F.col("turn").alias("pos"),
        F.when(changed, content_hash(F.col("role"))).otherwise(content_hash(F.col("text"))).alias(
            "sha256"
        ),
    )
    return ours, theirs


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the target holds before the run: every fifth order."""
    held = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 5 == 0)
    return held.select(
        tagged("ev:VS-1:itm-", "o_orderkey").alias("idempotency_key"),
        tagged("sx-old-", "o_orderkey").alias("target_id"),
        tagged("tgt-", "o_custkey").alias("target_archive"),
        (F.col("o_orderkey") % 2 == 0).alias("deduped"),
    )
