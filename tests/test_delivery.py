import random

import pytest
from pyspark.sql import functions as F

from tests import build as b
from vaultferry.operators import delivery as dl
from vaultferry.operators import ingest, state

ATTEMPT = (
    "idempotency_key string, attempt_no int, http_status int, exception string, "
    "already_present boolean, target_id string, retry_after double, at_utc timestamp"
)


def attempts(spark, *rows):
    """(key, number, status, exception, already_present, target_id, retry_after)"""
    return spark.createDataFrame([(*r, b.utc(2024, 1, 1)) for r in rows], ATTEMPT)


def roll(spark, *rows, **options):
    got = dl.attempt_rollup(attempts(spark, *rows), **options).collect()
    assert len(got) == 1
    return got[0]


def test_two_503_then_success(spark):
    row = roll(
        spark,
        ("k", 1, 503, None, None, None, None),
        ("k", 3, 200, None, False, "tgt-1", None),
        ("k", 2, 503, None, None, None, None),
        max_retries=3,
    )
    assert (row["ingest_status"], row["target_id"], row["attempts"]) == ("Ingested", "tgt-1", 3)
    assert not row["retryable"] and not row["exhausted"]


def test_six_429_are_exhausted(spark):
    row = roll(spark, *[("k", n, 429, None, None, None, 2.0) for n in range(1, 7)])
    assert (row["ingest_status"], row["error_code"]) == ("TransientError", "TooManyRequests")
    assert row["exhausted"] and row["retry_after"] == 2.0
    five = dl.attempt_rollup(attempts(spark, *[("k", n, 429, None, None, None, None) for n in range(1, 6)]))
    assert not five.first()["exhausted"]


@pytest.mark.parametrize(
    "status, exception, present, expected",
    [
        (200, None, True, ("AlreadyPresent", None)),
        (204, None, None, ("Ingested", None)),
        (422, None, None, ("PermanentError", "UnprocessableEntity")),
        (409, None, None, ("PermanentError", "Conflict")),
        (500, None, None, ("PermanentError", "InternalServerError")),
        (503, None, None, ("TransientError", "ServiceUnavailable")),
        (None, "HttpRequestException", None, ("TransientError", "HttpRequestException")),
        (None, "TaskCanceledException", None, ("TransientError", "TaskCanceledException")),
        (None, "BrokenCircuitException", None, ("TransientError", "BrokenCircuitException")),
        (None, "JsonException", None, ("UnexpectedError", "JsonException")),
    ],
)
def test_classes(spark, status, exception, present, expected):
    row = dl.classify_receipts(attempts(spark, ("k", 1, status, exception, present, "t", 3.0))).first()
    assert (row["ingest_status"], row["error_code"]) == expected
    assert (row["target_id"] is not None) == (expected[1] is None)
    assert (row["retry_after"] is not None) == (status == 503)


def test_retry_queue(spark):
    rows = attempts(
        spark,
        ("asked", 1, 429, None, None, None, 7.0),
        ("doubling", 1, 503, None, None, None, None),
        ("doubling", 2, 503, None, None, None, None),
        ("doubling", 3, 503, None, None, None, None),
        ("cancelled", 1, None, "TaskCanceledException", None, None, None),
        ("refused", 1, 422, None, None, None, None),
        *[("worn", n, 503, None, None, None, None) for n in range(1, 70)],
    )
    got = {
        r["idempotency_key"]: (r["delay_seconds"], r["due"])
        for r in dl.retry_queue(dl.attempt_rollup(rows))
        .withColumn("due", F.date_format("due_at_utc", "HH:mm:ss"))
        .collect()
    }
    assert got == {"asked": (7.0, "00:00:07"), "doubling": (2.0, "00:00:02")}


def test_failure_ratio(spark):
    rows = attempts(
        spark,
        ("a", 1, 503, None, None, None, None),
        ("b", 1, None, "HttpRequestException", None, None, None),
        ("c", 1, 422, None, None, None, None),
        ("d", 1, 200, None, None, None, None),
    )
    row = dl.failure_ratio(rows).first()
    assert (row["deliveries"], row["failures"], row["failure_ratio"], row["tripped"]) == (4, 2, 0.5, True)


def test_sliding_share_equals_a_plain_loop(spark):
    """Moments on the borders of spans and cells, many at one moment, and none at all."""
    draw = random.Random(5)
    micros = [0, 1, 30_000_000 - 1, 30_000_000, 30_000_001, 60_000_000, 60_000_000, -1, -30_000_000]
    micros += [draw.randrange(-90_000_000, 200_000_000) for _ in range(150)] + [500_000_000] * 20
    rows = [(m, draw.choice([200, 422, 429, 503])) for m in micros]
    frame = spark.createDataFrame([*rows, (None, 503)], "m bigint, http_status int").select(
        F.timestamp_micros("m").alias("at_utc"), "http_status", F.lit(None).cast("string").alias("exception")
    )
    got = {
        r.m: (r.deliveries, r.failures, r.tripped)
        for r in dl.sliding_failure_share(frame, 30, 0.5, 3).withColumn("m", F.unix_micros("at_utc")).collect()
    }
    want = {}
    for m in set(micros):
        near = [code for at, code in rows if m - 30_000_000 < at <= m]
        bad = sum(code in (429, 503) for code in near)
        want[m] = (len(near), bad, 2 * bad >= len(near) >= 3)
    assert got == want
    assert dl.sliding_failure_share(frame.limit(0)).count() == 0


PART = "idempotency_key string, seq bigint, pos int, part_id string, sha256 string, size_bytes bigint"


def accept(spark, messages, parts, registry=(), store=()):
    m = spark.createDataFrame(messages, "idempotency_key string, seq bigint, target_archive string")
    p = spark.createDataFrame(parts, PART)
    r = spark.createDataFrame(registry, "idempotency_key string, target_id string, target_archive string, deduped boolean")
    s = spark.createDataFrame(store, "sha256 string")
    return ingest.ingest_batch(m, p, r, s)


def receipts(result):
    return {
        (r["idempotency_key"], r["seq"]): (r["deduped"], r["already_present"])
        for r in result.receipts.collect()
    }


def test_accept_rules(spark):
    result = accept(
        spark,
        [("new", 1, "t"), ("held", 2, "t"), ("again", 3, "t"), ("again", 4, "t"), ("twice", 5, "t"),
         ("bare", 6, "t")],
        [
            ("new", 1, 0, "p1", "h1", 1),
            ("held", 2, 0, "p9", "h9", 1),
            ("again", 3, 0, "p1", "h1", 1),
            ("again", 4, 0, "p4", "h4", 1),
            ("twice", 5, 0, "p5", "h5", 1),
            ("twice", 5, 1, "p5", "h5", 1),
        ],
        registry=[("held", "old", "t", True)],
        store=[("h0",)],
    )
    assert receipts(result) == {
        ("new", 1): (False, False),
        ("held", 2): (True, True),
        ("again", 3): (True, False),
        ("again", 4): (True, True),
        ("twice", 5): (True, False),
        ("bare", 6): (False, False),
    }
    assert {r["sha256"] for r in result.new_parts.collect()} == {"h1", "h5"}
    assert {r["idempotency_key"] for r in result.new_records.collect()} == {"new", "again", "twice", "bare"}
    ids = {r["idempotency_key"]: r["target_id"] for r in result.receipts.collect()}
    assert ids["held"] == "old" and ids["new"].startswith("sx-")


def test_replay_changes_nothing(spark):
    messages = [("a", 1, "t"), ("b", 2, "t")]
    parts = [("a", 1, 0, "p", "h", 1), ("b", 2, 0, "q", "h", 1)]
    first = accept(spark, messages, parts)
    held = [tuple(r) for r in first.new_records.select("idempotency_key", "target_id", "target_archive", "deduped").collect()]
    store = [(r["sha256"],) for r in first.new_parts.collect()]
    second = accept(spark, messages, parts, held, store)
    assert second.new_records.count() == 0 and second.new_parts.count() == 0
    assert receipts(second) == {("a", 1): (False, True), ("b", 2): (True, True)}


def test_rejects_only_delivered_keys(spark):
    items = spark.createDataFrame([("i1", "k1"), ("i2", "k2"), ("i3", "k3"), ("i4", None)], "item_id string, idempotency_key string")
    records = spark.createDataFrame(
        [("k1", "Migrated"), ("k1", "Migrated"), ("k2", "Failed"), ("k3", "AlreadyPresent")],
        "idempotency_key string, status string",
    )
    todo, done = ingest.skip_migrated(items, records)
    assert {r["item_id"] for r in done.collect()} == {"i1", "i3"}
    assert {r["item_id"] for r in todo.collect()} == {"i2", "i4"}


def record(key, at, status="Migrated", target=None, code=None, archive="t"):
    moment = b.utc(2024, 1, at)
    good = status == "Migrated"
    return dict(
        idempotency_key=key,
        source_item_id="i",
        archive_id="a",
        target_archive=archive,
        target_id=target,
        status=status,
        extracted_at_utc=moment,
        ingested_at_utc=moment if good else None,
        last_attempt_at_utc=moment,
        attempt_count=1,
        last_error_code=code,
    )


def test_fold_records(spark):
    from vaultferry import schemas

    log = [
        record("k", 1, target="one", archive="first"),
        record("k", 3, target="two", archive="second"),
        record("f", 1, "Failed", code="E1"),
        record("f", 2, "Failed", code="E2"),
        record("m", 1, "Failed", code="E1"),
        record("m", 2, target="m"),
        record("m", 3, "Failed", code="E3"),
    ]
    whole = state.fold_records(b.frame(spark, log, schemas.RECORDS))
    rows = {r["idempotency_key"]: r for r in whole.collect()}
    k = rows["k"]
    assert (k["target_id"], k["target_archive"], k["attempt_count"]) == ("two", "first", 2)
    assert k["extracted_at_utc"].day == 1 and k["ingested_at_utc"].day == 3
    assert (rows["f"]["status"], rows["f"]["last_error_code"], rows["f"]["target_id"]) == ("Failed", "E2", None)
    assert (rows["m"]["status"], rows["m"]["last_error_code"], rows["m"]["attempt_count"]) == ("Migrated", None, 3)

    early = state.fold_records(b.frame(spark, log[::2], schemas.RECORDS))
    late = b.frame(spark, log[1::2], schemas.RECORDS)
    stepwise = state.fold_records(early.select(*schemas.RECORDS.names).unionByName(late))
    assert sorted(map(tuple, stepwise.collect())) == sorted(map(tuple, whole.collect()))


def test_checkpoints(spark):
    from vaultferry import schemas

    log = [
        dict(run_id="r", phase="Ingest", created_at_utc=b.utc(2024, 1, 1), metadata="1"),
        dict(run_id="r", phase="Ingest", created_at_utc=b.utc(2024, 1, 3), metadata="3"),
        dict(run_id="r", phase="Scan", created_at_utc=b.utc(2024, 1, 2), metadata=None),
    ]
    df = b.frame(spark, log, schemas.CHECKPOINTS)
    assert {(r["phase"], r["metadata"]) for r in state.fold_checkpoints(df).collect()} == {("Ingest", "3"), ("Scan", None)}
    newest = state.latest_checkpoint(df).collect()
    assert [(r["run_id"], r["phase"], r["metadata"]) for r in newest] == [("r", "Ingest", "3")]
    assert state.latest_checkpoint(df.where("false")).count() == 0
