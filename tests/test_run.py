"""Whole runs: batch, repeated, resumed, streamed."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests import build as b
from vaultferry import schemas
from vaultferry.operators import report, state
from vaultferry.options import MIGRATE, Extensions, MigrationFilters
from vaultferry.plans import migration as mg
from vaultferry.sources import readers
from vaultferry.streaming import jobs

ALICE = [("alice@contoso.com", "user_mailbox:alice@contoso.com")]


def numbered(archive, n, **changes):
    return [b.item(item_id=f"{archive}-item-{i}", archive_id=archive, **changes) for i in range(n)]


def counters(summary):
    r = summary.first()
    return {c: r[c] for c in report.COUNTERS}


def accept(ready):
    """A target that takes everything."""
    return ready.select(
        "idempotency_key",
        F.lit(1).alias("attempt_no"),
        F.lit(200).alias("http_status"),
        F.concat(F.lit("t-"), "item_id").alias("target_id"),
        F.lit(False).alias("deduped"),
        F.lit(False).alias("already_present"),
        F.lit(None).cast("double").alias("retry_after"),
        F.lit(None).cast("string").alias("exception"),
        F.lit(b.AS_OF).alias("at_utc"),
    )


def run(spark, inputs, tmp_path, deliver=accept, **options):
    store = str(tmp_path / "store")
    return counters(mg.run_migration(spark, inputs, b.options(**options), store, deliver))


def records(spark, tmp_path):
    folded = state.fold_records(mg.records_of(spark, str(tmp_path / "store")))
    return {r["source_item_id"]: (r["status"], r["target_id"]) for r in folded.collect()}


def test_two_archives_and_an_orphan(spark, tmp_path):
    inputs = b.inputs(
        spark,
        [b.archive(archive_id="a1"), b.archive(archive_id="a2"), b.archive(archive_id="x", owner_upn=None)],
        numbered("a1", 4) + numbered("a2", 4) + numbered("x", 2),
        ALICE,
    )
    got = run(spark, inputs, tmp_path)
    assert got == dict(
        total_archives=3, total_items=8, migrated=8, already_present=0, orphaned=1, skipped=0, failed=0
    )
    outbox = spark.read.text(str(tmp_path / "store" / "outbox"))
    bodies = [json.loads(r["value"]) for r in outbox.collect()]
    assert len(bodies) == 8
    one = next(m for m in bodies if m["source"]["itemId"] == "a1-item-0")
    assert one["idempotencyKey"] == "ev:vault-1:a1:a1-item-0"
    assert one["retention"] == {"category": "Standard-7Y", "expiresUtc": "2030-06-01T00:00:00.000000Z"}
    assert one["content"] == {
        "parts": [{"partId": "part-1", "sha256": b.sha(b"one"), "sizeBytes": 3}]
    }
    marks = readers.read_checkpoints(spark, str(tmp_path / "store" / "checkpoints"), "run-1")
    last = state.latest_checkpoint(marks).first()
    assert json.loads(last["metadata"]) == {"processedCount": 8} and last["phase"] == "Ingest"


def test_one_rejected_item(spark, tmp_path):
    rows = numbered("archive-1", 5)
    rows[2]["content_part_ids"] = ["part-1", "missing"]
    got = run(spark, b.inputs(spark, [b.archive()], rows, ALICE), tmp_path)
    assert (got["migrated"], got["failed"], got["total_items"]) == (4, 1, 5)
    audit = readers.read_audit(spark, str(tmp_path / "store" / "audit"), "run-1", ["ItemPermanentFailed"])
    body = json.loads(audit.first()["payload"])
    assert body["errorCode"] == "BLOB_NOT_FOUND" and "'missing'" in body["message"]
    rows = spark.read.parquet(str(tmp_path / "store" / "records"))
    assert {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()} == {
        "Migrated": 4,
        "Failed": 1,
    }


def test_second_run_finds_everything(spark, tmp_path):
    inputs = b.inputs(spark, [b.archive()], numbered("archive-1", 5), ALICE)
    assert run(spark, inputs, tmp_path)["migrated"] == 5
    again = run(spark, inputs, tmp_path, run_id="run-2")
    assert (again["migrated"], again["already_present"], again["failed"]) == (0, 5, 0)
    assert len(records(spark, tmp_path)) == 5


def test_same_run_again(spark, tmp_path):
    """Narrower, empty and full repeats under one run id lose and repeat nothing."""
    rows = numbered("archive-1", 5)
    for n in (3, 4):
        rows[n]["folder_path"] = "Sent"
    inputs = b.inputs(spark, [b.archive()], rows, ALICE)
    assert run(spark, inputs, tmp_path)["migrated"] == 5
    delivered = records(spark, tmp_path)
    sent = spark.read.text(str(tmp_path / "store" / "outbox")).count()
    for filters, present in ((MigrationFilters(folder_path="inbox"), 3), (MigrationFilters(folder_path="none"), 0), (MigrationFilters(), 5)):
        got = run(spark, inputs, tmp_path, filters=filters)
        assert (got["migrated"], got["already_present"], got["skipped"]) == (0, present, 5 - present)
        assert records(spark, tmp_path) == delivered
    assert spark.read.text(str(tmp_path / "store" / "outbox")).count() == sent == 5
    mg.compact_store(spark, str(tmp_path / "store"))
    assert records(spark, tmp_path) == delivered
    more = replace(inputs, items=b.items(spark, *rows, b.item(item_id="new")))
    assert run(spark, more, tmp_path)["migrated"] == 1
    assert set(records(spark, tmp_path)) == {*delivered, "new"}
    ids = readers.read_audit(spark, str(tmp_path / "store" / "audit")).select("id")
    assert ids.count() == ids.distinct().count()


def test_uncommitted_batch_is_never_read(spark, tmp_path, monkeypatch):
    inputs = b.inputs(spark, [b.archive()], numbered("archive-1", 3), ALICE)
    execution = mg.start_run(spark, inputs, b.options(), str(tmp_path / "store"))

    def lost(*_, **__):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as broken:
        broken.setattr(mg.Execution, "commit", lost)
        with pytest.raises(RuntimeError):
            mg.migrate_batch(execution, inputs, "one")
    assert mg.migrate_batch(execution, inputs, "one").count() == 3
    assert mg.migrate_batch(execution, inputs, "one") is None
    mg.apply_delivery(execution, accept(execution.read("classified", schemas.CLASSIFIED)))
    got = counters(mg.finish_run(execution))
    assert (got["total_items"], got["migrated"]) == (3, 3)


def test_failed_and_cancelled_runs(spark, tmp_path):
    inputs = b.inputs(spark, [b.archive()], numbered("archive-1", 2), ALICE)

    def down(ready):
        raise RuntimeError("target is down")

    with pytest.raises(RuntimeError):
        run(spark, inputs, tmp_path, down)
    store = str(tmp_path / "store")
    log = readers.read_audit(spark, f"{store}/audit")
    assert [tuple(r) for r in report.resumable_runs(report.run_list(log)).select("run_id", "status").collect()] == [("run-1", "Failed")]
    mg.cancel_run(mg.start_run(spark, inputs, b.options(run_id="run-2"), store))
    status = {r["run_id"]: r["status"] for r in report.run_list(readers.read_audit(spark, f"{store}/audit")).collect()}
    assert status == {"run-1": "Failed", "run-2": "Cancelled"}
    again = run(spark, inputs, tmp_path)
    assert (again["migrated"], again["total_items"]) == (2, 2)


def test_receipts_over_time(spark, tmp_path):
    """Transient, then delivered; permanent; one never answered; strangers change nothing."""
    inputs = b.inputs(spark, [b.archive()], numbered("archive-1", 4), ALICE)
    execution = mg.start_run(spark, inputs, b.options(), str(tmp_path / "store"))
    ready = mg.migrate_batch(execution, inputs)
    key = "ev:vault-1:archive-1:archive-1-item-{}".format

    def receipts(*rows):
        full = [(key(i), n, s, f"t{i}" if s == 200 else None, None, False, None, None, b.utc(2024, 6, 2, n)) for i, n, s in rows]
        return spark.createDataFrame(full, schemas.RECEIPTS)

    mg.apply_delivery(execution, receipts((0, 1, 503), (1, 1, 422), (2, 1, 200), (9, 1, 200)), "r1")
    queue = spark.read.parquet(execution.path("retry_queue"))
    assert [r["idempotency_key"] for r in queue.collect()] == [key(0)]
    mg.apply_delivery(execution, receipts((0, 2, 200), (2, 2, 503)), "r2")
    mg.apply_delivery(execution, receipts((0, 2, 200), (2, 2, 503)), "r2")
    assert ready.count() == 4
    got = counters(mg.finish_run(execution))
    assert (got["total_items"], got["migrated"], got["failed"]) == (4, 2, 1)
    assert records(spark, tmp_path) == {
        "archive-1-item-0": ("Migrated", "t0"),
        "archive-1-item-1": ("Failed", None),
        "archive-1-item-2": ("Migrated", "t2"),
    }
    delivered = mg.audit_of(execution).where("event_type = 'ItemMigrated'")
    assert {r["timestamp_utc"].hour for r in delivered.collect()} == {1, 2}


def test_parts_are_verified_once(spark, tmp_path):
    """A second run reads no bytes of parts known to be good, but looks at bad ones again."""
    rows = numbered("archive-1", 2)
    rows[1]["content_part_ids"] = ["part-1", "late"]  # not there at all at first
    first = b.inputs(spark, [b.archive()], rows, ALICE)
    assert run(spark, first, tmp_path)["failed"] == 1
    later = replace(
        first,
        parts=b.parts(spark, part_1=b"one", late=b"late"),
        # Other bytes of part-1 would be a wrong hash if they were read.
        blob_hashes=b.blob_hashes(spark, part_1=b"changed", late=b"late"),
    )
    again = run(spark, later, tmp_path, run_id="run-2")
    assert (again["migrated"], again["already_present"], again["failed"]) == (1, 1, 0)
    hashed = spark.read.parquet(str(tmp_path / "store" / "checked_parts")).groupBy("part_id").count()
    assert {r["part_id"]: r["count"] for r in hashed.collect()} == {"part-1": 1, "late": 1}


def test_every_outcome_adds_up(spark, tmp_path):
    rows = [
        b.item(item_id="ok"),
        b.item(item_id="late", retention_category="Keep-9000Y"),
        b.item(item_id="bad", content_part_ids=["nowhere"]),
        b.item(item_id="filtered", folder_path="Sent Items"),
        b.item(item_id="blank", archive_id="no-vault"),
        b.item(item_id="held", archive_id="held"),
        b.item(item_id="odd", archive_id="odd"),
        b.item(item_id="dangling", archive_id="nowhere"),
        b.item(item_id="empty", content_part_ids=[]),
    ]
    archives = [
        b.archive(),
        b.archive(archive_id="no-vault", vault_store=" "),
        b.archive(archive_id="held", legal_hold=True),
        b.archive(archive_id="odd", type="Other", owner_upn=None),
    ]
    inputs = b.inputs(spark, archives, rows, ALICE)
    got = run(spark, inputs, tmp_path, filters=MigrationFilters(folder_path="inbox"))
    assert got["total_items"] == 7 == sum(got[c] for c in ("migrated", "already_present", "skipped", "failed"))
    assert (got["migrated"], got["skipped"], got["failed"]) == (2, 1, 4)
    audit = readers.read_audit(spark, str(tmp_path / "store" / "audit"), "run-1")
    events = {r["item_id"]: (r["event_type"], json.loads(r["payload"])) for r in audit.where("item_id is not null").collect()}
    assert events["late"][1]["error"] == "ArgumentOutOfRangeException"
    assert events["blank"][1]["error"] == "ArgumentException"
    assert events["odd"][0] == "ItemUnexpectedError"
    assert events["filtered"][1] == {"archiveId": "archive-1", "reason": "SkippedByFilter"}
    held = audit.where("event_type = 'ArchiveLegalHoldRetained'").collect()
    assert [json.loads(r["payload"]) for r in held] == [{"archiveId": "held"}]
    classified = spark.read.parquet(str(tmp_path / "store" / "classified"))
    assert [r["item_id"] for r in mg.rejects(classified).collect()] == ["blank"]


def test_hold_migrate_keeps_the_flag(spark):
    inputs = b.inputs(spark, [b.archive(legal_hold=True)], [b.item()], ALICE)
    plan = mg.plan_migration(spark, inputs, b.options(legal_hold=MIGRATE))
    assert plan.messages().first()["legalHold"] is True
    kept = mg.plan_migration(spark, inputs, b.options())
    assert kept.items.count() == 0


def test_own_steps(spark):
    from vaultferry.operators.rehydrate import check_refs, verify_parts
    from vaultferry.operators.transform import build_messages

    def trusting(refs, parts, blobs):
        checked = check_refs(refs, verify_parts(parts, blobs))
        return checked.withColumn("error", F.lit(None).cast("string"))

    def short(items, lists, options):
        return build_messages(items, lists, options).select("idempotencyKey", "archiveClass")

    own = Extensions(
        extra_rules=(("Too old.", F.col("sent_date_utc") < F.lit("2020-01-01").cast("timestamp")),),
        check_parts=trusting,
        build_messages=short,
    )
    rows = [
        b.item(item_id="old", sent_date_utc=b.utc(2019, 1, 1)),
        b.item(item_id="new", content_part_ids=["gone"]),
    ]
    inputs = b.inputs(spark, [b.archive()], rows, ALICE)
    plan = mg.plan_migration(spark, inputs, b.options(extensions=own))
    events = {r["item_id"]: (r["event_type"], r["reason"]) for r in plan.items.collect()}
    assert events["old"] == ("ItemSkipped", "Too old.")
    assert events["new"][0] == mg.DELIVER
    assert plan.messages().columns == ["idempotencyKey", "archiveClass"]


def test_dry_run_delivers_nothing(spark, tmp_path):
    inputs = b.inputs(spark, [b.archive()], numbered("archive-1", 3), ALICE)
    got = run(spark, inputs, tmp_path, dry_run=True)
    assert got["migrated"] == 3
    store = tmp_path / "store"
    assert not (store / "outbox").exists() and not (store / "records").exists()
    assert spark.read.parquet(str(store / "checked")).count() == 3
    real = run(spark, inputs, tmp_path, run_id="run-2")
    assert (real["migrated"], real["already_present"]) == (3, 0)


def test_receipts_given(spark):
    inputs = b.inputs(spark, [b.archive()], numbered("archive-1", 5), ALICE)
    statuses = ["Ingested", "AlreadyPresent", "TransientError", "PermanentError"]
    rows = [
        (f"ev:vault-1:archive-1:archive-1-item-{i}", s, f"t{i}" if i < 2 else None, None if i < 2 else "X")
        for i, s in enumerate(statuses)
    ]
    results = spark.createDataFrame(
        rows, "idempotency_key string, ingest_status string, target_id string, error_code string"
    )
    plan = mg.plan_migration(spark, inputs, b.options(), results)
    events = {r["item_id"][-1]: r["event_type"] for r in plan.items.collect()}
    assert events == {
        "0": "ItemMigrated",
        "1": "ItemMigrated",
        "2": "ItemTransientFailed",
        "3": "ItemPermanentFailed",
        "4": mg.DELIVER,
    }
    audit = {r["item_id"][-1]: json.loads(r["payload"]) for r in plan.audit.where("item_id is not null").collect()}
    assert audit["1"] == {"archiveId": "archive-1", "targetId": "t1", "status": "AlreadyPresent"}
    assert audit["2"] == {"archiveId": "archive-1", "errorCode": "X"} and "4" not in audit
    entries = mg.record_entries(plan.items, b.options())
    assert entries.schema.names == schemas.RECORDS.names and entries.count() == 4
    done = plan.audit.where("event_type = 'RunCompleted'").first()
    assert json.loads(done["payload"])["totalItems"] == 5


def test_nothing_to_do(spark, tmp_path):
    inputs = b.inputs(spark, [b.archive(legal_hold=True)], [b.item()], ALICE)
    got = run(spark, inputs, tmp_path)
    assert got == dict(
        total_archives=1, total_items=0, migrated=0, already_present=0, orphaned=0, skipped=0, failed=0
    )


def test_stream_equals_batch(spark, tmp_path):
    rows = numbered("archive-1", 6)
    rows[1]["content_part_ids"] = ["gone"]
    inputs = b.inputs(spark, [b.archive()], rows, ALICE)
    files = tmp_path / "in"
    for n in range(2):
        b.items(spark, *rows[3 * n : 3 * n + 3]).coalesce(1).write.mode("append").parquet(str(files))
    stream = spark.readStream.schema(schemas.ITEMS).option("maxFilesPerTrigger", 1).parquet(str(files))
    args = (str(tmp_path / "stream"), str(tmp_path / "checkpoint"))
    options = b.options()
    keys = [f"ev:vault-1:archive-1:archive-1-item-{n}" for n in range(6)]
    ready = spark.createDataFrame([(k, k[-1]) for k in keys], "idempotency_key string, item_id string")
    came = tmp_path / "receipts"
    accept(ready).repartition(2).write.parquet(str(came))
    receipts = readers.read_receipts(spark, str(came), stream=True, maxFilesPerTrigger="1")
    streamed = counters(jobs.stream_migration(spark, stream, inputs, options, *args, receipts))
    assert streamed == run(spark, inputs, tmp_path)
    marks = readers.read_checkpoints(spark, str(tmp_path / "stream" / "checkpoints"))
    assert marks.count() == 4
    checked = spark.read.parquet(str(tmp_path / "stream" / "checked"))
    assert checked.count() == 6 and checked.select("batch_id").distinct().count() == 2

    # Stopped and started again: only the new file is read.
    b.items(spark, b.item(item_id="more")).coalesce(1).write.mode("append").parquet(str(files))
    again = counters(jobs.stream_migration(spark, stream, inputs, options, *args, receipts))
    assert (again["total_items"], again["migrated"]) == (7, 5)


def test_dedup_within_watermark(spark, tmp_path):
    rows = [(f"k{n % 5}", b.utc(2024, 1, 1, 0, n)) for n in range(20)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "idempotency_key string, at timestamp").write.parquet(path)
    stream = spark.readStream.schema("idempotency_key string, at timestamp").parquet(path)
    out = str(tmp_path / "out")
    jobs.drain(
        jobs.dedup_within_watermark(stream, "at", "1 hour"),
        lambda batch, n: batch.write.mode("append").parquet(out),
        str(tmp_path / "checkpoint"),
    )
    assert spark.read.parquet(out).count() == 5


def test_dedup_keys_over_batches(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "idempotency_key string, n int"
    for n in range(3):
        rows = [(f"k{i}", n) for i in range(n, n + 4)] * 3
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    kept = jobs.dedup_keys(spark, stream, ["n"], out, str(tmp_path / "checkpoint"))
    got = kept.groupBy("idempotency_key").agg(F.count("*").alias("n")).collect()
    assert {r["idempotency_key"]: r["n"] for r in got} == {f"k{i}": 1 for i in range(6)}
