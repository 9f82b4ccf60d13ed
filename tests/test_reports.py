import json

import pytest
from pyspark.sql import functions as F

from tests import build as b
from vaultferry import schemas
from vaultferry.operators import audit as au
from vaultferry.operators import quality, reconcile, report
from vaultferry.sinks import writers
from vaultferry.sources import readers


def events(spark, *rows):
    """(event type, minute, item, payload, run)"""
    full = [
        dict(
            id=f"{run}-{n:03}",
            timestamp_utc=b.utc(2024, 1, 1, 10, minute),
            event_type=kind,
            item_id=item,
            payload=json.dumps(payload),
            run_id=run,
        )
        for n, (kind, minute, item, payload, run) in enumerate(rows)
    ]
    return b.frame(spark, full, schemas.AUDIT)


def test_summary_takes_the_first_completion(spark):
    log = events(
        spark,
        ("RunStarted", 0, None, {}, "r"),
        ("RunCompleted", 5, None, {"migrated": 3, "totalItems": 4}, "r"),
        ("RunStarted", 6, None, {}, "r"),
        ("RunCompleted", 9, None, {"migrated": 0, "totalItems": 4}, "r"),
        ("RunStarted", 1, None, {}, "open"),
    )
    rows = {r["run_id"]: r for r in report.run_summary(log).collect()}
    assert (rows["r"]["migrated"], rows["r"]["total_items"], rows["r"]["failed"]) == (3, 4, 0)
    assert rows["r"]["finished_at_utc"].minute == 5
    assert rows["open"]["finished_at_utc"] is None and rows["open"]["migrated"] == 0
    last = report.run_summary(log, latest=True).where("run_id = 'r'").first()
    assert (last["migrated"], last["started_at_utc"].minute, last["finished_at_utc"].minute) == (0, 0, 9)


def test_run_status(spark):
    log = events(
        spark,
        ("RunStarted", 0, None, {}, "done"),
        ("RunCompleted", 0, None, {}, "done"),
        ("RunStarted", 1, None, {}, "again"),
        ("RunFailed", 2, None, {}, "again"),
        ("RunStarted", 3, None, {}, "again"),
        ("RunStarted", 4, None, {}, "stopped"),
        ("RunCancelled", 5, None, {}, "stopped"),
    )
    runs = report.run_list(log)
    assert {r["run_id"]: r["status"] for r in runs.collect()} == {
        "done": "Completed",
        "again": "Running",
        "stopped": "Cancelled",
    }
    kpis = report.run_kpis(runs).first()
    assert tuple(kpis) == (3, 1, 1, 33)
    assert [r["run_id"] for r in report.resumable_runs(runs).collect()] == ["stopped"]
    assert [r["run_id"] for r in report.recent_runs(runs, 2).collect()] == ["stopped", "again"]
    assert report.last_completed_run(runs).first()["run_id"] == "done"
    assert {r["run_id"] for r in report.filter_runs(runs, "RUN").collect()} == {"again"}
    moved = {(r["run_id"], r["status"]) for r in report.status_changes(log).collect()}
    assert moved == {("done", "Completed"), ("again", "Failed")}
    empty = report.run_kpis(runs.where("false")).first()
    assert tuple(empty) == (0, 0, 0, 0)


@pytest.mark.parametrize("done, total, rate", [(1, 8, 13), (1, 3, 33), (2, 3, 67), (1, 200, 1)])
def test_success_rate_rounds_half_up(spark, done, total, rate):
    rows = [(str(n), "Completed" if n < done else "Failed") for n in range(total)]
    runs = spark.createDataFrame(rows, "run_id string, status string")
    assert report.run_kpis(runs).first()["success_rate"] == rate


def test_search(spark):
    log = events(
        spark,
        ("ItemMigrated", 0, "EV-1", {}, "r"),
        ("ItemSkipped", 0, "ev-2", {}, "r"),
        ("RunStarted", 0, None, {}, "r"),
    )

    def found(*args):
        return sorted(r["event_type"] for r in au.search_events(log, *args).collect())

    assert found("ev-") == ["ItemMigrated", "ItemSkipped"]
    assert found("ev-", "ItemSkipped") == ["ItemSkipped"]
    assert found("started") == ["RunStarted"]
    assert len(found("")) == 3
    assert tuple(au.filtered_ratio(log, "item").first()) == (2, 3)
    assert [r[0] for r in au.event_types(log).collect()] == ["ItemMigrated", "ItemSkipped", "RunStarted"]


def test_histogram(spark):
    log = events(
        spark,
        *[("ItemMigrated", m, "i", {}, "r") for m in (1, 1, 3)],
        ("ItemSkipped", 1, "i", {}, "r"),
    )
    running = au.cumulative_ingested(au.ingest_histogram(log)).orderBy("minute").collect()
    assert [(r["ingested"], r["cumulative"]) for r in running] == [(2, 2), (1, 3)]
    assert {r["minute_of_day"] for r in au.ingest_histogram(log, "minute_of_day").collect()} == {"10:01", "10:03"}
    with pytest.raises(ValueError):
        au.ingest_histogram(log, "hour")


def test_progress_marks(spark):
    log = events(
        spark,
        *[("ItemMigrated", n, f"i{n}", {}, "r") for n in range(5)],
        ("ItemAlreadyPresent", 1, "seen", {}, "r"),
        ("ItemPermanentFailed", 9, "bad", {}, "r"),
    )
    marks = report.progress_marks(log, 3).orderBy("processed_count").collect()
    assert [(r["item_id"], r["processed_count"]) for r in marks] == [("i2", 3), ("bad", 6)]


def test_totals(spark):
    log = events(spark, ("ItemMigrated", 0, "a", {}, "r"), ("ItemAlreadyPresent", 0, "b", {}, "r"))

    def totals(n):
        held = None if n is None else spark.range(n)
        row = reconcile.reconcile_totals(log, held).first()
        return row["target_total"], row["missing"], row["unexpected"], row["is_clean"]

    assert totals(2) == (2, 0, 0, True)
    assert totals(1) == (1, 1, 0, False)
    assert totals(5) == (5, 0, 3, False)
    assert totals(None) == (-1, 0, 0, False)


def test_item_reconciliation(spark):
    schema = "idempotency_key string, target_archive string, legal_hold boolean"
    ours = spark.createDataFrame([("a", "t", True), ("b", "t", True), ("c", "t", True), ("d", "t", True)], schema)
    theirs = spark.createDataFrame([("b", "u", False), ("c", "t", True), ("d", "t", True), ("e", "t", True)], schema)
    lists = "idempotency_key string, pos int, sha256 string"
    left = spark.createDataFrame([("c", 0, "x"), ("c", 1, "y"), ("d", 0, "x")], lists)
    right = spark.createDataFrame([("c", 0, "y"), ("c", 1, "x"), ("d", 0, "x")], lists)
    found = reconcile.reconcile_items(ours, theirs, left, right)
    assert {tuple(r) for r in found.collect()} == {
        ("a", "missing", ""),
        ("b", "mismatched", "target_archive,legal_hold"),
        ("c", "mismatched", "parts"),
        ("e", "unexpected", ""),
    }
    assert tuple(reconcile.reconciliation_verdict(found).first()) == (1, 1, 2, False)
    assert reconcile.reconciliation_verdict(found.where("false")).first()["is_clean"]


def test_constraints(spark):
    rows = [
        b.archive(archive_id="a"),
        b.archive(archive_id="a"),
        b.archive(archive_id="b", type="Public", vault_store="v" * 201),
    ]
    loose = spark.createDataFrame(
        [(r["archive_id"], r["type"], None, r["legal_hold"], r["vault_store"]) for r in rows]
        + [("c", None, None, None, "v")],
        "archive_id string, type string, owner_upn string, legal_hold boolean, vault_store string",
    )
    got = {tuple(r) for r in quality.check_constraints(loose, quality.ARCHIVE_RULES).collect()}
    assert got == {
        ("a", "unique:archive_id"),
        ("b", "domain:type"),
        ("b", "max_length:vault_store"),
        ("c", "required:type"),
        ("c", "required:legal_hold"),
    }


@pytest.mark.parametrize(
    "rules, schema",
    [
        (quality.ARCHIVE_RULES, schemas.ARCHIVES),
        (quality.ITEM_RULES, schemas.ITEMS),
        (quality.PART_RULES, schemas.PARTS),
        (quality.RECORD_RULES, schemas.RECORDS),
        (quality.AUDIT_RULES, schemas.AUDIT),
        (quality.CHECKPOINT_RULES, schemas.CHECKPOINTS),
    ],
)
def test_rules_name_real_columns(rules, schema):
    named = {*rules.key, *rules.required, *rules.max_length, *rules.domain}
    assert named <= set(schema.names)


def test_transitions(spark):
    steps = ["Discovered", "Mapped", "Rehydrated", "Transformed", "Ingesting", "Failed", "Rehydrated", "Migrated"]
    history = spark.createDataFrame([("k", s, n) for n, s in enumerate(steps)], "key string, status string, n int")
    found = quality.illegal_transitions(history, ["n"]).collect()
    assert [(r["previous_status"], r["status"]) for r in found] == [("Rehydrated", "Migrated")]


def test_exports(spark, tmp_path):
    log = events(
        spark,
        ("ItemMigrated", 2, "second", {"a": 'say "hi", ok'}, "r"),
        ("RunStarted", 1, None, {}, "r"),
        ("ItemMigrated", 1, "other", {}, "s"),
    )
    writers.export_audit_csv(log, "r", str(tmp_path / "csv"))
    files = sorted((tmp_path / "csv").glob("part-*.csv"))
    lines = [line for f in files for line in f.read_text().splitlines()]
    assert lines[0] == "Id,TimestampUtc,EventType,ItemId,Payload,RunId"
    body = [line for line in lines if not line.startswith("Id,")]
    assert body[0].startswith("r-001,2024-01-01T10:01:00.000000Z,RunStarted,,{}")
    assert body[1].endswith('"{""a"": ""say \\\\""hi\\\\"", ok""}",r') or '""say' in body[1]

    writers.export_audit_json(log, "r", str(tmp_path / "json"))
    objects = [
        json.loads(line)
        for f in sorted((tmp_path / "json").glob("part-*.json"))
        for line in f.read_text().splitlines()
    ]
    assert [o["eventType"] for o in objects] == ["RunStarted", "ItemMigrated"]
    assert "itemId" not in objects[0] and objects[1]["itemId"] == "second"
    assert json.loads(objects[1]["payload"]) == {"a": 'say "hi", ok'}


def test_csv_round_trip_keeps_quotes(spark, tmp_path):
    log = events(spark, ("ItemMigrated", 2, 'a"b,c\\', {"a": 'x"y\\'}, "r"))
    writers.export_audit_csv(log, "r", str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, quote='"', escape='"').first()
    original = log.first()
    assert (back["ItemId"], back["Payload"]) == (original["item_id"], original["payload"])


def test_run_filter_prunes_folders(spark, tmp_path, capsys):
    log = events(spark, ("ItemMigrated", 0, "a", {}, "r"), ("ItemMigrated", 0, "b", {}, "s"))
    path = str(tmp_path / "audit")
    writers.append_audit(log, path)
    read = readers.read_audit(spark, path, "r")
    read.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(run_id" in plan
    assert [r["item_id"] for r in read.collect()] == ["a"]


def test_compaction(spark, tmp_path):
    from tests.test_delivery import record

    log = b.frame(spark, [record("k", 1, target="x"), record("k", 2, target="y")], schemas.RECORDS)
    writers.append_records(log, str(tmp_path / "log"), "0")
    writers.compact_records(readers.read_records(spark, str(tmp_path / "log")), str(tmp_path / "new"))
    row = readers.read_records(spark, str(tmp_path / "new"), "Migrated").first()
    assert (row["target_id"], row["attempt_count"]) == ("y", 2)


def test_item_lists_as_json_text(spark, tmp_path):
    rows = b.items(spark, b.item(cc=["x", "y"]))
    stored = rows.withColumns({c: F.to_json(c) for c in readers.LIST_COLUMNS})
    stored.write.parquet(str(tmp_path / "items"))
    back = readers.read_items(spark, str(tmp_path / "items"), json_lists=True)
    assert back.first().asDict() == rows.first().asDict()


def test_absent_target(spark, tmp_path):
    assert readers.read_target_registry(spark, str(tmp_path / "x"), str(tmp_path / "y")) == (None, None)
