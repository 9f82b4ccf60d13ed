"""Digest trees, key indexes, sketches, and finished and open windows."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests import build as b
from tests.test_run import ALICE, numbered, run
from tests.test_streams import T0, arrive
from vaultferry import schemas
from vaultferry.operators import digest_tree as dt
from vaultferry.operators import key_index as ki
from vaultferry.operators import reconcile, search_index
from vaultferry.operators.audit import search_events
from vaultferry.plans import migration as mg
from vaultferry.streaming import windows

SIDE = "idempotency_key string, target_archive string, legal_hold boolean"
PART = "idempotency_key string, pos bigint, sha256 string"


def sides(spark):
    ours = [(f"k{n}", f"t{n % 3}", n % 5 == 0) for n in range(400)]
    theirs = [r for r in ours if r[0] not in ("k7", "k8")] + [("new", None, None)]
    theirs = [(k, None if k == "k9" else t, h) for k, t, h in theirs]
    parts = [(f"k{n}", p, f"s{p}") for n in range(400) for p in range(2)]
    other = [(k, p, "x" if (k, p) == ("k11", 1) else s) for k, p, s in parts]
    return [spark.createDataFrame(r, s) for r, s in ((ours, SIDE), (theirs, SIDE), (parts, PART), (other, PART))]


def test_only_differing_buckets_are_joined(spark):
    ours, theirs, parts, other = sides(spark)
    for args in ((ours, theirs), (ours, theirs, parts, other)):
        want = sorted(tuple(r) for r in reconcile.reconcile_items(*args).collect())
        assert sorted(tuple(r) for r in dt.reconcile_by_digest(*args).collect()) == want
    nodes = dt.differing_buckets(dt.digest_tree(ours), dt.digest_tree(theirs))
    keys = spark.createDataFrame([("k7",), ("k8",), ("k9",), ("new",)], "k string")
    assert nodes == sorted({r[0] for r in keys.select(dt.bucket_of(F.col("k"))).collect()})


def test_equal_sides_join_nothing(spark, tmp_path):
    ours, _, parts, _ = sides(spark)
    tree = str(tmp_path / "tree")
    dt.digest_tree(ours, parts).write.parquet(tree)
    stored = spark.read.parquet(tree)
    assert stored.where("level = 4").count() == 1
    again = ours.repartition(7).orderBy("legal_hold")
    assert dt.differing_buckets(dt.digest_tree(again, parts), stored) == []
    found = dt.reconcile_by_digest(again, ours, parts, parts, stored)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 0 and "Join" not in plan
    empty = ours.limit(0)
    assert dt.reconcile_by_digest(empty, empty).count() == 0


def test_index_never_misses_a_key(spark):
    keys = [f"key-{n}" for n in range(5000)]
    frames = [spark.createDataFrame([(k,) for k in keys[n::5]], "idempotency_key string") for n in range(5)]
    index = None
    for n, f in enumerate(frames):
        rows = ki.key_index(f).withColumn("batch_id", F.lit(str(n)))
        index = rows if index is None else index.unionByName(rows)
    index = spark.createDataFrame(index.collect(), index.schema)
    for n in (0, 3, 4999):
        one = spark.createDataFrame([(keys[n],), (None,)], "idempotency_key string")
        assert str(n % 5) in {r[0] for r in ki.candidate_batches(index, one).collect()}
    strange = spark.createDataFrame([(f"key-{n}x",) for n in range(40)], "idempotency_key string")
    hits = sum(ki.candidate_batches(index, strange.where(F.col("idempotency_key") == f"key-{n}x")).count() for n in range(10))
    assert hits <= 15
    assert ki.key_index(frames[0].limit(0)).count() == 0


def test_new_keys_open_no_record_file(spark, tmp_path):
    inputs = b.inputs(spark, [b.archive()], numbered("archive-1", 4), ALICE)
    assert run(spark, inputs, tmp_path)["migrated"] == 4
    execution = mg.start_run(spark, inputs, b.options(run_id="run-2"), str(tmp_path / "store"))

    def found(*keys):
        asked = spark.createDataFrame([(k,) for k in keys], "idempotency_key string")
        return mg.records_with(execution, asked)

    assert found("ev:vault-1:archive-1:never", "zzz").count() == 0
    assert found("ev:vault-1:archive-1:archive-1-item-2", "zzz").count() == 1
    # Pruning is by folder: with all batches ruled out, no file is left to scan.
    log = mg.read_committed(spark, execution.root, "records", schemas.RECORDS)
    index = mg.read_committed(spark, execution.root, "key_index", ki.INDEX)
    batches = [r[0] for r in index.select("batch_id").distinct().collect()]
    stranger = spark.createDataFrame([("zzz",)], "idempotency_key string")
    pruned = ki.prune(log, index, stranger, batches)
    assert pruned.count() == 0 and log.count() == 4
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*NOT \(?batch_id", plan)
    again = run(spark, inputs, tmp_path, run_id="run-3")
    assert (again["already_present"], again["migrated"]) == (4, 0)


def test_sketches_are_united(spark):
    rows = spark.range(20000).select(F.sha2((F.col("id") % 7000).cast("string"), 256).alias("sha256"))
    sketches = None
    for n in range(3):
        one = reconcile.part_sketch(rows.where(F.pmod(F.xxhash64("sha256"), F.lit(3)) == n))
        sketches = one if sketches is None else sketches.unionByName(one)
    sketches = sketches.unionByName(reconcile.part_sketch(rows.limit(0)))
    got = reconcile.target_stats_approx(sketches).first()
    assert got["parts"] == 20000 and abs(got["unique_parts"] - 7000) < 0.02 * 7000


def test_many_differing_buckets(spark, monkeypatch):
    """Joined with the list instead of named in a filter: the rows are the same."""
    ours, theirs, _, _ = sides(spark)
    want = sorted(tuple(r) for r in reconcile.reconcile_items(ours, theirs).collect())
    monkeypatch.setattr(dt, "FEW", 0)
    assert sorted(tuple(r) for r in dt.reconcile_by_digest(ours, theirs).collect()) == want


@pytest.mark.parametrize("gap", [1, 7])
def test_finished_windows_are_written_once(spark, tmp_path, gap):
    minute = timedelta(minutes=1)
    batches = [[("ItemMigrated", "r", T0 + (n * gap + k % 5) * minute) for k in range(20)] for n in range(5)]
    schema = "event_type string, run_id string, timestamp_utc timestamp"
    stream = arrive(spark, tmp_path / "in", schema, batches)
    from vaultferry.streaming.jobs import ingest_rate

    rate = ingest_rate(stream, "3 minutes")
    out = str(tmp_path / "out")
    got = windows.drain_windows(rate, ["run_id", "minute"], "minute", "1 minute", "3 minutes", out, str(tmp_path / "cp"))
    seen = {(r["minute"]): r["ingested"] for r in got.collect()}
    want = {}
    for batch in batches:
        for _, _, at in batch:
            want[at.replace(tzinfo=None)] = want.get(at.replace(tzinfo=None), 0) + 1
    assert sum(seen.values()) == sum(want.values()) and len(seen) == got.count() == len(want)
    final = spark.read.parquet(f"{out}/final")
    assert final.count() == final.select("minute").distinct().count() > 0


def test_search_opens_only_batches_that_may_match(spark, tmp_path):
    rows = [(f"b{n % 4}", f"Itm-{n % 4}-{n}", "ItemMigrated" if n % 3 else "ItemSkipped") for n in range(200)]
    rows += [("b4", None, "RunStarted"), ("b5", "x", None), ("b6", "\u0130stanbul-9", "ItemSkipped")]
    path, spec = str(tmp_path / "log"), "batch_id string, item_id string, event_type string"
    spark.createDataFrame(rows, spec).write.partitionBy("batch_id").parquet(path)
    log = spark.read.schema(spec).parquet(path)
    index = search_index.trigram_index(log)
    index = index.union(index.where("batch_id = 'b1'"))  # a batch indexed twice
    opened = {
        "itm-2-": {"b2"}, "ITM-3-1": {"b3"}, "started": {"b4"}, "\u0130stan": {"b6"}, "absent": set(),
    }
    for text in (*opened, "", "x", "9", "item", "m-1-1"):
        for kind in (None, "ItemMigrated"):
            found = search_index.indexed_search(log, index, text, kind)
            names = ("batch_id", "item_id", "event_type")
            want = search_events(log, text, kind).select(*names).collect()
            assert sorted(map(repr, found.select(*names).collect())) == sorted(map(repr, want))
        files = search_index.indexed_search(log, index, text)._jdf.queryExecution().executedPlan()
        assert "PartitionFilters" in files.toString()
        if text in opened:
            gone = {r[0] for r in search_index.ruled_out(index, text).collect()}
            assert {f"b{n}" for n in range(7)} - gone == opened[text]
    # A batch that nobody indexed is opened.
    part = index.where("batch_id <> 'b2'")
    assert search_index.indexed_search(log, part, "itm-2-").count() == 50
    assert search_index.indexed_search(log, index.limit(0), "itm-2-").count() == 50
    assert search_index.indexed_search(log.limit(0), index, "itm").count() == 0
