"""Steps of a run that once did their work more than once."""

import re
from dataclasses import replace


from tests import build as b
from vaultferry import schemas
from vaultferry.operators import rehydrate as rh
from vaultferry.plans import migration as mg

ALICE = [("alice@contoso.com", "user_mailbox:alice@contoso.com")]


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_a_second_batch_looks_its_parts_up_once(spark, tmp_path, capsys):
    """Known parts are written once per batch; committed rows are found without a join."""
    first = b.item(content_part_ids=["part-1"])
    inputs = b.inputs(spark, [b.archive()], [first], ALICE)
    late = b.item(item_id="item-2", content_part_ids=["part-1", "part-2", "part-1"])
    store = str(tmp_path / "store")
    execution = mg.start_run(spark, inputs, b.options(), store)
    assert mg.migrate_batch(execution, inputs, "one").count() == 1
    more = replace(
        inputs,
        items=b.items(spark, late),
        parts=b.parts(spark, part_1=b"one", part_2=b"two"),
        # Other bytes of part-1 would be a wrong hash if they were read.
        blob_hashes=b.blob_hashes(spark, part_1=b"changed", part_2=b"two"),
    )
    assert mg.migrate_batch(execution, more, "two").count() == 1
    known = spark.read.parquet(f"{store}/known_parts")
    found = {r["part_id"]: (r["known"], r["sha256"]) for r in known.collect()}
    assert found == {"part-1": (True, b.sha(b"one")), "part-2": (None, None)}
    log = execution.read("classified", schemas.CLASSIFIED)
    assert log.count() == 2
    plan = plan_of(log, capsys)
    assert "Join" not in plan and re.search(r"PartitionFilters: \[[^]]*batch_id", plan)
    assert execution.done("two") and not execution.done("three")


def test_known_parts_are_joined_by_their_id_alone(spark, capsys):
    """Hash and size are compared, not joined on, so no step deals the parts out anew."""
    inputs = b.inputs(spark, [], [], ALICE)
    known = spark.createDataFrame(
        [("part-1", "x", b.sha(b"one").upper(), 3, None, None), ("part-2", "x", "y", 1, None, None)],
        schemas.VERIFIED,
    )
    needed = spark.createDataFrame([("part-1",), ("part-2",)], "part_id string")
    same = mg.unchanged_parts(known, inputs, needed)
    assert [r["part_id"] for r in same.collect()] == ["part-1"]
    other = replace(inputs, parts=b.parts(spark, part_1=b"two"))
    assert mg.unchanged_parts(known, other, needed).count() == 0
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "-1")
        plan = plan_of(mg.unchanged_parts(known, inputs, needed), capsys)
    finally:
        spark.conf.set(name, before)
    assert not re.search(r"hashpartitioning\([^)]*(lower|_sha256|size)", plan)


def test_only_items_with_an_error_are_joined_for_its_detail(spark):
    checked = spark.createDataFrame(
        [
            ("i1", 0, "p0", "a", "a", 1, None), ("i1", 4, "p2", None, "b", None, "BLOB_NOT_FOUND"),
            ("i1", 2, "p1", "c", "d", 1, "HASH_MISMATCH"), ("i2", 0, "p0", "a", "a", 1, None),
        ],
        "item_id string, pos bigint, part_id string, sha256 string, stored_sha256 string, size_bytes bigint, error string",
    )
    items = spark.createDataFrame([("i1",), ("i2",), ("i3",), (None,)], "item_id string")
    whole = rh.with_content(items, rh.item_content(checked))
    got = {r["item_id"]: r for r in rh.with_error_detail(whole, checked).collect()}
    assert len(got) == 4
    one = got["i1"]
    assert (one["error_code"], one["error_pos"], one["error_part"]) == ("HASH_MISMATCH", 2, "p1")
    assert (one["error_stored_sha256"], one["error_sha256"], one["n_parts"]) == ("d", "c", 2 + 1)
    assert all(got[i]["error_part"] is None and got[i]["error_pos"] is None for i in ("i2", "i3", None))
    many = spark.range(1000).selectExpr(
        "concat('i', id) item_id", "cast(if(id % 50 = 0, 3, null) as bigint) error_pos"
    )
    joined = rh.with_error_detail(many, checked)
    assert joined.count() == 1000
    filters = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in filters
