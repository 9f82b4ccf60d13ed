from pyspark.sql import functions as F

from tests import build as b
from vaultferry import schemas
from vaultferry.operators import rehydrate as rh
from vaultferry.operators.transform import build_messages
from vaultferry.sources import readers


def run(spark, ids, parts, blobs):
    items = b.items(spark, b.item(content_part_ids=ids))
    verified = rh.verify_parts(parts, blobs)
    checked = rh.check_refs(rh.part_refs(items), verified)
    result = rh.with_content(items, rh.item_content(checked))
    return checked, rh.with_error_detail(result, checked).first()


def test_repeats_are_kept(spark):
    checked, row = run(
        spark, ["part-1"] * 3, b.parts(spark, part_1=b"x"), b.blob_hashes(spark, part_1=b"x")
    )
    assert (row["n_parts"], row["bytes"], row["error_code"]) == (3, 3, None)
    lists = rh.assemble_parts(checked).first()["parts"]
    assert [p["partId"] for p in lists] == ["part-1"] * 3


def test_order_is_kept(spark):
    contents = dict(a=b"\xaa", b=b"\xbb", c=b"\xcc")
    checked, row = run(
        spark, ["c", "a", "b"], b.parts(spark, **contents), b.blob_hashes(spark, **contents)
    )
    lists = rh.assemble_parts(checked).first()["parts"]
    assert [p["sha256"] for p in lists] == [b.sha(b"\xcc"), b.sha(b"\xaa"), b.sha(b"\xbb")]
    assert row["error_code"] is None


def test_long_lists_stay_whole(spark):
    checked, row = run(
        spark, ["part-1"] * 3001, b.parts(spark, part_1=b"x"), b.blob_hashes(spark, part_1=b"x")
    )
    lists = rh.assemble_parts(checked).collect()
    assert [len(r["parts"]) for r in lists] == [3001] and row["n_parts"] == 3001


def test_any_position_is_possible(spark):
    rows = [("i", 2**63 - 1, "a", "BLOB_NOT_FOUND"), ("i", 2**62, "b", "HASH_MISMATCH")]
    checked = spark.createDataFrame(rows, "item_id string, pos bigint, part_id string, error string")
    got = rh.item_content(checked.withColumn("size_bytes", F.lit(None).cast("bigint"))).first()
    assert (got["error_code"], got["error_pos"]) == ("HASH_MISMATCH", 2**62)


def test_wrong_hash(spark):
    wrong = b.frame(
        spark,
        [dict(part_id="part-1", sha256="0" * 64, size_bytes=1, data_ref="r")],
        schemas.PARTS,
    )
    _, row = run(spark, ["part-1"], wrong, b.blob_hashes(spark, part_1=b"x"))
    assert (row["error_code"], row["error_pos"], row["error_part"]) == ("HASH_MISMATCH", 0, "part-1")
    assert row["error_stored_sha256"] == "0" * 64 and row["error_sha256"] == b.sha(b"x")


def test_hash_case_and_size_from_metadata(spark):
    upper = b.frame(
        spark,
        [dict(part_id="part-1", sha256=b.sha(b"x").upper(), size_bytes=77, data_ref="r")],
        schemas.PARTS,
    )
    _, row = run(spark, ["part-1"], upper, b.blob_hashes(spark, part_1=b"x"))
    assert (row["error_code"], row["bytes"]) == (None, 77)


def test_first_bad_part_counts(spark):
    parts = b.parts(spark, good=b"g", noblob=b"n")
    blobs = b.blob_hashes(spark, good=b"g", nometa=b"m")
    _, row = run(spark, ["good", "nometa", "noblob"], parts, blobs)
    assert (row["error_code"], row["error_pos"], row["error_part"]) == ("PART_NOT_FOUND", 1, "nometa")
    _, row = run(spark, ["good", "noblob", "nometa"], parts, blobs)
    assert (row["error_code"], row["error_pos"]) == ("BLOB_NOT_FOUND", 1)
    _, row = run(spark, ["nowhere"], parts, blobs)
    assert (row["error_code"], row["error_part"]) == ("BLOB_NOT_FOUND", "nowhere")


def test_one_detail_row_per_item(spark):
    """Two references may share a position when positions are only sort keys."""
    refs = spark.createDataFrame([("i", 5, "x"), ("i", 5, "x"), ("j", 1, "a")], "item_id string, pos int, part_id string")
    verified = rh.verify_parts(b.parts(spark, a=b"a"), b.blob_hashes(spark, a=b"a"))
    checked = rh.check_refs(refs, verified)
    rows = rh.with_error_detail(rh.item_content(checked), checked).collect()
    got = sorted((r["item_id"], r["n_parts"], r["error_part"]) for r in rows)
    assert got == [("i", 2, "x"), ("j", 1, None)]


def test_empty_list_is_valid(spark):
    _, row = run(spark, [], b.parts(spark, a=b"a"), b.blob_hashes(spark, a=b"a"))
    assert (row["n_parts"], row["bytes"], row["error_code"], row["error_pos"]) == (0, 0, None, None)


def test_distinct_part_ids(spark):
    refs = rh.part_refs(b.items(spark, b.item(content_part_ids=["a", "b", "a"])))
    assert {r["part_id"] for r in rh.distinct_part_ids(refs).collect()} == {"a", "b"}


def test_message(spark):
    items = b.items(spark, b.item(content_part_ids=["part-1"] * 3, retention_category="Legal-7Y"))
    archive = b.archives(spark, b.archive(legal_hold=True)).withColumn(
        "target_archive", F.lit("t")
    )
    verified = rh.verify_parts(b.parts(spark, part_1=b"x"), b.blob_hashes(spark, part_1=b"x"))
    checked = rh.check_refs(rh.part_refs(items), verified)
    joined = rh.with_content(items.join(archive, "archive_id"), rh.item_content(checked))

    whole = build_messages(joined, rh.assemble_parts(checked), b.options()).first()
    assert whole["idempotencyKey"] == "ev:vault-1:archive-1:item-1"
    assert whole["legalHold"] is True and whole["archiveClass"] == "user_mailbox"
    assert whole["source"].asDict() == dict(
        system="EnterpriseVault", archiveId="archive-1", itemId="item-1", vaultStore="vault-1"
    )
    assert len(whole["content"]["parts"]) == 3
    assert whole["chainOfCustody"]["runId"] == "run-1"


def test_blob_files(spark, tmp_path):
    (tmp_path / "part-1.bin").write_bytes(b"abc")
    (tmp_path / "part 2.bin").write_bytes(b"x")
    (tmp_path / "part 3.bin").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"zzz")

    sizes = [("part-1", 3), ("part 2", 1), ("part 3", 0)]
    listing = spark.createDataFrame(sizes, "part_id string, length bigint")
    got = {tuple(r) for r in readers.read_blobs(spark, str(tmp_path), listing).collect()}
    assert got == {
        ("part-1", b.sha(b"abc"), 3),
        ("part 2", b.sha(b"x"), 1),
        ("part 3", b.sha(b""), 0),
    }


def test_identity_file(spark, tmp_path):
    from vaultferry.operators.identity import unique_map

    path = tmp_path / "mapping.json"
    path.write_text(
        '{"seed": 42,\n "mappings": [\n {"upn": "A@x", "targetArchiveId": "one"},\n'
        ' {"upn": "b@x", "targetArchiveId": "two"}, {"upn": "a@X", "targetArchiveId": "three"}]}'
    )
    entries = readers.read_identity_map(spark, str(path))
    got = {tuple(r) for r in unique_map(entries, "pos").collect()}
    assert got == {("A@X", "three"), ("B@X", "two")}


def test_identity_table(spark, tmp_path):
    path = str(tmp_path / "map")
    b.identity_map(spark, ("a@x", "t")).drop("pos").write.parquet(path)
    assert readers.read_identity_map(spark, path, "parquet").first()["target_archive"] == "t"


def test_json_lists(spark):
    df = spark.createDataFrame([('["a","b"]',), ("null",), (None,), ("[]",), ("broken",)], "x string")
    got = [r["x"] for r in readers.parse_json_lists(df, ["x"]).collect()]
    assert got == [["a", "b"], [], [], [], []]
