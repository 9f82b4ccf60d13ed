"""Steps that once grew faster than their tables, or ran in one task."""

import glob
import json
import os

import pyarrow as pa
from pyspark.sql import functions as F

from vaultferry import fixtures as fx
from vaultferry.functions.hashing import content_hash, packed_hash, unpacked_hash
from vaultferry.operators import ingest
from vaultferry.session import stored
from vaultferry.sinks import outbox_sink as sink
from vaultferry.sinks import writers
from vaultferry.streaming import answers as an


def test_a_full_slice_comes_in_several_files_of_one_batch(spark, tmp_path, monkeypatch):
    """All but one row at one time: the large slice is dealt out, each slice stays one batch."""
    monkeypatch.setattr(fx, "FILE_ROWS", 100)
    at = F.timestamp_micros(F.when(F.col("id") == 0, 600).otherwise(0))
    rows = spark.range(0, 501, numPartitions=4).select("id", at.alias("at"))
    last = [F.lit(-1).cast("bigint").alias("id"), F.timestamp_micros(F.lit(9000)).alias("at")]
    stream, _ = fx.arriving(rows, "at", last=last)
    seen = []
    writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp"))
    writer = writer.foreachBatch(
        lambda b, _: seen.append((b.count(), b.select(F.input_file_name()).distinct().count()))
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    assert [n for n, _ in seen] == [500, 0, 0, 0, 0, 1, 0, 1]
    assert seen[0][1] == 5


def test_a_join_of_streams_has_one_state_store_a_task(spark, tmp_path):
    sent = spark.createDataFrame([("k", 1704067200)], "idempotency_key string, t bigint").select(
        "idempotency_key", F.timestamp_seconds("t").alias("sent_at")
    )
    came = sent.select(
        "idempotency_key", F.col("sent_at").alias("at_utc"), F.lit(200).alias("http_status"),
        F.lit(None).cast("string").alias("exception"), F.lit(False).alias("already_present"),
    )
    streams = []
    for name, rows in (("sent", sent), ("came", came)):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(rows.schema).parquet(str(tmp_path / name)))
    got = an.drain_answers(*streams, "2 hours", "1 hour", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r["event_type"] for r in got.collect()] == ["ItemMigrated"]
    stores = glob.glob(str(tmp_path / "cp" / "state" / "*" / "0" / "*"))
    assert not [s for s in stores if "keyToNumValues" in s or "keyWithIndexToValue" in s]


def test_packed_hashes_are_half_as_long_and_come_back(spark):
    texts = ["ab" * 32, "AB" * 32, "xy" * 32, "é" * 32, "ab" * 31, "a" * 31, "", "\x01", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed_hash(F.col("t")).alias("p"))
    got = rows.select("t", unpacked_hash(F.col("p")).alias("u"), F.octet_length("p").alias("n")).collect()
    assert all(r["t"] == r["u"] for r in got)
    assert got[0]["n"] == 33
    assert rows.select("p").distinct().count() == len(texts)


def test_a_kept_batch_is_judged_once(spark, capsys):
    """Rollup and new records are read from the kept rows: no message is shuffled for them again."""
    key = F.concat(F.lit("k"), F.col("id") % 40)
    messages = spark.range(60).select(
        key.alias("idempotency_key"), F.col("id").alias("seq"), F.lit("t").alias("target_archive")
    )
    parts = spark.range(50).select(
        key.alias("idempotency_key"), F.col("id").alias("seq"), F.lit(0).alias("pos"),
        F.lit("p").alias("part_id"), content_hash(F.concat(F.lit("h"), F.col("id") % 25)).alias("sha256"),
        F.lit(1).cast("bigint").alias("size_bytes"),
    )
    kept = []

    def keep(table, rows):
        kept.append(table)
        return stored(rows, table)

    plain = ingest.ingest_batch(messages, parts)
    result = ingest.ingest_batch(messages, parts, keep=keep)
    assert kept == ["winners", "part_store", "judged"]
    for name in ("part_rollup", "new_records"):
        frame = getattr(result, name)
        capsys.readouterr()
        frame.explain()
        assert "Exchange" not in capsys.readouterr().out
    for name in ("receipts", "new_records", "new_parts", "part_rollup"):
        left, right = getattr(result, name), getattr(plain, name)
        assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_outbox_text_is_packed(spark, tmp_path):
    lines = spark.range(200).select(
        F.lit("user_mailbox").alias("archive_class"),
        F.concat(F.lit('{"k":'), "id", F.lit("}")).alias("message"),
    )
    path = str(tmp_path / "outbox")
    for _ in range(2):
        writers.write_outbox_lines(lines, path, "0")
    files = glob.glob(f"{path}/batch_id=0/archive_class=user_mailbox/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    assert sorted(json.loads(r["value"])["k"] for r in spark.read.text(path).collect()) == list(range(200))


def test_outbox_files_are_written_and_read_in_runs(tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "RUN_BYTES", 50)
    path = str(tmp_path / "outbox")
    rows = [(None if n % 3 else "é", f'{{"n":{n},"t":" \\n"}}') for n in range(40)]
    classes, texts = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(classes)], ["message", "archive_class"])
    done = sink.write_record_batches(path, iter([batch, batch]))
    assert done.rows == 80 and done.bytes == os.path.getsize(f"{path}/data/{done.file}")
    found = list(sink.OutboxReader(path).read(sink.Listed("b", done.file, done.sha256)))
    assert len(found) > 10
    assert [(r["archive_class"], r["message"]) for b in found for r in b.to_pylist()] == rows + rows
