"""Part files, the identity document and the outbox as data sources."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.build import sha
from vaultferry.sinks import outbox_sink as sink
from vaultferry.sources import identity_file as idf
from vaultferry.sources import part_files as pf

PARTS = [(f"p-{n}", bytes([n]) * (n * 1000)) for n in range(8)] + [("empty", b""), ("ü x", b"u")]


@pytest.fixture
def folder(spark, tmp_path):
    pf.register_part_files(spark)
    path = str(tmp_path / "parts")
    rows = spark.createDataFrame(PARTS, "part_id string, content binary")
    rows.repartition(3).write.format("part_files").mode("append").save(path)
    return path


def read(spark, path, n=4):
    return spark.read.format("part_files").option("partitions", n).load(path)


def test_files_without_a_listing(spark, folder):
    """Files without bytes and those in folders below are read; others are not."""
    os.makedirs(f"{folder}/below")
    with open(f"{folder}/below/deep.bin", "wb") as f:
        f.write(b"deep")
    for name in (".hidden.bin", "note.txt"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(b"no")
    got = {r["part_id"]: (r["sha256"], r["blob_bytes"]) for r in read(spark, folder).collect()}
    assert got == {p: (sha(c), len(c)) for p, c in [*PARTS, ("deep", b"deep")]}
    assert read(spark, folder).rdd.getNumPartitions() == 4
    assert read(spark, f"{folder}-none").count() == 0


def test_ids_reach_the_source(spark, folder):
    one = read(spark, folder).where("part_id in ('p-3', 'gone', '../p-1') and blob_bytes > 0")
    assert [r["part_id"] for r in one.collect()] == ["p-3"]
    assert "part_id" not in one._jdf.queryExecution().executedPlan().toString().split("Filter")[1].split("\n")[0]
    reader = pf.PartFileReader(folder, 4)
    left = list(reader.pushFilters([pf.In(("part_id",), ("p-3", "p-4")), pf.EqualTo(("part_id",), "p-3")]))
    assert left == [] and [s.names for s in reader.partitions()] == [("p-3",)]


def test_a_changed_file_has_a_new_version(spark, folder):
    before = {r["part_id"]: r["version"] for r in read(spark, folder).collect()}
    with open(f"{folder}/p-1.bin", "wb") as f:
        f.write(b"changed")
    after = {r["part_id"]: r["version"] for r in read(spark, folder).collect()}
    assert {p for p in before if before[p] != after[p]} == {"p-1"}


def test_names_stay_inside_the_folder(spark, folder):
    bad = spark.createDataFrame([("../out", b"x")], "part_id string, content binary")
    with pytest.raises(Exception, match="cannot be the name"):
        bad.write.format("part_files").mode("append").save(folder)


def messages(spark, lo, hi):
    n = F.col("id")
    text = F.concat(F.lit('{"k":"'), n, F.lit('","t":"é\\u2028\\""}'))
    return spark.range(lo, hi, numPartitions=4).select(
        F.when(n % 2 == 0, "user_mailbox").alias("archive_class"), text.alias("message")
    )


def held(spark, path):
    rows = spark.read.format("outbox").load(path).collect()
    return sorted((r["batch"], r["archive_class"] or "", r["message"]) for r in rows)


def expect(rows, batch):
    return sorted((batch, r["archive_class"] or "", r["message"]) for r in rows.collect())


def test_outbox_batches(spark, tmp_path):
    sink.register_outbox(spark)
    path = str(tmp_path / "outbox")
    assert held(spark, path) == []
    a, b = messages(spark, 0, 10), messages(spark, 10, 12)
    for rows, name in ((a, "a"), (b, "b"), (a, "a")):
        rows.write.format("outbox").mode("append").option("batch", name).save(path)
    assert held(spark, path) == sorted(expect(a, "a") + expect(b, "b"))


def test_failed_tasks_leave_no_message(spark, tmp_path):
    """One task fails after others wrote: nothing is read; the same batch again is whole."""
    sink.register_outbox(spark)
    path = str(tmp_path / "outbox")
    rows = messages(spark, 0, 40)
    fails = F.when(F.col("archive_class").isNull(), F.raise_error(F.lit("target is away")))
    broken = rows.withColumn("message", F.coalesce(fails.cast("string"), "message"))
    mixed = rows.where("archive_class is not null").union(broken.where("archive_class is null"))
    with pytest.raises(Exception, match="target is away"):
        mixed.write.format("outbox").mode("append").option("batch", "x").save(path)
    assert held(spark, path) == []
    # What a lost attempt may leave behind, without a manifest, is not read either.
    sink.write_rows(path, iter(rows.collect()))
    rows.write.format("outbox").mode("append").option("batch", "x").save(path)
    assert held(spark, path) == expect(rows, "x")


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    sink.register_outbox(spark)
    path, files = str(tmp_path / "outbox"), str(tmp_path / "in")
    for lo in (0, 10):
        messages(spark, lo, lo + 10).coalesce(1).write.mode("append").parquet(files)
    arriving = spark.readStream.schema(messages(spark, 0, 1).schema)

    def drain(checkpoint):
        stream = arriving.option("maxFilesPerTrigger", 1).parquet(files)
        writer = stream.writeStream.format("outbox").option("path", path).option("stream", "s")
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    drain(str(tmp_path / "cp"))
    once = held(spark, path)
    assert len(once) == 20 and {r[0] for r in once} == {"s-0", "s-1"}
    # The job is repeated from its first micro-batch: the manifests are replaced.
    drain(str(tmp_path / "cp-lost"))
    assert [r[1:] for r in held(spark, path)] == [r[1:] for r in once]


def test_a_changed_file_is_noticed(spark, tmp_path):
    sink.register_outbox(spark)
    path = str(tmp_path / "outbox")
    messages(spark, 0, 3).coalesce(1).write.format("outbox").mode("append").option("batch", "a").save(path)
    (name,) = os.listdir(f"{path}/data")
    with open(f"{path}/data/{name}", "a") as f:
        f.write('["x", "y"]\n')
    with pytest.raises(Exception, match="not what its manifest says"):
        held(spark, path)


STRANGE = [
    {"upn": "a@x", "targetArchiveId": 't{"upn": "no"}'},
    {"targetArchiveId": "t2", "upn": 'quote " brace } back \\ {"upn":'},
    {"note": {"deep": [1, {"x": "]}"}]}, "upn": "c@x", "targetArchiveId": "é" * 50},
    {"upn": None, "targetArchiveId": "t4"},
    {"upn": "a@x", "targetArchiveId": "later", "note": "{[" * 9},
    {"note": "]", "targetArchiveId": "t6"},
]


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_of_a_document_cover_every_entry(tmp_path, indent):
    """Wherever the file is cut, each entry is read once, in order of its offset."""
    entries = [dict(e, upn=e.get("upn") and e["upn"] + str(n)) for n in range(4) for e in STRANGE]
    path = str(tmp_path / "map.json")
    with open(path, "w") as f:
        json.dump({"version": 1, "mappings": entries, "end": [1]}, f, indent=indent, ensure_ascii=False)
    want = [(e.get("upn"), e.get("targetArchiveId")) for e in entries]
    for size in (1, 7, 50, 333, 1000, 10**6):
        reader = idf.IdentityReader(path, size)
        rows = [r for span in reader.partitions() for r in reader.read(span)]
        if size >= 50:
            assert [r[:2] for r in sorted(rows, key=lambda r: r[2])] == want
            assert len({r[2] for r in rows}) == len(want)


def test_a_long_document_has_no_tiny_ranges(tmp_path):
    """Tasks and bytes read grow with the document, not with its number of least ranges."""
    path = str(tmp_path / "map.json")
    entries = [{"upn": f"u{n}", "targetArchiveId": f"t{n}"} for n in range(20000)]
    with open(path, "w") as f:
        json.dump({"mappings": entries}, f)
    reader = idf.IdentityReader(path, 100)
    spans = reader.partitions()
    assert 8 < len(spans) <= idf.SMALL_RANGES
    rows = [r for span in spans for r in reader.read(span)]
    assert [r[:2] for r in rows] == [(e["upn"], e["targetArchiveId"]) for e in entries]
    assert len(idf.IdentityReader(path, 1 << 30).partitions()) == 1


def test_a_range_reads_little_more_than_itself(tmp_path):
    path = str(tmp_path / "map.json")
    with open(path, "w") as f:
        json.dump({"mappings": [{"upn": f"u{n}", "targetArchiveId": "t" * 200} for n in range(9000)]}, f)
    sizes = []

    class Counted:
        def __init__(self, source):
            self.source, self.seek = source, source.seek

        def read(self, size):
            data = self.source.read(size)
            sizes.append(len(data))
            return data

    span = idf.IdentityReader(path, 50000).partitions()[3]
    with open(path, "rb") as f:
        window = idf.Window(Counted(f), span.start, span.end - span.start)
        while window.at < span.end and window.grow():
            window.here = len(window.data)
    assert sum(sizes) <= 2 * 50000
    assert list(idf.IdentityReader(path, 50000).read(span))


def test_identity_documents(spark, tmp_path):
    idf.register_identity_map(spark)
    for body, n in (('{"mappings": []}', 0), ('{"mappings": null}', 0), ("{}", 0), ("", 0)):
        with open(tmp_path / "m.json", "w") as f:
            f.write(body)
        assert spark.read.format("identity_map").load(str(tmp_path / "m.json")).count() == n
    entries = [{"upn": f"u{n % 50}", "targetArchiveId": f"t{n}"} for n in range(500)]
    with open(tmp_path / "m.json", "w") as f:
        json.dump({"mappings": entries}, f)
    rows = spark.read.format("identity_map").option("rangeBytes", 2000).load(str(tmp_path / "m.json"))
    assert rows.rdd.getNumPartitions() > 5
    last = rows.groupBy("upn").agg(F.max_by("target_archive", "pos").alias("t")).collect()
    assert {r["upn"]: r["t"] for r in last} == {f"u{n}": f"t{450 + n}" for n in range(50)}
