"""Changes out of order, and messages and answers as two streams."""

import random
from datetime import timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.build import utc
from vaultferry import fixtures as fx
from vaultferry.schemas import STATUS_TRANSITIONS
from vaultferry.streaming import answers as an
from vaultferry.streaming import tracker as tr
from vaultferry.streaming.jobs import drain

CHANGES = "key string, status string, at_utc timestamp, event_id bigint"
STATES = ["Discovered", "Mapped", "Rehydrated", "Transformed", "Ingesting", "Failed"]
T0 = utc(2024, 6, 1)


def arrive(spark, path, schema, batches):
    """Files that come one by one; a stream of them."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return files.parquet(str(path))


def plain(changes, start=None):
    found = dict(start or {})
    for key, status, _, _ in sorted(changes, key=lambda c: (c[2], c[3])):
        before, n, bad = found.get(key, (None, 0, 0))
        wrong = before is not None and status not in STATUS_TRANSITIONS.get(before, ())
        found[key] = (status, n + 1, bad + wrong)
    return found


def as_dict(df):
    return {r["key"]: (r["status"], r["changes"], r["illegal"]) for r in df.collect()}


def test_shuffled_changes_give_the_batch_result(spark, tmp_path):
    """Neighbouring slices of time are mixed; the watermark passes most of them."""
    rng = random.Random(3)
    changes = [
        (f"k{rng.randrange(6)}", rng.choice(STATES), T0 + timedelta(minutes=n), n) for n in range(120)
    ]
    batches = [[] for _ in range(6)]
    for c in changes:
        batches[min(c[3] // 20 + rng.randrange(2), 5)].append(c)
    for batch in batches:
        rng.shuffle(batch)
    stream = arrive(spark, tmp_path / "in", CHANGES, batches)
    start = spark.createDataFrame([("k0", "Mapped", 5, 1), ("old", "Failed", 2, 0)], tr.STATUS)
    out = str(tmp_path / "out")
    got = tr.track_out_of_order(spark, stream, out, str(tmp_path / "cp"), "40 minutes", start)
    assert as_dict(got) == {
        k: v for k, v in plain(changes, {"k0": ("Mapped", 5, 1), "old": ("Failed", 2, 0)}).items() if k != "old"
    }
    assert spark.read.parquet(out).count() > 6


def test_what_is_settled_stays(spark, tmp_path):
    """A change behind the watermark is left out; those before it count once."""
    minute = timedelta(minutes=1)
    batches = [
        [("a", "Discovered", T0, 1), ("a", "Mapped", T0 + minute, 2)],
        [("b", "Discovered", T0 + 60 * minute, 3)],
        [("a", "Failed", T0 + 30 * minute, 4), ("b", "Mapped", T0 + 61 * minute, 5)],
        [("a", "Rehydrated", T0 + 62 * minute, 6)],
    ]
    stream = arrive(spark, tmp_path / "in", CHANGES, batches)
    got = tr.track_out_of_order(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp"), "10 minutes")
    assert as_dict(got) == {"a": ("Rehydrated", 3, 0), "b": ("Mapped", 2, 0)}


def test_a_key_costs_few_state_calls_however_many_changes_it_has():
    """State is reached by a call to the executor, so calls must not grow with the rows."""
    calls = []

    class Held(dict):
        def get(self, *key):
            calls.append("get")
            return super().get(key or "value")

        def update(self, value):
            calls.append("update")
            self["value"] = value

        def exists(self):
            calls.append("exists")
            return "value" in self

        def updateValue(self, key, value):
            calls.append("put")
            self[key] = value

        def removeKey(self, key):
            calls.append("remove")
            del self[key]

        def iterator(self):
            calls.append("iterator")
            return iter(list(self.items()))

    class Handle:
        def getValueState(self, name, schema):
            return Held()

        def getMapState(self, name, keys, values):
            return Held()

        def registerTimer(self, at):
            calls.append("timer")

    class Times:
        def getCurrentWatermarkInMs(self):
            return 100

        def getExpiryTimeInMs(self):
            return 10**6

    one = tr.StatusTracker()
    one.init(Handle())
    late = [Row(micros=50_000, event=0, status="Failed")]
    rows = [Row(micros=n * 1000, event=n, status=STATES[n % 6]) for n in range(1200, 200, -1)]
    (got,) = one.handleInputRows(("k",), iter(late + rows), Times())
    want = plain([("k", r.status, r.micros, r.event) for r in rows])
    assert {got.key: (got.status, got.changes, got.illegal)} == want
    assert list(one.handleExpiredTimer(("k",), Times(), Times())) == []
    (again,) = one.handleInputRows(("k",), iter([]), Times())
    assert again == got
    assert len(calls) <= 12


def test_an_arrival_is_one_micro_batch(spark, tmp_path, monkeypatch):
    """However many files a table is read from and an arrival is written in."""
    rows = spark.range(1200).selectExpr(
        "id event_id", "timestamp_ntz'2024-01-01' ts", "id % 7 user_id", "'view' event_type", "0D value", "'' props"
    )
    rows.repartition(9).write.parquet(str(tmp_path / "events.parquet"))
    for least, files in ((100, 3), (100_000, 1)):
        monkeypatch.setattr(fx, "FILE_ROWS", least)
        seen = []

        def handle(batch, number):
            named = batch.select("event_id", F.input_file_name().alias("file"))
            found = named.selectExpr("min(event_id)", "max(event_id)", "count(*)", "count(distinct file)")
            seen.append(tuple(found.first()))

        drain(fx.stream(spark, str(tmp_path), "events"), handle, str(tmp_path / f"cp{least}"))
        assert seen == [(n * 300, n * 300 + 299, 300, files) for n in range(4)]


SENT = "idempotency_key string, sent_at timestamp"
CAME = "idempotency_key string, at_utc timestamp, http_status int, exception string, already_present boolean"


def test_answers_in_time_late_and_none(spark, tmp_path):
    hour = timedelta(hours=1)
    sent = [[(f"k{n}", T0 + n * hour) for n in range(lo, lo + 3)] for lo in (0, 3)]
    came = [
        [("k0", T0 + hour / 2, 200, None, False), ("k1", T0 + 1.5 * hour, 503, None, None)],
        [
            ("k1", T0 + 1.2 * hour, 422, None, None),
            ("k2", T0 + 9 * hour, 200, None, False),  # too late
            ("k3", T0 + 2 * hour, 200, None, False),  # before it was sent
            ("k4", T0 + 4.1 * hour, None, "TaskCanceledException", None),
            ("stranger", T0 + 4 * hour, 200, None, False),
        ],
    ]
    want = {
        "k0": ("ItemMigrated", None),
        "k1": ("ItemPermanentFailed", "UnprocessableEntity"),
        "k2": ("ItemTransientFailed", an.NO_ANSWER),
        "k3": ("ItemTransientFailed", an.NO_ANSWER),
        "k4": ("ItemTransientFailed", "TaskCanceledException"),
        "k5": ("ItemTransientFailed", an.NO_ANSWER),
    }

    def outcomes(df):
        return {r["idempotency_key"]: (r["event_type"], r["error_code"]) for r in df.collect()}

    tables = [spark.createDataFrame(sum(x, []), s) for x, s in ((sent, SENT), (came, CAME))]
    assert outcomes(an.answers(*tables, "2 hours")) == want

    beat = T0 + 48 * hour
    streams = (
        arrive(spark, tmp_path / "sent", SENT, [*sent, [(an.HEARTBEAT, beat)]]),
        arrive(spark, tmp_path / "came", CAME, [*came, [(an.HEARTBEAT, beat, None, None, None)]]),
    )
    got = an.drain_answers(*streams, "2 hours", "12 hours", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert outcomes(got) == want
    rows = spark.read.parquet(str(tmp_path / "out"))
    # k1 has two answers; no message is decided twice.
    assert rows.groupBy("idempotency_key").count().where("count > 1").select("idempotency_key").collect() == [("k1",)]


def test_no_answer_is_not_said_too_early(spark, tmp_path):
    """As long as an answer may come, a message has no outcome."""
    sent = arrive(spark, tmp_path / "sent", SENT, [[("k", T0)]])
    came = arrive(spark, tmp_path / "came", CAME, [[("other", T0, 200, None, False)]])
    got = an.drain_answers(sent, came, "2 hours", "1 hour", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert got.where(F.col("idempotency_key") == "k").count() == 0
