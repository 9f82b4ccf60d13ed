import pytest
from pyspark.sql import functions as F

from tests import build as b
from vaultferry.functions import hashing, http_status, keys, messages, payload


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_key_format_and_blank_parts(spark):
    rows = [
        ("vaultA", "arch1", "item99"),
        ("v", "", "i"),
        ("v", "a", "  \t"),
        ("v", "a", " 　"),
        (None, "a", "i"),
    ]
    key = keys.idempotency_key(F.col("v"), F.col("a"), F.col("i"))
    got = values(spark, rows, "v string, a string, i string", key=key)
    assert got == [("ev:vaultA:arch1:item99",), (None,), (None,), (None,), (None,)]


@pytest.mark.parametrize(
    "text, parsed",
    [
        ("ev:vaultA:arch1:item99", ("vaultA", "arch1", "item99")),
        ("ev:v:a:b:c:d", ("v", "a", "b:c:d")),
        ("ev:::", ("", "", "")),
        ("", None),
        ("   ", None),
        ("not-ev-format", None),
        ("ev:only-two", None),
        ("EV:v:a:i", None),
        (None, None),
    ],
)
def test_parse_key(spark, text, parsed):
    ((got,),) = values(spark, [(text,)], "k string", p=keys.key_parts(F.col("k")))
    assert (None if got is None else tuple(got)) == parsed


def test_target_and_event_ids_repeat(spark):
    ((t, e, f),) = values(
        spark,
        [("k",)],
        "k string",
        t=keys.target_id(F.col("k")),
        e=keys.event_id(F.lit("run"), F.lit("type"), F.col("k")),
        f=keys.event_id(F.lit("run"), F.lit("typek"), F.lit("")),
    )
    assert t.startswith("sx-") and len(t) == 35
    assert len(e) == 36 and [len(p) for p in e.split("-")] == [8, 4, 4, 4, 12]
    assert e != f


def test_names():
    assert [keys.snake_case(n) for n in ("UTCDate", "MyField", "ArchiveId", "Id", "ABCdEFg")] == [
        "utc_date",
        "my_field",
        "archive_id",
        "id",
        "ab_cd_e_fg",
    ]
    assert keys.camel_case("timestamp_utc") == "timestampUtc"


def test_hashes(spark):
    digest = b.sha(b"abc")
    rows = [(digest.upper(),), (digest[:-1],), (" " * 64,), ("g" * 64,), (None,)]
    got = values(spark, rows, "h string", n=hashing.normalize_hash(F.col("h")))
    assert got == [(digest,), (None,), (None,), ("g" * 64,), (None,)]
    ((of_bytes, of_text),) = values(
        spark,
        [(bytearray(b"abc"), "abc")],
        "x binary, y string",
        x=hashing.content_hash(F.col("x")),
        y=hashing.content_hash(F.col("y")),
    )
    assert of_bytes == of_text == digest


@pytest.mark.parametrize(
    "kind, slug",
    [
        ("Mailbox", "user_mailbox"),
        ("Journal", "compliance_journal"),
        ("Fsa", "file_archive"),
        ("Other", None),
    ],
)
def test_archive_class(spark, kind, slug):
    assert values(spark, [(kind,)], "t string", c=messages.archive_class(F.col("t"))) == [(slug,)]


@pytest.mark.parametrize(
    "category, sent, years, expires, in_range",
    [
        ("Legal-7Y", "2020-03-15 00:00:00", 7, "2027-03-15 00:00:00", True),
        ("Keep-1y", "2024-02-29 10:11:12", 1, "2025-02-28 10:11:12", True),
        ("NoExpiry", "2020-03-15 00:00:00", None, None, True),
        ("7Years", "2020-03-15 00:00:00", None, None, True),
        ("A12Y7Y", "2020-03-15 00:00:00", 7, "2027-03-15 00:00:00", True),
        ("Legal-7Y\n", "2020-03-15 00:00:00", 7, "2027-03-15 00:00:00", True),
        ("X-٣Y", "2020-03-15 00:00:00", None, None, True),
        ("Huge-99999999999Y", "2020-03-15 00:00:00", None, None, True),
        ("Top-7979Y", "2020-12-31 23:59:59", 7979, "9999-12-31 23:59:59", True),
        ("Over-7980Y", "2020-03-15 00:00:00", 7980, None, False),
        ("Int-2147483647Y", "2020-03-15 00:00:00", 2147483647, None, False),
    ],
)
def test_retention(spark, category, sent, years, expires, in_range):
    c, s = F.col("c"), F.col("s").cast("timestamp")
    got = values(
        spark,
        [(category, sent)],
        "c string, s string",
        y=messages.retention_years(c),
        e=messages.retention_expiry(c, s).cast("string"),
        r=messages.expiry_in_range(c, s),
    )
    assert got == [(years, expires, in_range)]


def test_iso_timestamp(spark):
    ((got,),) = values(
        spark,
        [("2024-02-03 04:05:06.123456",)],
        "s string",
        t=messages.iso_timestamp(F.col("s").cast("timestamp")),
    )
    assert got == "2024-02-03T04:05:06.1234560Z"


def metadata(spark, kind, **changes):
    row = b.items(spark, b.item(**changes)).select(
        messages.build_metadata(
            F.lit(kind),
            *[
                F.col(c)
                for c in (
                    "subject",
                    "from",
                    "message_class",
                    "folder_path",
                    "sent_date_utc",
                    "to",
                    "cc",
                    "bcc",
                )
            ],
        ).alias("m")
    )
    return row.first()["m"]


def test_metadata(spark):
    plain = metadata(spark, "Mailbox", cc=["cc1", "cc2"], bcc=["bcc1"])
    assert plain == {
        "subject": "Test Subject",
        "from": "sender@contoso.com",
        "messageClass": "IPM.Note",
        "folderPath": "Inbox",
        "sentDateUtc": "2023-06-01T00:00:00.0000000Z",
        "to": "receiver@contoso.com",
        "cc": "cc1;cc2",
        "bcc": "bcc1",
    }
    assert metadata(spark, "Journal")["immutable"] == "true"
    assert metadata(spark, "Fsa", to=[])["sourceFolderPath"] == "Inbox"
    assert "to" not in metadata(spark, "Fsa", to=[])


def test_payloads(spark):
    text = payload.audit_payload(archiveId=F.lit("a"), targetId=F.lit(None).cast("string"))
    ((body,),) = values(spark, [(1,)], "x int", p=text)
    assert body == '{"archiveId":"a","targetId":null}'
    rows = [('{"n":42}',), ("{}",), ('{"n":"x"}',), (None,)]
    got = values(spark, rows, "p string", n=payload.payload_long(F.col("p"), "n"))
    assert got == [(42,), (0,), (0,), (0,)]


def test_status_names(spark):
    rows = [(429,), (503,), (422,), (409,), (500,), (299,), (799,), (None,)]
    got = values(spark, rows, "s int", n=http_status.status_name(F.col("s")))
    assert [g for (g,) in got] == [
        "TooManyRequests",
        "ServiceUnavailable",
        "UnprocessableEntity",
        "Conflict",
        "InternalServerError",
        "299",
        "799",
        None,
    ]
