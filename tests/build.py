"""Small inputs with the usual defaults."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from vaultferry import schemas
from vaultferry.options import RunOptions
from vaultferry.plans.migration import MigrationInputs

AS_OF = datetime(2024, 6, 1, tzinfo=timezone.utc)


def utc(*args: int) -> datetime:
    return datetime(*args, tzinfo=timezone.utc)


def archive(**changes):
    row = dict(
        archive_id="archive-1",
        type="Mailbox",
        owner_upn="alice@contoso.com",
        legal_hold=False,
        vault_store="vault-1",
    )
    return row | changes


def item(**changes):
    row = {
        "item_id": "item-1",
        "archive_id": "archive-1",
        "folder_path": "Inbox",
        "subject": "Test Subject",
        "sent_date_utc": utc(2023, 6, 1),
        "from": "sender@contoso.com",
        "to": ["receiver@contoso.com"],
        "cc": [],
        "bcc": [],
        "content_part_ids": ["part-1"],
        "retention_category": "Standard-7Y",
        "size_bytes": 1024,
        "message_class": "IPM.Note",
    }
    return row | changes


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)


def archives(spark, *rows):
    return frame(spark, rows, schemas.ARCHIVES)


def items(spark, *rows):
    return frame(spark, rows, schemas.ITEMS)


def sha(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def parts(spark, **contents: bytes):
    """Part metadata whose hash fits the content; names may use _ for -."""
    rows = [
        dict(part_id=p.replace("_", "-"), sha256=sha(b), size_bytes=len(b), data_ref=f"{p}.bin")
        for p, b in contents.items()
    ]
    return frame(spark, rows, schemas.PARTS)


def blob_hashes(spark, **contents: bytes):
    rows = [(p.replace("_", "-"), sha(b), len(b)) for p, b in contents.items()]
    return spark.createDataFrame(rows, "part_id string, sha256 string, blob_bytes bigint")


def identity_map(spark, *pairs):
    rows = [(u, t, n) for n, (u, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, "upn string, target_archive string, pos int")


def inputs(spark, archive_rows, item_rows, pairs, **changes):
    values = dict(
        archives=archives(spark, *archive_rows),
        items=items(spark, *item_rows),
        identity_map=identity_map(spark, *pairs),
        parts=parts(spark, part_1=b"one"),
        blob_hashes=blob_hashes(spark, part_1=b"one"),
        identity_order="pos",
    )
    return MigrationInputs(**(values | changes))


def options(**changes) -> RunOptions:
    return RunOptions(**(dict(run_id="run-1", as_of=AS_OF) | changes))
