import pytest

from tests import build as b
from vaultferry.operators import identity, policy
from vaultferry.options import MIGRATE, RETAIN, MigrationFilters


def decide(spark, archive=None, item=None, hold=RETAIN, **filters):
    a = b.archives(spark, archive or b.archive())
    joined = b.items(spark, item or b.item()).join(a, "archive_id")
    row = policy.with_decision(joined, MigrationFilters(**filters), hold).first()
    return row["outcome"], row["reason"]


@pytest.mark.parametrize("hold, outcome", [(RETAIN, "LegalHoldRetain"), (MIGRATE, "LegalHoldMigrate")])
def test_legal_hold(spark, hold, outcome):
    assert decide(spark, b.archive(legal_hold=True), hold=hold)[0] == outcome


def test_mailbox_without_owner_is_orphaned(spark):
    assert decide(spark, b.archive(owner_upn=None))[0] == "Orphaned"


def test_held_ownerless_mailbox_reports_hold_first(spark):
    assert decide(spark, b.archive(owner_upn=None, legal_hold=True))[0] == "LegalHoldRetain"
    assert decide(spark, b.archive(owner_upn=None, legal_hold=True), hold=MIGRATE)[0] == "Orphaned"


@pytest.mark.parametrize("kind", ["Journal", "Fsa"])
def test_other_types_need_no_owner(spark, kind):
    assert decide(spark, b.archive(type=kind, owner_upn=None)) == (
        "Proceed",
        "No exclusion rules matched.",
    )


@pytest.mark.parametrize(
    "item, filters, outcome",
    [
        ({}, {"archive_id": "archive-B"}, "SkippedByFilter"),
        ({}, {"archive_id": "archive-1"}, "Proceed"),
        ({}, {"archive_id": "ARCHIVE-1"}, "SkippedByFilter"),
        ({"sent_date_utc": b.utc(2020, 1, 1)}, {"from_utc": b.utc(2021, 1, 1)}, "SkippedByFilter"),
        ({"sent_date_utc": b.utc(2021, 1, 1)}, {"from_utc": b.utc(2021, 1, 1)}, "Proceed"),
        ({"sent_date_utc": b.utc(2024, 6, 1)}, {"to_utc": b.utc(2024, 6, 1)}, "SkippedByFilter"),
        ({"sent_date_utc": b.utc(2024, 5, 31)}, {"to_utc": b.utc(2024, 6, 1)}, "Proceed"),
        ({"folder_path": "Sent Items"}, {"folder_path": "Inbox"}, "SkippedByFilter"),
        ({"folder_path": "INBOX\\A_%"}, {"folder_path": "inbox\\a_%"}, "Proceed"),
        ({"folder_path": "INBOX\\AB%"}, {"folder_path": "inbox\\a_%"}, "SkippedByFilter"),
        ({}, {"retention_category": "standard-7y"}, "Proceed"),
        ({}, {"retention_category": "standard-8y"}, "SkippedByFilter"),
    ],
)
def test_filters(spark, item, filters, outcome):
    assert decide(spark, item=b.item(**item), **filters)[0] == outcome


def test_turkish_letters_do_not_match_plain_i(spark):
    dotted = b.item(folder_path="İzin", retention_category="ısı-1Y")
    assert decide(spark, item=dotted, folder_path="izin")[0] == "SkippedByFilter"
    assert decide(spark, item=dotted, retention_category="ISI-1Y")[0] == "SkippedByFilter"
    assert decide(spark, item=dotted, folder_path="İz")[0] == "Proceed"


def test_filter_comes_before_hold(spark):
    outcome, reason = decide(spark, b.archive(legal_hold=True), archive_id="x")
    assert (outcome, reason) == ("SkippedByFilter", "ArchiveId filter not matched.")


def test_in_scope_pushes_dates_to_the_scan(spark, tmp_path, capsys):
    b.items(spark, b.item()).write.parquet(str(tmp_path / "items"))
    read = spark.read.parquet(str(tmp_path / "items"))
    kept = policy.in_scope(
        read, MigrationFilters(from_utc=b.utc(2021, 1, 1), archive_id="archive-1")
    )
    kept.select("item_id").explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(sent_date_utc" in pushed and "EqualTo(archive_id" in pushed
    columns = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "subject" not in columns
    assert kept.count() == 1


def test_resolution(spark):
    archives = b.archives(
        spark,
        b.archive(archive_id="a", owner_upn="ALICE@contoso.com"),
        b.archive(archive_id="b", owner_upn=None),
        b.archive(archive_id="c", owner_upn="bob@contoso.com"),
        b.archive(archive_id="d", type="Journal", owner_upn=None),
        b.archive(archive_id="e", type="Fsa", owner_upn="alice@contoso.com"),
        b.archive(archive_id="f", type="Other", owner_upn=None),
        b.archive(archive_id="g", owner_upn=" alice@contoso.com"),
    )
    found = b.identity_map(spark, ("alice@contoso.com", "old"), ("Alice@Contoso.com", "new"))
    got = {
        r["archive_id"]: (r["target_archive"], r["orphan_reason"])
        for r in identity.resolve_targets(archives, found, "pos").collect()
    }
    assert got == {
        "a": ("new", None),
        "b": (None, "NullOwnerUpn"),
        "c": (None, "Unmapped"),
        "d": ("compliance_journal:d", None),
        "e": ("file_archive:e", None),
        "f": ("unknown:f", None),
        "g": (None, "Unmapped"),
    }


def test_turkish_owner_does_not_match(spark):
    archives = b.archives(spark, b.archive(owner_upn="İ@x"))
    row = identity.resolve_targets(archives, b.identity_map(spark, ("i@x", "t"))).first()
    assert row["orphan_reason"] == "Unmapped"


def test_routes(spark):
    archives = b.archives(
        spark,
        b.archive(archive_id="a"),
        b.archive(archive_id="b", legal_hold=True, owner_upn=None),
        b.archive(archive_id="c", owner_upn=None),
    )
    m = b.identity_map(spark, ("alice@contoso.com", "t"))

    def routes(**changes):
        rows = identity.route_archives(archives, m, b.options(**changes)).collect()
        return {r["archive_id"]: r["route"] for r in rows}

    assert routes() == {"a": "routed", "b": "held", "c": "orphan"}
    assert routes(legal_hold=MIGRATE) == {"a": "routed", "b": "orphan", "c": "orphan"}
    only_a = MigrationFilters(archive_id="a")
    assert routes(filters=only_a) == {"a": "routed", "b": "filtered", "c": "filtered"}


LETTERS = [
    ("ΟΔΟΣΑ", "ΟΔΟΣ", True),  # a sigma equals a sigma, wherever it stands
    ("οδος", "ΟΔΟΣ", True),
    ("οδοσ", "οδος", True),
    ("\u212aelvin", "kelvin", False),  # the Kelvin sign is a letter of its own
    ("ıstanbul", "istanbul", False),
    ("İstanbul", "istanbul", False),
    ("Straße", "STRASSE", False),
    ("ÉCOLE", "école", True),
    ("Inbox/A", "inBOX", True),
    (None, "inbox", False),
]


def test_folders_compare_letter_by_letter(spark):
    from vaultferry.options import MigrationFilters
    from vaultferry.operators import policy

    for folder, prefix, inside in LETTERS:
        row = b.item() | {"folder_path": folder, "retention_category": folder}
        fields = "archive_id string, folder_path string, retention_category string, legal_hold boolean, type string, owner_upn string"
        items = spark.createDataFrame(
            [("a", row["folder_path"], row["retention_category"], False, "Fsa", None)], fields
        )
        filters = MigrationFilters(folder_path=prefix)
        assert (policy.in_scope(items, filters).count() == 1) == inside, (folder, prefix)
        got = policy.with_decision(items, filters).first()["outcome"]
        assert (got == "Proceed") == inside, (folder, prefix)
