"""Column expressions that turn an archived item into a target message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultferry.schemas import ARCHIVE_CLASSES

MAX_YEAR = 9999


def archive_class(archive_type: Column) -> Column:
    """Class slug of an archive type; null for a type outside the domain."""
    slug = F.lit(None).cast("string")
    for name, value in ARCHIVE_CLASSES.items():
        slug = F.when(archive_type == name, value).otherwise(slug)
    return slug


def type_target(archive_type: Column, archive_id: Column) -> Column:
    """Target archive of an archive without an owner lookup."""
    prefix = (
        F.when(archive_type == "Journal", "compliance_journal:")
        .when(archive_type == "Fsa", "file_archive:")
        .otherwise("unknown:")
    )
    return F.concat(prefix, archive_id)


def iso_timestamp(ts: Column) -> Column:
    """Round-trip text with seven fractional digits, always in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")


def join_recipients(addresses: Column) -> Column:
    """Addresses joined with ``;``, null for an empty or missing list."""
    return F.when(F.size(addresses) > 0, F.array_join(addresses, ";"))


def retention_years(category: Column) -> Column:
    """Number before a closing ``Y``; null without one or beyond a 32-bit integer."""
    digits = F.regexp_extract(category, r"(?idU)(\d+)Y$", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def expiry_in_range(category: Column, sent: Column) -> Column:
    """False when the expiry would fall after the last year a timestamp may hold."""
    years = retention_years(category)
    return F.coalesce(years <= F.lit(MAX_YEAR) - F.year(sent), F.lit(True))


def retention_expiry(category: Column, sent: Column) -> Column:
    """Sent time plus the retention years; 29 February falls back to the 28th."""
    years = retention_years(category)
    usable = F.when(years <= F.lit(MAX_YEAR) - F.year(sent), years)
    return sent + F.make_ym_interval(usable, F.lit(0))


def build_metadata(
    archive_type: Column,
    subject: Column,
    sender: Column,
    message_class: Column,
    folder_path: Column,
    sent: Column,
    to: Column,
    cc: Column,
    bcc: Column,
) -> Column:
    """Metadata map: five fixed entries, recipients when there are any, type extras."""
    entries = {
        "subject": subject,
        "from": sender,
        "messageClass": message_class,
        "folderPath": folder_path,
        "sentDateUtc": iso_timestamp(sent),
        "to": join_recipients(to),
        "cc": join_recipients(cc),
        "bcc": join_recipients(bcc),
        "immutable": F.when(archive_type == "Journal", "true"),
        "sourceFolderPath": F.when(archive_type == "Fsa", folder_path),
    }
    pairs = [c for name, value in entries.items() for c in (F.lit(name), value)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
