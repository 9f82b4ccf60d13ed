"""Time literals."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(moment: datetime) -> Column:
    """Timestamp literal; a moment without a zone is taken as UTC."""
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return F.lit(aware)
