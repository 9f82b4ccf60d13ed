"""Awkward documents and helpers that the operator tests share."""

from __future__ import annotations

import random
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Columns named as helpers of the operators are, to show that they do no harm.
CLASH = "key string, mark bigint, vertex bigint, row string, tokens int, score double"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"
EXTRA = ("k", 1, 2, "r", 3, 0.5)


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text[, lang, source]) with all other columns filled in."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, "en", "src1")[:4] if len(row) == 2 else row
        full.append((doc_id, text, lang, source, len(text or ""), *EXTRA))
    return spark.createDataFrame(full, DOCS)


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank, short and very long texts, repeated rows."""
    long_text = " ".join(prose(5, 30_000))
    return [
        (1, None),
        (2, ""),
        (3, "  \n\t "),
        (4, "one"),
        (5, "One two THREE four"),
        (6, "one two three four"),
        (7, long_text),
        (8, long_text + " tail"),
        (9, " ".join(prose(6, 100))),
        (9, " ".join(prose(6, 100))),
        (None, "no id here at all but words"),
        (None, None),
        (10, "it's  a test\x0bof\x1fspaces Émile ÉMILE", None, None),
    ]


@contextmanager
def small_limits(spark):
    """Settings under which adaptive execution splits partitions of a small test, too."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "20KB",
        "spark.sql.files.openCostInBytes": "1KB",
        "spark.sql.shuffle.partitions": "40",
    }
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
