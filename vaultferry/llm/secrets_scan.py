"""Secret scan with linking of the parts of one credential."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.llm.support import stored

# Fixed values of the scan: kinds in the order of ties, their patterns, shortest lengths.
KINDS = ("assign", "access", "hex", "identity", "key", "endpoint")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

# Weak parts: alone each of them is ordinary text.
IDENTITY = re.compile(
    r"(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.@-]{3,})",
    re.IGNORECASE | re.ASCII,
)
# An equals sign before a key is that of NAME=VALUE; after other signs it is padding.
KEY = re.compile(
    r"(?:(?<![A-Za-z0-9+/=_-])|(?<=[A-Za-z0-9_]=))[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=_-])"
)
ENDPOINT = re.compile(
    r"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+"
)
# What a part can be in a credential. The strong kinds take part as well.
ROLES = {
    "assign": "secret",
    "hex": "secret",
    "key": "secret",
    "access": "identity",
    "identity": "identity",
    "endpoint": "endpoint",
}
WEAK = ("identity", "key", "endpoint")
# Code points between two parts of one credential at most.
REACH = 200

SPANS = "array<struct<start:int,end:int,rank:int>>"


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """Strong and weak spans of a whole text: start, end (code points), rank of the kind."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append((m.start(), m.end(), 0))
        found += [(m.start(), m.end(), 3) for m in IDENTITY.finditer(text)]
        if "://" in text:
            found += [(m.start(), m.end(), 5) for m in ENDPOINT.finditer(text)]
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append((m.start(), m.end(), 1))
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found += [(m.start(), m.end(), 4) for m in KEY.finditer(text) if _mixed(m[0])]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _mixed(value: str) -> bool:
    """Digits, capitals and small letters together, as random keys have them."""
    return bool(
        re.search("[0-9]", value) and re.search("[A-Z]", value) and re.search("[a-z]", value)
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rank", pa.int32())])
    )
    for batch in batches:
        spans = [
            [{"start": a, "end": b, "rank": r} for a, b, r in spans_of(t)] if t else []
            for t in batch.column(2).to_pylist()
        ]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(spans, kind)],
            names=["doc_id", "row_key", "spans"],
        )


def _kind(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), rank + 1)


def linked_parts(parts: DataFrame) -> DataFrame:
    """Weak rows of ``parts(row_key, start, end, rank)`` that have a complement in reach.

    Interval join: parts meet in scopes of ``REACH`` code points, their own and its two
    neighbours. Parts of one kind do not overlap, so a scope holds few of them however many
    a text has, and one text's parts are spread over its scopes. An identity needs a secret,
    an endpoint needs a secret or an identity, and a weak secret needs an identity or an
    endpoint.
    """
    roles = F.create_map(*[F.lit(v) for k in KINDS for v in (k, ROLES[k])])
    part = parts.select(
        "row_key", "start", "end", "rank", roles[_kind(F.col("rank"))].alias("role")
    )
    # A part lies in every scope it covers; the others reach one more at either side.
    covered = F.sequence(F.floor(F.col("start") / REACH), F.floor(F.col("end") / REACH))
    here = part.where(_kind(F.col("rank")).isin(*WEAK)).withColumn("scope", F.explode(covered))
    there = part.select(
        F.col("row_key").alias("other_row"),
        F.col("start").alias("other_start"),
        F.col("end").alias("other_end"),
        F.col("role").alias("other_role"),
        F.explode(
            F.sequence(
                F.floor((F.col("start") - REACH) / REACH), F.floor((F.col("end") + REACH) / REACH)
            )
        ).alias("other_scope"),
    )
    near = (F.col("other_start") - F.col("end") <= REACH) & (
        F.col("start") - F.col("other_end") <= REACH
    )
    fits = (F.col("role") != F.col("other_role")) & (
        (F.col("role") != "identity") | (F.col("other_role") == "secret")
    )
    apart = (F.col("start") != F.col("other_start")) | (F.col("end") != F.col("other_end"))
    same = (F.col("row_key") == F.col("other_row")) & (F.col("scope") == F.col("other_scope"))
    linked = here.join(there, same & near & fits & apart, "left_semi")
    return linked.select("row_key", "start", "end", "rank")


def secret_spans(docs: DataFrame) -> DataFrame:
    """Secrets in the whole texts of ``docs(doc_id, text, ...)``.

    Returns one row per input row: ``doc_id, row_key`` (of id and text) and ``spans``, a list
    of ``start, rank, end, kind`` (code points, end exclusive), by start, then kind. Kinds
    ``assign``, ``access`` and ``hex`` are always reported, the weak kinds only where parts
    that complete each other co-occur within ``REACH`` code points. Null and empty texts have
    no spans; equal rows get equal spans. An empty table gives no rows.
    """
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("row_key"),
        "text",
    )
    found = stored(keyed.mapInArrow(_scan, f"doc_id bigint, row_key bigint, spans {SPANS}"), "spans")
    some = found.where(F.size("spans") > 1).dropDuplicates(["row_key"])
    parts = some.select("row_key", F.explode("spans").alias("s")).select("row_key", "s.*")
    weak = (
        linked_parts(parts)
        .groupBy("row_key")
        .agg(F.collect_set(F.struct("start", "end", "rank")).alias("linked"))
    )
    strong = F.filter("spans", lambda s: s["rank"] < 3)
    every = F.concat(strong, F.coalesce("linked", F.array().cast(SPANS)))
    ordered = F.array_sort(
        F.transform(
            every,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["rank"].alias("rank"),
                s["end"].alias("end"),
                _kind(s["rank"]).alias("kind"),
            ),
        )
    )
    return found.join(weak, "row_key", "left").select("doc_id", "row_key", ordered.alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redacted(docs: DataFrame, spans: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of its text replaced by ``mark``."""
    keyed = docs.withColumn("llm_row_key", F.xxhash64(F.col("doc_id"), F.col("text")))
    found = spans.select(F.col("row_key").alias("llm_row_key"), F.col("spans").alias("llm_spans"))
    joined = keyed.join(found.dropDuplicates(["llm_row_key"]), "llm_row_key", "left")
    empty = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        between = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        return F.struct(
            F.when(fresh, F.concat(state["done"], between, F.lit(mark)))
            .otherwise(state["done"])
            .alias("done"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    rest = F.aggregate(
        F.coalesce("llm_spans", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")),
        empty,
        step,
        lambda s: F.concat(s["done"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    return joined.withColumn("text", rest).select(*docs.columns)
