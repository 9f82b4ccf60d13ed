"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.llm.support import BROADCAST_IDS, mixed, stored

# A cut falls where the upper bits of a hash of the last 32 bytes are zero, at least LEAST
# and at most MOST bytes after the cut before.
LEAST = 1024
MOST = 16_384
MASK = np.uint32(0xFFF00000)
STEP_BYTES = 1 << 21  # bytes of text that one numpy step handles
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

RECIPES = (
    "doc_id bigint, text_sha256 string, "
    "chunks array<struct<short:bigint,size:int,digest:binary>>"
)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places after which a cut may fall: the hash covers the 32 bytes up to each place."""
    rolled = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        older = rolled[:-k] << np.uint32(k)
        rolled = rolled.copy()
        rolled[k:] += older
    return np.flatnonzero((rolled & MASK) == 0) + 1


def chunk_ends(size: int, places: np.ndarray) -> list[int]:
    """Ends of the chunks of a text of ``size`` bytes with the given possible cuts."""
    ends, start = [], 0
    while size - start > LEAST:
        at = int(np.searchsorted(places, start + LEAST))
        end = min(size, start + MOST)
        if at < len(places) and places[at] < end:
            end = int(places[at])
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends


def chunks_of(texts: list[bytes]) -> list[list[bytes]]:
    """Chunks of each text. Cuts lie more than a hash window after a text's start, so texts
    laid out one after the other do not disturb each other."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    places = cut_places(data) if len(data) > LEAST else np.empty(0, np.int64)
    found, base = [], 0
    for text in texts:
        low, high = np.searchsorted(places, (base, base + len(text)))
        start, parts = 0, []
        for end in chunk_ends(len(text), places[low:high] - base):
            parts.append(text[start:end])
            start = end
        found.append(parts)
        base += len(text)
    return found


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("text_sha256", pa.string()),
            (
                "chunks",
                pa.list_(
                    pa.struct(
                        [("short", pa.int64()), ("size", pa.int32()), ("digest", pa.binary())]
                    )
                ),
            ),
        ]
    )
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
        start = 0
        while start < batch.num_rows:
            part: list[bytes] = []
            size, end = 0, start
            while end < batch.num_rows and (end == start or size < STEP_BYTES):
                part.append(texts[end].as_py() or b"")
                size += len(part[-1])
                end += 1
            recipes = [
                [
                    {
                        "short": _signed(xxhash.xxh3_64_intdigest(c)),
                        "size": len(c),
                        "digest": hashlib.sha256(c).digest(),
                    }
                    for c in chunks
                ]
                for chunks in chunks_of(part)
            ]
            yield pa.record_batch(
                [
                    ids.slice(start, end - start),
                    pa.array([hashlib.sha256(t).hexdigest() for t in part], pa.string()),
                    pa.array(recipes, schema.field("chunks").type),
                ],
                schema=schema,
            )
            start = end


def recipes(docs: DataFrame) -> DataFrame:
    """Per row: digest of the whole text and its chunks in order. The text goes no further."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_cut, RECIPES)


def unsure_identifiers(cut: DataFrame) -> DataFrame:
    """Short identifiers that stand for chunks of different content, ``(short)``.

    A short identifier is verified when all chunks that have it agree in size and SHA-256.
    """
    chunk = cut.select(F.explode("chunks").alias("c")).select("c.*")
    return (
        chunk.groupBy("short")
        .agg(
            F.min("digest").alias("d1"),
            F.max("digest").alias("d2"),
            F.min("size").alias("s1"),
            F.max("size").alias("s2"),
        )
        .where("d1 <> d2 or s1 <> s2")
        .select("short")
    )


def _identifiers(unsure: list[int]) -> Column:
    """A recipe as a list of verified identifiers; unsure ones are replaced by the digest."""

    def identifier(chunk: Column) -> Column:
        doubtful = chunk["short"].isin(unsure) if unsure else F.lit(False)
        return F.struct(
            chunk["short"].alias("short"), F.when(doubtful, chunk["digest"]).alias("digest")
        )

    return F.transform("chunks", identifier)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Group the rows of ``docs(doc_id, text, ...)`` whose whole texts are equal.

    Texts are cut into chunks by content; chunks are reduced to verified identifiers; texts
    are equal when their ordered lists of identifiers are. Only lists are shuffled and
    counted before the shuffle, so a group of any size is one row there.

    Returns one row per input row: ``doc_id, keep_id`` (largest ``doc_id`` of the group),
    ``group_size, kept, text_sha256`` and ``n_chunks``. A null text counts as empty. Of rows
    that repeat id and text one is kept. A row without id stays only if no row of its group
    has one, and then one of them does. An empty table gives no rows.
    """
    cut = stored(recipes(docs), "recipes")
    unsure = stored(unsure_identifiers(cut), "unsure")
    if unsure.count() <= BROADCAST_IDS // 1000:
        listed = cut.select(
            "doc_id", "text_sha256", _identifiers([r["short"] for r in unsure.collect()]).alias("recipe")
        )
    else:  # so many collisions that the short identifiers are no use
        listed = cut.select(
            "doc_id",
            "text_sha256",
            F.transform(
                "chunks", lambda c: F.struct(c["short"].alias("short"), c["digest"].alias("digest"))
            ).alias("recipe"),
        )
    rows = listed.groupBy("doc_id", "recipe", "text_sha256").agg(F.count("*").alias("copies"))
    rows = stored(rows, "rows")
    # Stored, so that the join below has an exchange of its own and a hot recipe can be split.
    groups = stored(
        rows.groupBy("recipe").agg(
            F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
        ),
        "groups",
    )
    spread = rows.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        "text_sha256",
        F.size("recipe").cast("bigint").alias("n_chunks"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    )
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return spread.select(
        "doc_id", "keep_id", "group_size", first.alias("kept"), "text_sha256", "n_chunks"
    )
