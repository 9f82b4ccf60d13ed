"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window of ``span`` words holds ``span - gram + 1`` overlapping word grams; its fingerprint
is the smallest of their hashes. Equal windows have equal fingerprints, so joining the
fingerprints of documents and benchmark finds every shared window; each candidate is then
extended to its whole window and compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.llm.support import stored

SPAN = 13
GRAM = 5
# Rows of a benchmark table that may be sent to every executor (about 150 bytes each).
BROADCAST_ROWS = 250_000
# Fingerprint of the row that stands for a document itself.
ITSELF = -1

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case A-Z only, then the runs of digits, letters and non-ASCII characters."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), NO_WORD), "")


def _fingerprints(rows: DataFrame, span: int) -> DataFrame:
    """Add ``prints``: the fingerprint of the window that starts at each word.

    The hashes of the grams and the smallest per window are two columns of their own, so
    each is computed once per row.
    """
    gram = min(GRAM, span)
    grams = F.when(
        F.size("words") >= span,
        F.transform(
            F.sequence(F.lit(1), F.size("words") - (gram - 1)),
            lambda i: F.shiftrightunsigned(F.xxhash64(F.slice("words", i, gram)), 1),
        ),
    )
    if gram == span:
        return rows.withColumn("prints", grams)
    least = F.transform(
        F.sequence(F.lit(1), F.size("grams") - (span - gram)),
        lambda i: F.array_min(F.slice("grams", i, span - gram + 1)),
    )
    return (
        rows.withColumn("grams", grams)
        .withColumn("prints", F.when(F.col("grams").isNotNull(), least))
        .drop("grams")
    )


def _window(start: Column, span: int) -> Column:
    return F.array_join(F.slice("words", start + 1, span), " ")


def _benchmark_windows(benchmark: DataFrame, span: int) -> DataFrame:
    """Distinct windows of the benchmark: ``length, print, window, items``."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    # At most ``span`` different lengths.
    lengths = items.select(F.least(F.size("words"), F.lit(span)).alias("n")).distinct().collect()
    parts = []
    for length in sorted(r["n"] for r in lengths) or [span]:
        own = items.where(F.size("words") >= span if length == span else F.size("words") == length)
        rows = _fingerprints(own, length).select("item", "words", F.posexplode("prints"))
        parts.append(
            rows.select(
                F.lit(length).alias("length"),
                F.col("col").alias("print"),
                _window(F.col("pos"), length).alias("window"),
                "item",
            )
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    return union.groupBy("length", "print", "window").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )


def _near(rows: DataFrame, known: DataFrame, prints: DataFrame, length: int) -> DataFrame:
    """Matches when the benchmark is short: one pass, texts and windows stay in their task."""
    prepared = _fingerprints(rows, length)
    start = F.lit(ITSELF).cast("bigint")
    all_prints = F.concat(
        F.array(start), F.coalesce("prints", F.array().cast("array<bigint>"))
    )
    spread = prepared.select(
        "id", "mark", "n_words", "words", F.posexplode(all_prints).alias("at", "print")
    )
    wanted = prints.union(prints.sparkSession.range(ITSELF, ITSELF + 1).toDF("print"))
    hits = spread.join(F.broadcast(wanted), "print").select(
        "id",
        "mark",
        "n_words",
        F.col("at").alias("pos"),
        F.when(F.col("at") > 0, _window(F.col("at") - 1, length)).alias("window"),
    )
    return (
        hits.join(F.broadcast(known.select("window", "items")), "window", "left")
        .where("pos = 0 or items is not null")
        .select(
            "id",
            "mark",
            "n_words",
            F.when(
                F.col("pos") > 0,
                F.struct((F.col("pos") - 1).alias("start"), (F.col("pos") + length - 1).alias("end")),
            ).alias("hit"),
            "items",
            (F.col("pos") == 0).cast("bigint").alias("copies"),
        )
    )


def _far(rows: DataFrame, known: DataFrame, prints: DataFrame, length: int) -> DataFrame:
    """Matches against a benchmark of any size: fingerprints are shuffled, not the texts of
    documents without a candidate."""
    prepared = _fingerprints(rows, length)
    found = (
        prepared.select("id", "mark", F.explode(F.array_distinct("prints")).alias("print"))
        .join(prints, "print")
        .groupBy("id", "mark")
        .agg(F.collect_set("print").alias("found"))
        .select(F.col("id").alias("found_id"), F.col("mark").alias("found_mark"), "found")
    )
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark"))
    places = F.filter(
        F.transform("prints", lambda p, i: F.when(F.array_contains("found", p), i)),
        lambda i: i.isNotNull(),
    )
    hits = (
        prepared.join(found, same)
        .select("id", "mark", "words", F.explode(places).alias("pos"))
        .select("id", "mark", "pos", _window(F.col("pos"), length).alias("window"))
    )
    matches = hits.join(known.select("window", "items"), "window").select(
        "id",
        "mark",
        F.lit(None).cast("int").alias("n_words"),
        F.struct(F.col("pos").alias("start"), (F.col("pos") + length).alias("end")).alias("hit"),
        "items",
        F.lit(0).cast("bigint").alias("copies"),
    )
    return rows.select(
        "id",
        "mark",
        "n_words",
        F.lit(None).cast(matches.schema["hit"].dataType).alias("hit"),
        F.lit(None).cast("array<string>").alias("items"),
        F.lit(1).cast("bigint").alias("copies"),
    ).union(matches)


def _merged(hits: Column) -> Column:
    """Unite overlapping or touching spans of a sorted list."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(done: Column, hit: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], hit["end"]).alias("end")
        )
        return F.when(
            F.size(done).cast("boolean") & (hit["start"] <= last["end"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)),
        ).otherwise(F.concat(done, F.array(hit)))

    return F.aggregate(hits, empty, step)


def _covered(hits: Column) -> Column:
    """Number of words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def step(done: Column, hit: Column) -> Column:
        reach = F.greatest(done["reach"], hit["end"])
        fresh = F.greatest(hit["end"] - F.greatest(done["reach"], hit["start"]), F.lit(0))
        return F.struct((done["n"] + fresh).alias("n"), reach.alias("reach"))

    return F.aggregate(hits, start, step, lambda done: done["n"]).cast("bigint")


def benchmark_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Words of ``docs(doc_id, text)`` inside a window that a benchmark text also has.

    A window is ``span`` consecutive words of a ``benchmark(item_id, text)`` row; a shorter
    item is one window. Returns one row per input row: ``doc_id, row_key`` (of id and text),
    ``n_words, n_hit, hits`` (sorted windows as word positions, end exclusive) and ``items``
    (sorted ids with an occurring window). Null and empty texts have no words and no hits;
    a null ``doc_id`` stays null; equal rows are counted once and returned as often as they
    came; an item without id still marks words but is not listed. An empty benchmark hits
    nothing, an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.xxhash64("doc_id", "text").alias("mark"),
        words(F.col("text")).alias("words"),
    ).withColumn("n_words", F.size("words"))
    known = stored(_benchmark_windows(benchmark, span), "windows")
    sizes = {r["length"]: r["n"] for r in known.groupBy("length").agg(F.count("*").alias("n")).collect()}
    matcher = _near if sum(sizes.values()) <= broadcast_rows else _far
    lengths = sorted(sizes, reverse=True) or [span]
    union = None
    for turn, length in enumerate(lengths):
        own = known.where(F.col("length") == length)
        part = matcher(rows, own, own.select("print").distinct(), length)
        if turn:
            part = part.withColumn("copies", F.lit(0).cast("bigint"))
        union = part if union is None else union.union(part)
    grouped = union.groupBy("id", "mark").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.sort_array(F.collect_set("hit")).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum("copies").alias("copies"),
    )
    return grouped.select(
        F.col("id").alias("doc_id"),
        F.col("mark").alias("row_key"),
        "n_words",
        _covered(F.col("hits")).alias("n_hit"),
        "hits",
        "items",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def merged_spans(overlap: DataFrame) -> DataFrame:
    """``overlap`` with ``hits`` united into disjoint word spans, as used to cut passages."""
    return overlap.withColumn("hits", _merged(F.col("hits")))


def contaminated() -> Column:
    """Whether a row of ``benchmark_overlap`` counts as contaminated: a twentieth is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
