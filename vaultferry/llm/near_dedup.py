"""Near-duplicate grouping with SuperMinHash signatures.

Steps: one signature per text, one vertex per distinct shingle set, banding, exact
verification against a bucket's centre, union-find, more centres where many members of a
bucket are outside its largest group, then an exact comparison, in blocks, of those that are
still outside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.llm.graph import components
from vaultferry.llm.support import BROADCAST_IDS, GOLDEN, mixed, restrict, stored

SHINGLE = 5
ROWS = 7
BANDS = 36
SLOTS = ROWS * BANDS  # below 256: a permutation fits in bytes
CHUNK = 100_000  # shingles that one numpy step handles
MEMO = 500_000  # distinct words remembered per task
BLOCK = 256  # members of an open bucket that are compared with as many others at once
BLOCK_SHINGLES = 1_000_000  # shingles of the members of a block together
CROWD = 4  # blocks of members outside a bucket's largest group that need no further centre
COLUMNS = 4096  # shingles that one matrix product covers

SIGNED = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>"


class _WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


def shingle_set(text: bytes | None, memo: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text.

    A-Z are lower-cased and words are separated by ASCII white space, which is what
    ``bytes.lower`` and ``bytes.split`` do. Fewer than five words give one shingle.
    """
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    rolled = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        rolled = rolled * GOLDEN + hashes[k : n - width + 1 + k]
    return np.unique(mixed(rolled))


def signatures(elements: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """SuperMinHash signatures ``[docs, SLOTS]`` of the sets given as (element, owner) rows.

    Each element walks a random permutation of the slots; step j offers the value
    ``j + random`` to slot ``permutation[j]``, and a slot keeps its smallest offer. Offers of
    a later step never beat those of an earlier one, so a set whose slots are all filled
    leaves the walk: most sets need two or three of the 252 steps.
    """
    signature = np.full(docs * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    shift = np.uint64(32)
    permutation = None
    rows = np.arange(len(elements))
    for step in range(SLOTS):
        draw = mixed(elements + np.uint64(int(GOLDEN) * (step + 1) & 0xFFFFFFFFFFFFFFFF))
        pick = ((draw & low) * np.uint64(SLOTS - step) >> shift).astype(np.int64) + step
        if step == 0:
            slot = pick
        else:
            here = permutation[:, step].copy()
            slot = permutation[rows, pick].astype(np.int64)
            permutation[rows, pick] = here
        offer = (np.uint64(step) << shift) | (draw >> shift)
        np.minimum.at(signature, owner * SLOTS + slot, offer)
        filled = (signature.reshape(docs, SLOTS) < np.iinfo(np.uint64).max).all(axis=1)
        left = ~filled[owner]
        if not left.any():
            break
        if step == 0:
            elements, owner, first = elements[left], owner[left], pick[left]
            rows = np.arange(len(elements))
            permutation = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(elements), 1))
            permutation[rows, first] = 0
        elif left.sum() * 2 < len(left):
            elements, owner, permutation = elements[left], owner[left], permutation[left]
            rows = np.arange(len(elements))
    return signature.reshape(docs, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, the band number mixed in."""
    bands = signature.reshape(len(signature), BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        key = mixed(key * GOLDEN + bands[:, :, r])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _WordHashes()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
        start = 0
        while start < batch.num_rows:
            sets: list[np.ndarray] = []
            size, end = 0, start
            while end < batch.num_rows and (end == start or size < CHUNK):
                sets.append(shingle_set(texts[end].as_py(), memo))
                size += len(sets[-1])
                end += 1
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            keys = band_keys(signatures(np.concatenate(sets), owner, len(sets)))
            yield pa.record_batch(
                [
                    ids.slice(start, end - start),
                    pa.array(sizes, pa.int64()),
                    pa.array(
                        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                        pa.binary(),
                    ),
                    pa.array([k if n else None for k, n in zip(keys, sizes)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )
            start = end


def signed(docs: DataFrame) -> DataFrame:
    """Per row: set size, 128-bit key of the exact set, and its bucket keys (null if empty)."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_sign, SIGNED)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _WordHashes()
    centre, text_of, of = None, None, np.empty(0, np.uint64)
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        left, right = (batch.column(i).cast(pa.large_binary()) for i in (2, 3))
        common, union = [], []
        for i in range(batch.num_rows):
            if a[i].as_py() != centre or left[i].as_py() != text_of:
                centre, text_of = a[i].as_py(), left[i].as_py()
                of = shingle_set(text_of, memo)
            other = shingle_set(right[i].as_py(), memo)
            both = np.concatenate((of, other))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            common.append(shared)
            union.append(len(of) + len(other) - shared)
        yield pa.record_batch(
            [a, b, pa.array(common, pa.int64()), pa.array(union, pa.int64())],
            names=["a", "b", "common", "together"],
        )


def _texts_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """``id, text`` of the named rows. A short list of names need not be made distinct first."""
    if named.count() > BROADCAST_IDS:
        named = stored(named.distinct(), "named")
    return restrict(docs.select(F.col("doc_id").alias("id"), "text"), named, "id", True)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact intersection and union sizes of the full sets of stored ``pairs(a, b)``.

    Texts are moved, as they are smaller than their sets; only texts named by a pair are.
    Both joins are plain, so a centre with many partners is split by adaptive execution.
    """
    texts = _texts_of(docs, pairs.select(F.col("a").alias("named")).union(pairs.select("b")))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(_similar, "a bigint, b bigint, common bigint, together bigint")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Group the rows of ``docs(doc_id, text, ...)`` by Jaccard similarity of five-word shingles.

    Texts are linked when ``100 * intersection >= percent * union`` of their full sets.
    Returns ``doc_id, n_shingles, component_id, kept`` with one row per input row:
    ``component_id`` is the smallest ``doc_id`` reachable over links. A null, empty or
    white-space text has no shingles and is linked with nothing. Rows that repeat a
    ``doc_id`` are one vertex. A row without ``doc_id`` is linked with nothing either: its
    component is null and it is kept. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = stored(signed(docs), "signatures")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    # One vertex per distinct set: copies never enter the bands.
    vertices = stored(
        usable.groupBy("set_key").agg(
            F.min("doc_id").alias("vertex"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        ),
        "vertices",
    )
    members = stored(_bucket_members(vertices), "members")
    first = members.where("centre <> vertex").select(
        F.least("centre", "vertex").alias("a"), F.greatest("centre", "vertex").alias("b")
    )
    tested = stored(verified(docs, stored(first.distinct(), "pairs")), "tested")
    is_link = F.expr(f"100 * common >= {int(percent)} * together")
    # Rows that repeat a doc_id with another text tie their sets together.
    copies = usable.groupBy("doc_id").agg(
        F.min("set_key").alias("k1"), F.max("set_key").alias("k2")
    )
    doubled = stored(copies.where("k1 <> k2").select("doc_id"), "doubled")
    links = tested.where(is_link).select("a", "b")
    if not doubled.isEmpty():
        own = usable.join(doubled, "doc_id").join(vertices.select("set_key", "vertex"), "set_key")
        links = links.union(own.select(F.col("doc_id").alias("a"), F.col("vertex").alias("b")))
    groups = components(links)
    groups, outside = _more_centres(docs, members, groups, percent)
    found = stored(_open_links(docs, outside, percent), "open-links")
    if not found.isEmpty():
        groups = components(
            groups.select(F.col("component").alias("a"), F.col("node").alias("b")).union(found)
        )
    vertex_of = vertices.select("set_key", "vertex")
    named = groups.select(F.col("node").alias("vertex"), "component")
    classes = vertex_of.join(named, "vertex", "left").select(
        "set_key", F.coalesce("component", "vertex").alias("class")
    )
    grouped = rows.join(classes, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("doc_id")).alias("class"),
    )
    component = F.when(F.col("doc_id").isNotNull(), F.col("class"))
    return grouped.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _bucket_members(vertices: DataFrame) -> DataFrame:
    """Members and centre of every bucket with more than one: ``(bucket, vertex, n_shingles, centre)``.

    The centres are stored, so the join has an exchange of its own and a hot bucket is split.
    """
    spread = vertices.select("vertex", "n_shingles", F.explode("bands").alias("bucket"))
    # Another centre in each bucket: members of a large group are tested against several.
    drawn = F.struct(F.xxhash64("bucket", "vertex").alias("draw"), "vertex")
    shared = (
        spread.groupBy("bucket")
        .agg(F.min(drawn)["vertex"].alias("centre"), F.count("*").alias("size"))
        .where("size > 1")
        .select("bucket", "centre")
    )
    return spread.join(stored(shared, "shared"), "bucket")


def _open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one group so far.

    ``main`` is the largest group of the bucket; ``blocks`` and ``out_blocks`` say into how many
    blocks all its members and those outside that group are cut.
    """
    labelled = members.join(groups.withColumnRenamed("node", "vertex"), "vertex", "left").select(
        "bucket", "vertex", "n_shingles", F.coalesce("component", "vertex").alias("class")
    )
    by_class = labelled.groupBy("bucket", "class").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("weight")
    )
    totals = by_class.groupBy("bucket").agg(
        F.max(F.struct("n", "class", "weight")).alias("top"),
        F.sum("n").alias("size"),
        F.sum("weight").alias("weight"),
    )

    def blocks(n: Column, weight: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(weight / BLOCK_SHINGLES))

    n_out = F.col("size") - F.col("top.n")
    buckets = totals.where("top.n < size and size > 2").select(
        "bucket",
        F.col("top.class").alias("main"),
        blocks(F.col("size"), F.col("weight")).alias("blocks"),
        blocks(n_out, F.col("weight") - F.col("top.weight")).alias("out_blocks"),
    )
    return labelled.join(stored(buckets, "open-buckets"), "bucket")


def _more_centres(
    docs: DataFrame, members: DataFrame, groups: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame]:
    """Repeat the centre step where many members of a bucket are outside its largest group.

    Many are more than ``CROWD`` blocks: the exact comparison copies a bucket's texts once per
    block outside, and up to that a round of centres would cost more than the copies. A round
    takes one of them per bucket and tests the others against it. Rounds go on while one at
    least halves the rows that are left, so there are few; what is left then is compared in
    blocks. Returns the groups and the stored members of open buckets.
    """
    before = None
    while True:
        rows = stored(_open_members(members, groups), "open")
        left = rows.where(f"class <> main and out_blocks > {CROWD}")
        n = left.count()
        if n == 0 or (before is not None and 2 * n > before):
            return groups, rows
        drawn = F.struct(F.xxhash64("bucket", "vertex", F.lit(n)).alias("draw"), "vertex", "class")
        centres = stored(left.groupBy("bucket").agg(F.min(drawn).alias("centre")), "centres")
        pairs = (
            left.join(centres, "bucket")
            .where("class <> centre.class")
            .select(
                F.least("vertex", "centre.vertex").alias("a"),
                F.greatest("vertex", "centre.vertex").alias("b"),
            )
        )
        tested = verified(docs, stored(pairs.distinct(), "pairs"))
        links = tested.where(f"100 * common >= {int(percent)} * together").select("a", "b")
        groups = components(
            groups.select(F.col("component").alias("a"), F.col("node").alias("b")).union(links)
        )
        before = n


def _open_links(docs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that are in different groups so far.

    Members outside the largest group of their bucket are compared with all its members.
    Both sides are dealt into blocks, bounded in members and in shingles, and each pair of
    blocks is a task's work: counts come from a matrix product over the shingles the two
    blocks share, and only one link per pair of groups leaves the task, so no list of pairs
    is ever made, however large a bucket is.
    """
    texts = _texts_of(docs, rows.select(F.col("vertex").alias("named")))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("vertex"), F.col(n))

    outside = rows.where("class <> main").select(
        "bucket", "vertex", "class", F.lit(True).alias("outer"),
        block("out_blocks").alias("i"), every("blocks").alias("j"),
    )
    inside = rows.select(
        "bucket", "vertex", "class", F.lit(False).alias("outer"),
        every("out_blocks").alias("i"), block("blocks").alias("j"),
    )
    sides = outside.union(inside).withColumnRenamed("vertex", "id")
    work = sides.join(texts, "id").select("bucket", "i", "j", "outer", "id", "class", "text")

    def compare(rows: pa.Table) -> pa.Table:
        return _block_links(rows, percent)

    return work.groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def _block_links(rows: pa.Table, percent: int) -> pa.Table:
    """One link per pair of groups between the outer and the other rows of a pair of blocks."""
    memo = _WordHashes()
    outer = np.array(rows["outer"].to_pylist(), bool)
    ids = rows["id"].to_numpy()
    classes = rows["class"].to_numpy()
    sets = [shingle_set(t, memo) for t in rows["text"].cast(pa.large_binary()).to_pylist()]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(
        np.concatenate(sets), return_inverse=True, return_counts=True
    )
    shared = count[column] > 1  # a shingle of one text alone is in no intersection
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    place = np.empty(len(sets), np.int64)
    place[outer], place[~outer] = np.arange(outer.sum()), np.arange((~outer).sum())
    common = np.zeros((outer.sum(), (~outer).sum()), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        part = (column >= low) & (column < low + COLUMNS)
        left, right = part & outer[owner], part & ~outer[owner]
        a = np.zeros((common.shape[0], COLUMNS), np.float32)
        b = np.zeros((common.shape[1], COLUMNS), np.float32)
        a[place[owner[left]], column[left] - low] = 1
        b[place[owner[right]], column[right] - low] = 1
        common += a @ b.T
    common = common.astype(np.int64)  # whole numbers far below 2**24 are exact
    union = sizes[outer][:, None] + sizes[~outer][None, :] - common
    linked = 100 * common >= percent * union
    linked &= classes[outer][:, None] != classes[~outer][None, :]
    x, y = np.nonzero(linked)
    pairs = np.stack([classes[outer][x], classes[~outer][y]], axis=1)
    _, first = np.unique(np.sort(pairs, axis=1), axis=0, return_index=True)
    a, b = ids[outer][x[first]], ids[~outer][y[first]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
