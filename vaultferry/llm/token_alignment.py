"""Alignment of two tokenizers' tokens over the same bytes, and corpus counts of linked ids.

Both tokenizers run over the whole text. Where a token of each begins with a space at the same
byte offset, the tokens before it end there too; such anchors cut a document into windows of
token ids. The alignment inside a window depends on its ids alone, so windows with the same two
id tuples are aligned once within a run of documents and share the result. Within a window, the offsets where tokens of both
sides end cut the groups.

Texts that are null, empty, or that either tokenizer does not give back byte by byte (as when
one folds characters) have no tokens: zeros and an empty ``groups_sha256``. Every row counts as
a document of its own, with a repeated or null ``doc_id`` too. Other columns are ignored. An
empty table gives no rows. Ties for an id's best partner all count as best.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultferry.llm.support import GOLDEN, mixed, stored

# Folder of the vocabulary files, the same on every machine.
TOKENIZERS = "/opt/tokenizers"
LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Ways to cut a text before its merges, as the left vocabulary was made for (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"
# Rows sent to Python at once, and letters of text tokenised and counted together.
BATCH_ROWS = 1000
RUN_LETTERS = 4_000_000
# Links of a group that are listed one by one.
LONG_GROUP = 4096
# Distinct id pairs (about 20 bytes each) that may be sent to every executor.
BROADCAST_PAIRS = 500_000

FOUND = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.LongType())),
    ]
)


def byte_letters() -> dict[str, int]:
    """Byte behind each letter of a byte-level vocabulary.

    Printable bytes stand for themselves; the others, in order, for the letters from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs of the given sizes, one run after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@lru_cache(maxsize=2)
def spelled_ids(most: int) -> tuple[np.ndarray, int]:
    """Each id in decimal before a comma, a bar and a semicolon, and the number of ids."""
    return np.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], dtype=object), most


class Side:
    """One tokenizer: the bytes of every id, their number, and whether they begin with a space."""

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = token_bytes
        self.lengths = np.array([len(t) for t in token_bytes], dtype=np.int64)
        self.marked = np.array([t.startswith(b" ") for t in token_bytes])
        self.flat = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def ids(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the tokens' bytes, joined, are these."""
        sizes = self.lengths[ids]
        if sizes.sum() != len(raw):
            return False
        return self.flat[spread(self.offsets[ids], sizes)].tobytes() == raw


class ByteLevel(Side):
    """Byte-level merges of a tokenizer file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = {t["content"] for t in content["added_tokens"]}
        letters = byte_letters()
        ranks = {
            bytes([letters[c] for c in entry]): i
            for entry, i in content["model"]["vocab"].items()
            if entry not in special
        }
        table = [b""] * (max(content["model"]["vocab"].values()) + 1)
        for entry, i in ranks.items():
            table[i] = entry
        super().__init__(table)
        # Merges in the file are in the order of their results' ids, which is what ranks mean.
        self.encoding = tiktoken.Encoding(
            path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(" " + text), dtype=np.int32)


class Pieces(Side):
    """Pieces of a sentence model, which itself puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        table = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                table.append(bytes([int(piece[3:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                table.append(b"")
            else:
                table.append(piece.replace(SPACE, " ").encode())
        super().__init__(table)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), dtype=np.int32)


@lru_cache(maxsize=4)
def sides(folder: str) -> tuple[Side, Side]:
    return ByteLevel(f"{folder}/{LEFT}"), Pieces(f"{folder}/{RIGHT}")


def anchors(
    a: np.ndarray, b: np.ndarray, left: Side, right: Side
) -> tuple[np.ndarray, np.ndarray]:
    """Token positions of both sides at which windows begin; the end of all tokens is last.

    Both texts begin with the same space, so the first tokens of a document are an anchor and
    documents can be laid end to end.
    """
    starts_a = np.cumsum(left.lengths[a]) - left.lengths[a]
    starts_b = np.cumsum(right.lengths[b]) - right.lengths[b]
    at_a, at_b = np.flatnonzero(left.marked[a]), np.flatnonzero(right.marked[b])
    _, i, j = np.intersect1d(
        starts_a[at_a], starts_b[at_b], assume_unique=True, return_indices=True
    )
    return np.append(at_a[i], len(a)), np.append(at_b[j], len(b))


def fingerprints(ids: np.ndarray, cuts: np.ndarray, seed: int) -> np.ndarray:
    """One number for each run of ids between cuts; equal runs have equal numbers."""
    place = np.arange(len(ids), dtype=np.uint64) - np.repeat(cuts[:-1], np.diff(cuts)).astype(np.uint64)
    words = mixed(ids.astype(np.uint64) + (place + np.uint64(seed)) * GOLDEN)
    return np.add.reduceat(words, cuts[:-1])


class Windows:
    """Alignments of a run's distinct id windows.

    Window n has ``sizes[n]`` groups, ``links[n]`` links, the text ``texts[n]`` and the pairs
    ``pairs[starts[n]:starts[n + 1]]`` as ``a * width + b``, each linked ``times`` times.
    ``numbers`` are the windows of the run's documents in order, ``ends`` where they end on
    the left side.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, left: Side, right: Side):
        """Cut the ids into windows and align each pair of id tuples once.

        Equal windows are brought together by fingerprint and compared id by id; should
        fingerprints ever collide, each window is aligned on its own.
        """
        self.left, self.right, self.width = left, right, len(right.bytes)
        cuts_a, cuts_b = anchors(a, b, left, right)
        size_a, size_b = np.diff(cuts_a), np.diff(cuts_b)
        marks = fingerprints(a, cuts_a, 1) ^ mixed(fingerprints(b, cuts_b, 2))
        _, first, place = np.unique(marks, return_index=True, return_inverse=True)
        same = first[place]
        if not (
            np.array_equal(size_a[same], size_a)
            and np.array_equal(size_b[same], size_b)
            and np.array_equal(a[spread(cuts_a[same], size_a)], a)
            and np.array_equal(b[spread(cuts_b[same], size_b)], b)
        ):
            first = place = np.arange(len(size_a))
        self.numbers, self.ends = place, cuts_a[1:]
        self._align(
            a[spread(cuts_a[first], size_a[first])],
            b[spread(cuts_b[first], size_b[first])],
            np.cumsum(size_a[first]),
            np.cumsum(size_b[first]),
        )

    def _align(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> None:
        """Align windows laid end to end: both sides of each have the same number of bytes."""
        size = len(last_a)
        ends_a, ends_b = np.cumsum(self.left.lengths[a]), np.cumsum(self.right.lengths[b])
        _, i, j = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        from_a, from_b = np.append(0, i[:-1] + 1), np.append(0, j[:-1] + 1)
        m, n = i + 1 - from_a, j + 1 - from_b
        window = np.searchsorted(last_a, i, "right")

        # All pairs of a group; in a long one only different ids are paired and multiplied.
        small = np.flatnonzero(m * n <= LONG_GROUP)
        count = (m * n)[small]
        group = np.repeat(small, count)
        r = spread(np.zeros(len(count), np.int64), count)
        pairs = a[from_a[group] + r // n[group]] * self.width + b[from_b[group] + r % n[group]]
        times, owner = np.ones(len(pairs), np.int64), window[group]
        for g in np.flatnonzero(m * n > LONG_GROUP):
            x, often_x = np.unique(a[from_a[g] : i[g] + 1], return_counts=True)
            y, often_y = np.unique(b[from_b[g] : j[g] + 1], return_counts=True)
            pairs = np.append(pairs, (x[:, None] * self.width + y).ravel())
            times = np.append(times, (often_x[:, None] * often_y).ravel())
            owner = np.append(owner, np.full(len(x) * len(y), window[g]))
        order = np.argsort(owner, kind="stable")
        self.pairs, self.times = pairs[order], times[order]
        self.starts = np.append(0, np.cumsum(np.bincount(owner, minlength=size)))
        self.sizes = np.bincount(window, minlength=size)
        self.links = np.zeros(size, np.int64)
        np.add.at(self.links, window, m * n)

        # Ids in the order of the digest: left ids of a group, then its right ids.
        kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        kind_a[i], kind_b[j] = 1, 2
        names, step = spelled_ids(max(len(self.left.bytes), self.width))
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(from_b, m)] = a + kind_a * step
        codes[np.arange(len(b)) + np.repeat(i + 1, n)] = b + kind_b * step
        written = names[codes].tolist()
        ends = (last_a + last_b).tolist()
        self.texts = ["".join(written[lo:hi]) for lo, hi in zip([0, *ends], ends)]

    def digest(self, lo: int, hi: int) -> str:
        """Of the groups of the windows at some places."""
        parts = "".join([self.texts[n] for n in self.numbers[lo:hi].tolist()])
        return hashlib.sha256(parts[:-1].encode()).hexdigest()

    def pair_counts(self, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct (document, pair), given each window's document, and how often it is linked."""
        starts = self.starts[self.numbers]
        size = self.starts[self.numbers + 1] - starts
        at = spread(starts, size)
        step = len(self.left.bytes) * self.width
        keys, times = np.repeat(doc * step, size) + self.pairs[at], self.times[at]
        if len(times) and times.max() > 1:
            keys, place = np.unique(keys, return_inverse=True)
            count = np.zeros(len(keys), np.int64)
            np.add.at(count, place, times)
        else:
            keys, count = np.unique(keys, return_counts=True)
        return keys // step, keys % step, count


def runs(texts: list[str | None], limit: int) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``limit`` characters together; a longer text is alone."""
    run, size = [], 0
    for text in texts:
        n = len(text) if text else 0
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += n
    if run:
        yield run


def align_texts(texts: list[str | None], left: Side, right: Side) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text."""
    none = np.zeros(0, np.int64)
    result: list[tuple] = []
    for run in runs(texts, RUN_LETTERS):
        ids_a, ids_b = [], []
        for text in run:
            a = left.ids(text) if text else none
            b = right.ids(text) if text else none
            raw = (" " + text).encode() if text else b""
            same = left.spells(a, raw) and right.spells(b, raw)
            ids_a.append(a if same else none)
            ids_b.append(b if same else none)
        sizes = np.array([len(a) for a in ids_a])
        if not sizes.sum():
            result.extend((0, 0, 0, 0, "", none, none) for _ in run)
            continue
        windows = Windows(
            np.concatenate(ids_a).astype(np.int64),
            np.concatenate(ids_b).astype(np.int64),
            left,
            right,
        )
        # Windows of a document: those that end within its tokens.
        doc = np.searchsorted(np.cumsum(sizes), windows.ends, "left")
        owner, pairs, times = windows.pair_counts(doc)
        each = np.arange(len(run) + 1)
        lo, cut = np.searchsorted(doc, each), np.searchsorted(owner, each)
        groups, links = windows.sizes[windows.numbers], windows.links[windows.numbers]
        for d, (a, b) in enumerate(zip(ids_a, ids_b)):
            mine, kept = slice(lo[d], lo[d + 1]), slice(cut[d], cut[d + 1])
            counts = len(a), len(b), int(groups[mine].sum()), int(links[mine].sum())
            digest = windows.digest(lo[d], lo[d + 1]) if len(a) else ""
            result.append((*counts, digest, pairs[kept], times[kept]))
    return result


def aligned(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row per document with its counts, digest and distinct linked id pairs, stored.

    ``pairs`` holds ``a * size of the right vocabulary + b``, ``times`` the links of each pair.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = sides(folder)
        for frame in frames:
            found = align_texts(frame["text"].tolist(), left, right)
            out = pd.DataFrame(found, columns=FOUND.names[2:])
            out.insert(0, "row", frame["row"].to_numpy())
            out.insert(1, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield out

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return stored(rows.mapInPandas(work, FOUND), "aligned", BATCH_ROWS)


def pair_frequencies(found: DataFrame, width: int) -> DataFrame:
    """Documents that hold each id pair linked, and whether no pair of its left id has more.

    Every document lists a pair once, so the count is an aggregate that combines before the
    shuffle. A left id has at most as many pairs as the right vocabulary has ids.
    """
    pairs = found.select(F.explode("pairs").alias("pair"))
    counts = stored(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "pairs")
    left = F.floor(F.col("pair") / F.lit(width)).alias("a")
    highest = counts.groupBy(left).agg(F.max("count").alias("highest"))
    named = counts.select("pair", "count", left).join(highest, "a")
    return named.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def token_alignment(
    docs: DataFrame, folder: str = TOKENIZERS, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """Counts of tokens, groups and links of every document, judged by corpus-wide counts.

    ``n_best`` links have the highest count of their left id; ``count_sum`` adds the counts of
    all links. The table of pairs is counted: a short one goes to every executor, a longer one
    is joined by a shuffle.
    """
    found = aligned(docs, folder)
    frequencies = stored(pair_frequencies(found, len(sides(folder)[1].bytes)), "frequencies")
    if frequencies.count() <= broadcast_pairs:
        frequencies = F.broadcast(frequencies)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    links = links.select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")
    )
    sums = (
        links.join(frequencies, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return found.join(sums, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
