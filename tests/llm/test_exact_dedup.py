"""Chunk recipes: exact round trip, stability, and groups against brute force."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.cases import awkward, documents, small_limits
from vaultferry.llm import exact_dedup as xd


def noise(seed, n):
    return random.Random(seed).randbytes(n)


def test_chunks_join_to_the_text():
    texts = [b"", b"x", noise(1, 1023), noise(2, 1024), noise(3, 200_000), b"a" * 100_000]
    for text, parts in zip(texts, xd.chunks_of(texts)):
        assert b"".join(parts) == text
        assert all(len(p) <= xd.MOST for p in parts)
        assert all(len(p) >= xd.LEAST for p in parts[:-1])


def test_chunks_do_not_depend_on_neighbours():
    texts = [noise(n, 30_000 + n) for n in range(5)]
    assert xd.chunks_of(texts) == [xd.chunks_of([t])[0] for t in texts]


def test_an_insertion_moves_few_cuts():
    text = noise(9, 400_000)
    changed = text[:200_000] + b"inserted" + text[200_000:]
    (a,), (b,) = xd.chunks_of([text]), xd.chunks_of([changed])
    assert len(set(a) & set(b)) > 0.9 * len(a)


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_groups_equal_brute_force(spark):
    rows = [r[:2] for r in awkward()]
    rows += [(1000 + n, "hot text " * 700) for n in range(300)]
    rows += [(2000 + n, "hot text " * 700 + str(n % 3)) for n in range(30)]
    got = xd.exact_duplicates(documents(spark, rows)).collect()
    found = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got]
    assert sorted(found, key=repr) == sorted(brute(rows), key=repr)


def test_colliding_identifiers_are_told_apart(spark):
    rows = [
        (1, "h1", [(7, 3, b"aaa")]),
        (2, "h2", [(7, 3, b"bbb")]),
        (3, "h3", [(8, 3, b"ccc")]),
        (4, "h3", [(8, 3, b"ccc")]),
    ]
    cut = spark.createDataFrame(rows, xd.RECIPES)
    assert [r.short for r in xd.unsure_identifiers(cut).collect()] == [7]
    recipe = cut.select(xd._identifiers([7]).alias("r")).distinct()
    assert recipe.count() == 3


def test_empty_table(spark):
    assert xd.exact_duplicates(documents(spark, [])).collect() == []


def test_hot_text_is_split(spark, capsys):
    """The copies of one text are dealt over several tasks."""
    rows = spark.range(0, 40_000, 1, 8).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 > 0, "the page was not found").otherwise(
            F.concat(F.lit("text "), F.col("id") % 700)
        ).alias("text"),
    )
    with small_limits(spark):
        found = xd.exact_duplicates(rows)
        assert len(found.collect()) == 40_000
        found.explain()
        assert "skew=true" in capsys.readouterr().out
