"""Near-duplicate groups against brute force, and the signatures against their definition."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import awkward, documents, prose, small_limits
from vaultferry.llm import near_dedup as nd
from vaultferry.llm.graph import components


def shingles(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows, percent):
    """Component per row, over ids; rows without id or words are alone."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if a is None or b is None or not s or not t:
                continue
            if a == b or 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [(i, len(s), (root(i) if s else i) if i is not None else None) for i, s in sets]


def key(row):
    return tuple((v is not None, v) for v in row)


def check(spark, rows, percent):
    got = nd.near_duplicates(documents(spark, rows), percent).collect()
    want = brute([r[:2] for r in rows], percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(
        want, key=key
    )
    for r in got:
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def variants(base, n, edits, first):
    """Copies of ``base``, each with its own replaced words."""
    out = []
    for v in range(n):
        words = list(base)
        for e in range(edits):
            words[(v * 37 + e * 29) % len(words)] = f"edit{v}x{e}"
        out.append((first + v, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [nd.BLOCK, 8])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = awkward()
    rows += [(100 + n, " ".join(prose(1, 60))) for n in range(30)]  # exact copies
    rows += variants(prose(2, 160), 40, 2, 200)  # star-shaped: two edits each
    base = prose(3, 120)  # a chain: neighbours are linked, the ends are not
    for n in range(8):
        rows.append((300 + n, " ".join(f"c{k}" if k < 4 * n else w for k, w in enumerate(base))))
    rows += [(400 + n, " ".join(prose(50 + n, 90))) for n in range(20)]
    check(spark, rows, 85)


def test_more_centres_join_groups_outside_the_largest(spark, monkeypatch):
    """Two groups in one bucket, both larger than a block: a second round of centres settles
    the members of the smaller one, and no links are lost or added."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    near, far = prose(11, 80), prose(12, 80)
    rows = variants(near, 30, 1, 0) + variants(far, 20, 1, 100)
    docs = documents(spark, rows)
    ids = [i for i, _ in rows]
    members = spark.createDataFrame([(1, i, 76, 0) for i in ids], "bucket bigint, vertex bigint, n_shingles bigint, centre bigint")
    groups = components(spark.createDataFrame([(0, i) for i in range(1, 30)], "a bigint, b bigint"))
    groups, rest = nd._more_centres(docs, members, groups, 80)
    sets = dict((i, shingles(t)) for i, t in rows)
    for r in groups.collect():
        assert (r.node < 100) == (r.component < 100)
    joined = {r.node for r in groups.collect() if r.node >= 100}
    linked = {i for i in ids if i >= 100 and any(
        i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in ids if j >= 100
    )}
    assert len(joined) > 1 and joined <= linked
    assert {r.vertex for r in rest.collect()} == set(ids)


@pytest.mark.parametrize("shingles_of_block", [nd.BLOCK_SHINGLES, 50])
def test_large_bucket_of_distinct_near_copies(spark, monkeypatch, shingles_of_block):
    """Several thousand texts in one group, or blocks cut by their shingles: nothing is lost."""
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", shingles_of_block)
    n = 3000 if shingles_of_block > 50 else 60
    rows = variants(prose(21, 200), n, 1, 0) + [(9000, " ".join(prose(22, 90)))]
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(documents(spark, rows), 85).collect()}
    assert got == {i: 0 for i in range(n)} | {9000: 9000}


def test_hot_bucket_is_split(spark, capsys):
    vertices = spark.range(0, 60_000, 1, 8).select(
        F.col("id").alias("vertex"),
        F.lit(9).cast("bigint").alias("n_shingles"),
        F.array(F.when(F.col("id") % 3 > 0, F.lit(-1).cast("bigint")).otherwise(F.col("id") % 900)).alias("bands"),
    )
    with small_limits(spark):
        members = nd._bucket_members(vertices)
        assert len(members.collect()) == 60_000
        members.explain()
        assert "skew=true" in capsys.readouterr().out


def test_threshold_is_exact(spark):
    # 20 shingles against 17 of them: 17 / 20 = 0.85 is a link, 16 / 20 is none.
    words = [f"w{n}" for n in range(24)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:21])), (3, " ".join(words[4:]))]
    check(spark, rows, 85)


def test_empty_table(spark):
    assert nd.near_duplicates(documents(spark, []), 85).collect() == []


@pytest.mark.parametrize("columns", [nd.COLUMNS, 7])
def test_blocks_equal_brute_force(monkeypatch, columns):
    """Exactly one link for each pair of groups that has any, and only true ones."""
    monkeypatch.setattr(nd, "COLUMNS", columns)
    rows = variants(prose(7, 90), 30, 1, 0) + variants(prose(7, 90), 10, 4, 100) + [(200, "a b")]
    outer = [n % 3 == 0 for n in range(len(rows))]
    classes = [i // 2 for i, _ in rows]
    table = pa.table(
        {"outer": outer, "id": [i for i, _ in rows], "class": classes, "text": [t for _, t in rows]}
    )
    got = nd._block_links(table, 80).to_pylist()
    sets = {i: shingles(t) for i, t in rows}
    group = dict(zip(sets, classes))

    def linked(a, b):
        x, y = sets[a], sets[b]
        return group[a] != group[b] and 100 * len(x & y) >= 80 * len(x | y)

    want = {
        frozenset((group[a], group[b]))
        for (a, _), o in zip(rows, outer)
        for (b, _), p in zip(rows, outer)
        if o and not p and linked(a, b)
    }
    assert want and all(linked(r["a"], r["b"]) for r in got)
    assert sorted(map(sorted, want)) == sorted(sorted((group[r["a"]], group[r["b"]])) for r in got)


def test_signature_is_the_smallest_offer():
    """Against SuperMinHash written as its definition says: one element after the other."""
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 40, dtype=np.uint64)
    want = [np.iinfo(np.uint64).max] * nd.SLOTS
    for e in elements:
        order = list(range(nd.SLOTS))
        for step in range(nd.SLOTS):
            start = int(e) + int(nd.GOLDEN) * (step + 1) & (2**64 - 1)
            draw = int(nd.mixed(np.array([start], np.uint64))[0])
            pick = step + ((draw & 0xFFFFFFFF) * (nd.SLOTS - step) >> 32)
            order[step], order[pick] = order[pick], order[step]
            want[order[step]] = min(want[order[step]], step << 32 | draw >> 32)
    got = nd.signatures(elements, np.zeros(40, np.int64), 1)[0]
    assert got.tolist() == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 2**63, 300, dtype=np.uint64)
    own = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.concatenate((shared, own[:100])), np.concatenate((shared, own[100:]))]
    got = nd.signatures(np.concatenate(sets), np.repeat([0, 1], 400), 2)
    assert abs((got[0] == got[1]).mean() - 0.6) < 0.12


def test_components_of_chain_star_and_ring(spark):
    links = [(n, n + 1) for n in range(1, 60)]
    links += [(100, n) for n in range(101, 160)]
    links += [(200 + n, 200 + (n + 1) % 30) for n in range(30)] + [(7, 7), (500, 500)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.component].add(r.node)
    assert {k: len(v) for k, v in groups.items()} == {1: 60, 100: 60, 200: 30}
