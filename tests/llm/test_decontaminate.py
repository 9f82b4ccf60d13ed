"""Decontamination against brute force, on its short and its long path."""

import hashlib
import re

import pytest

from tests.llm.cases import awkward, documents, prose
from vaultferry.llm import decontaminate as dc
from vaultferry.llm.queries import op1_benchmark_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in items if i is not None)))
    return out


def key(row):
    return repr(row)


ITEM = prose(21, 40)
BENCH = [
    (1, " ".join(ITEM)),
    (2, " ".join(ITEM[10:30])),
    (3, "Short item, of SIX words here"),
    (4, "single"),
    (5, None),
    (6, "..."),
    (7, "a a a a a a a a a a a a a a a a"),
    (None, " ".join(prose(22, 15))),
    (10, " ".join(ITEM)),
]


def cases():
    filler = prose(23, 300)
    return [r[:2] for r in awkward()] + [
        (20, " ".join(filler[:50] + ITEM[5:18] + filler[50:90])),  # one window exactly
        (21, " ".join(filler[:50] + ITEM[5:17] + filler[50:90])),  # one word short of it
        (22, ", ".join(w.upper() if w.isascii() else w for w in ITEM)),
        (23, " ".join(filler + ITEM + filler)),
        (24, "short ITEM of six words here. Single!"),
        (25, "a " * 40),
        (26, " ".join(prose(22, 15) + filler)),
        (27, " ".join(ITEM[:13])),
        (27, " ".join(ITEM[:13])),
    ]


@pytest.mark.parametrize("broadcast_rows", [dc.BROADCAST_ROWS, 0])
def test_equal_to_brute_force(spark, broadcast_rows):
    docs = documents(spark, cases())
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    got = dc.benchmark_overlap(docs, bench, broadcast_rows=broadcast_rows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(
        brute(cases(), BENCH), key=key
    )


def test_merged_spans_cover_the_hits(spark):
    docs = documents(spark, cases())
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    for r in dc.merged_spans(dc.benchmark_overlap(docs, bench)).collect():
        ends = [(s.start, s.end) for s in r.hits]
        assert sum(b - a for a, b in ends) == r.n_hit
        assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    got = dc.benchmark_overlap(documents(spark, [(1, "a b c")]), empty).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got] == [(1, 3, 0, [])]
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    assert dc.benchmark_overlap(documents(spark, []), bench).collect() == []


def test_query_digest(spark, tmp_path):
    documents(spark, cases()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    want = {
        (i, n, h, hashlib.sha256(",".join(t).encode()).hexdigest(), h > 0 and 20 * h >= n)
        for i, n, h, t in brute(cases(), BENCH)
    }
    got = op1_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in got} == want
