"""The manifest against a plain recursive tree."""

import hashlib
import zlib

from pyspark.sql import functions as F

from tests.llm.cases import awkward, documents, prose
from vaultferry.llm.merkle import merkle_manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    return digest(
        "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
    )


def climb(nodes):
    """Root of some nodes, and the (before, after) siblings on the way of each."""
    ways = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for n, at in enumerate(place):
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            ways[n].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        place = [at // 8 for at in place]
    return nodes[0], ways


def lowered(row):
    i = row["doc_id"]
    if i is None or zlib.crc32(str(i).encode()) % 3:
        return row
    text = row["text"]
    plain = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return {**row, "text": plain}


def brute(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row["lang"], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        mine = sorted(
            langs[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))
        )
        trees.append((mine, *climb([leaf(r) for r in mine])))
    root, tops = climb([t[1] for t in trees])
    result = []
    for (mine, subroot, ways), top in zip(trees, tops):
        for row, way in zip(mine, ways):
            path = way + top
            node = leaf(lowered(row))
            for before, after in path:
                node = digest(before + node + after)
            proof = digest("".join(b + a for b, a in path))
            result.append((row["doc_id"], leaf(row), subroot, root, proof, node, node == root))
    return result


def check(df):
    rows = [r.asDict() for r in df.collect()]
    got = [tuple(r) for r in merkle_manifest(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    return got


def test_awkward_rows_and_small_trees(spark):
    rows = awkward()
    rows += [(100 + n, "Many LANGUAGES", f"x{n}", "src") for n in range(20)]
    rows += [(200 + n, None if n % 2 else "A b", "é" if n % 3 else "z", None) for n in range(9)]
    got = check(documents(spark, rows))
    assert {r[-1] for r in got} == {True, False}


def test_trees_of_several_blocks(spark):
    """1300 rows are three blocks, the last one short; one leaf alone is its subroot."""
    rows = [(n, f"Text {n}", "en", "s") for n in range(1300)]
    rows += [(5000 + n, "T", None, "s") for n in range(513)] + [(9999, "Alone", "zz", "s")]
    check(documents(spark, rows).repartition(5))


def test_repeated_rows_are_spread(spark):
    check(documents(spark, [(7, "Same", "en", "s")] * 700 + [(8, " ".join(prose(1, 30)))]))


def test_one_language_and_one_row(spark):
    check(documents(spark, [(n, "X", "en", "s") for n in range(8)]))
    (row,) = check(documents(spark, [(3, "x", "en", "s")]))
    assert row[1] == row[2] == row[3] and row[4] == digest("")


def test_empty_table_and_other_columns(spark):
    docs = documents(spark, [(1, "a")]).withColumns(
        {c: F.lit("x") for c in ("pos", "total", "node", "left", "block", "slice", "place")}
    )
    assert merkle_manifest(docs).count() == 1
    assert merkle_manifest(docs.limit(0)).collect() == []
