"""Registered queries of the package against their SQL; the pipeline against its parts."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline as cp
from tests.compare import TESTDATA, duck, duck_rows, spark_rows
from tests.llm.cases import awkward, documents, prose
from tests.llm.test_decontaminate import BENCH, ITEM
from tests.llm.test_decontaminate import brute as overlap
from tests.llm.test_near_dedup import brute as near
from vaultferry.llm import quality as ql
from vaultferry.llm.queries import ORACLES, QUERIES
from vaultferry.llm.sharding import lookup_table, table_size

SF_DIR = str(TESTDATA / "sf0.001")
needs_tables = pytest.mark.skipif(not TESTDATA.exists(), reason="needs the test tables")


def test_all_operators_are_registered():
    names = driver.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) <= set(names) and "pipeline" in names


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = spark_rows(driver.queries()[name](spark, SF_DIR))
    assert got == duck_rows(duck(SF_DIR), ORACLES[name])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with labels and a benchmark, and awkward rows among the documents."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = awkward()
    for n in range(120):
        good = n % 4 > 0
        words = [w if good else w + "%%%" for w in prose(500 + n, 80)]
        rows.append((1000 + n, " ".join(words), ("en", "de")[n % 2], f"src{n % 5}"))
    base = prose(900, 150)
    for n in range(12):
        rows.append((2000 + n, " ".join(base[: 75 - n] + [f"new{n}"] + base[75 - n :]), "en", "src0"))
    rows += [(3000, " ".join(ITEM + prose(901, 60))), (3001, " ".join(ITEM[:13] + prose(902, 400)))]
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(1000 + n, int(n % 4 > 0), 0) for n in range(120)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet"
    )
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(
        f"{path}/benchmark.parquet"
    )
    return path


def test_every_stage_equals_a_plain_version(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for n, (_, stage) in enumerate(cp.STAGES):
        stage(spark, tables[-1], folder).write.parquet(f"{tmp_path}/{n}")
        tables.append(spark.read.parquet(f"{tmp_path}/{n}"))
    for df in tables[:-1]:
        assert df.columns == docs.columns
    whole = [sorted((tuple(r)[: len(docs.columns)] for r in t.collect()), key=repr) for t in tables]
    pairs = [[(r[0], r[1]) for r in rows] for rows in whole]

    # 1: the model's own decision on each text.
    net = ql.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = ql.probabilities(net, [(t or "").encode() for _, t in pairs[0]])
    assert pairs[1] == [p for p, s in zip(pairs[0], scores) if s >= ql.ACCEPT]
    assert not any("%%%" in (t or "") for _, t in pairs[1])

    # 2: one document of each group.
    kept, seen = [], set()
    for p, (i, _, component) in zip(pairs[1], near(pairs[1], cp.SIMILARITY)):
        if i is None or (component == i and i not in seen):
            kept.append(p)
            seen.add(i)
    assert pairs[2] == kept

    # 3: documents that overlap a benchmark too much go.
    found = overlap(pairs[2], BENCH)
    assert pairs[3] == [p for p, (_, n, h, _) in zip(pairs[2], found) if not h or 20 * h < n]
    assert 3000 not in {i for i, _ in pairs[3]} and 3001 in {i for i, _ in pairs[3]}

    # 4: at most the share of tokens, at least all but the last document of every leaf.
    assert set(pairs[4]) <= set(pairs[3])
    size = lambda rows: sum(len((t or "").split()) for _, t in rows)
    assert 0.8 * size(pairs[3]) < size(pairs[4]) <= size(pairs[3])

    # 5: every row is placed by the digest of its id.
    assert whole[5] == whole[4]
    slots = table_size(len(cp.SHARDS))
    owner = lookup_table(cp.SHARDS, slots)
    for r in tables[5].where(F.col("doc_id").isNotNull()).collect():
        assert r.shard == owner[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % slots]


def test_run_returns_the_last_stage(spark, folder):
    got = cp.run(spark, folder)
    assert got.columns[-1] == "shard" and got.count() > 0


def test_pipeline_on_empty_documents(spark, folder, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
