"""The lookup table against a plain version; placement of awkward rows."""

from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import awkward, documents
from vaultferry.llm import sharding as sh

NAMES = [f"shard-{n}" for n in range(7)]


def plain_table(names, size):
    """Write out the permutations, then let the shards take turns."""
    lists = []
    for n in names:
        offset, skip = sh._number(f"offset:{n}") % size, sh._number(f"skip:{n}") % (size - 1) + 1
        lists.append([(offset + k * skip) % size for k in range(size)])
    owner = [None] * size
    while None in owner:
        for shard, wishes in enumerate(lists):
            free = next((w for w in wishes if owner[w] is None), None)
            if free is not None:
                owner[free] = shard
    return owner


def test_table_equals_plain_version():
    assert sh.lookup_table(NAMES, 101).tolist() == plain_table(NAMES, 101)


def test_table_is_even_and_stable():
    size = sh.table_size(7)
    before = sh.lookup_table(NAMES, size)
    counts = np.bincount(before)
    assert counts.max() - counts.min() <= 1
    after = sh.lookup_table([n for n in NAMES if n != "shard-3"], size)
    names = [n for n in NAMES if n != "shard-3"]
    stays = [NAMES[a] == names[b] for a, b in zip(before, after) if NAMES[a] != "shard-3"]
    assert np.mean(stays) > 0.7


def test_bad_parameters():
    for names, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sh.lookup_table(names, size)


def test_rows_and_columns_are_kept(spark):
    rows = awkward() + [(None, f"text {n}") for n in range(50)]
    docs = documents(spark, rows).selectExpr("*", "'old' as shard", "1 as llm_slot")
    got = sh.placed(docs, NAMES)
    assert got.columns == [c for c in docs.columns if c != "shard"] + ["shard"]
    found = got.collect()
    assert len(found) == len(rows) and {r.shard for r in found} <= set(range(7))
    assert len({r.shard for r in found if r.doc_id == 9}) == 1
    assert len(Counter(r.shard for r in found if r.doc_id is None)) > 3
    assert sh.placed(documents(spark, []), NAMES).collect() == []


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = documents(spark, [(n, f"text {n}") for n in range(200)])
    sh.write_shards(docs, f"{tmp_path}/out", NAMES, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.doc_id for r in back.collect()) == list(range(200))
