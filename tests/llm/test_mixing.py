"""Budgets and selections against a plain version."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.cases import awkward, documents, prose
from vaultferry.llm.mixing import LEVELS, Mix, budgets, domain_of, mixed_documents

DOMAINS = ("web", "books")


def fill(budget, children):
    """Give every child its weighted part; what exhausted ones leave goes to the others."""
    given, left = {}, dict(children)
    while left:
        weight = sum(w for w, _ in left.values())
        short = [k for k, (w, cap) in left.items() if cap <= budget * w / weight + 1e-9]
        if not short:
            given.update({k: budget * w / weight for k, (w, _) in left.items()})
            break
        k = min(short, key=lambda c: left[c][1] / left[c][0])
        given[k] = left[k][1]
        budget -= left.pop(k)[1]
    return given


def plain_budgets(supply, budget, weights, above=()):
    caps = defaultdict(int)
    for leaf, n in supply.items():
        if leaf[: len(above)] == above:
            caps[leaf[len(above)]] += n
    parts = fill(budget, {k: (weights[len(above)].get(k, 1.0), c) for k, c in caps.items()})
    out = {}
    for name, part in parts.items():
        node = (*above, name)
        out.update({node: part} if len(node) == 3 else plain_budgets(supply, part, weights, node))
    return out


SUPPLY = {
    ("web", "en", "src0"): 1000,
    ("web", "en", "src2"): 40,
    ("web", "de", "src0"): 10,
    ("books", "en", "src1"): 300,
    ("books", "fr", "src3"): 5,
    ("books", "fr", "src5"): 0,
}
WEIGHTS = ({"web": 1.0, "books": 3.0}, {"en": 2.0}, {"src2": 4.0})


def test_budgets_equal_plain_version(spark):
    leaves = spark.createDataFrame([(*k, v) for k, v in SUPPLY.items()], [*LEVELS, "supply"])
    for total in (0, 7, 100, 400, 1200, 5000):
        mix = Mix(weights=WEIGHTS, tokens=total)
        got = {tuple(r)[:3]: r.quota for r in budgets(leaves, mix).collect()}
        want = plain_budgets(SUPPLY, min(total, sum(SUPPLY.values())), WEIGHTS)
        assert got == {k: int(v + 1e-6) for k, v in want.items()}


def test_siblings_make_up_before_ancestors(spark):
    leaves = spark.createDataFrame([(*k, v) for k, v in SUPPLY.items()], [*LEVELS, "supply"])
    got = budgets(leaves, Mix(weights=WEIGHTS, tokens=400)).collect()
    by_domain = Counter()
    for r in got:
        by_domain[r.domain] += r.quota
    # French books are short; English books take their part, the web gets no more.
    assert abs(by_domain["books"] - 300) <= 2 and abs(by_domain["web"] - 100) <= 3


def plain_mix(rows, mix):
    size = {i: len([w for w in (t or "").split()]) for i, t, *_ in rows}
    leaves = defaultdict(list)
    for i, _, lang, source in rows:
        domain = DOMAINS[int(source[3:]) % 2]
        leaves[domain, lang, source].append(i)
    supply = {k: sum(size[i] for i in v) * mix.epochs for k, v in leaves.items()}
    budget = sum(supply.values()) / mix.epochs * mix.share
    taken = Counter()
    for leaf, part in plain_budgets(supply, budget, mix.weights).items():
        left, epoch = int(part + 1e-6), 0
        while left > 0:
            order = sorted(
                (hashlib.md5(f"{mix.seed}:{epoch}:{i}".encode()).hexdigest()[:15], i)
                for i in leaves[leaf]
            )
            for _, i in order:
                if left > 0:
                    if size[i]:
                        taken[i, epoch, min(size[i], left)] += 1
                    left -= min(size[i], left)
            epoch += 1
    return taken


def test_selection_equals_plain_version(spark):
    rows = [
        (n, " ".join(prose(n, 5 + n % 23)), ("en", "de", "fr")[n % 3], f"src{n % 7 if n % 3 else 0}")
        for n in range(300)
    ]
    mix = Mix(weights=({"web": 1.0, "books": 2.5}, {"en": 3.0}, {}), share=0.8, epochs=3)
    docs = documents(spark, rows)
    got = mixed_documents(docs, domain_of(F.col("source"), DOMAINS), mix).where("n_tokens > 0")
    counts = Counter((r.row.doc_id, r.epoch, r.tokens_taken) for r in got.collect())
    assert counts == plain_mix(rows, mix)


def test_awkward_rows_keep_their_columns(spark):
    docs = documents(spark, awkward())
    mix = Mix(share=1.0, epochs=1)
    got = mixed_documents(docs, domain_of(F.col("source"), DOMAINS), mix)
    back = got.select("row.*")
    assert back.columns == docs.columns
    # The whole corpus is asked for: all rows with words come, each as often as it is there.
    some = lambda df: Counter(r.doc_id for r in df.collect() if (r.text or "").split())
    assert some(back) == some(docs)


def test_empty_table(spark):
    docs = documents(spark, [])
    assert mixed_documents(docs, domain_of(F.col("source"), DOMAINS), Mix()).collect() == []
