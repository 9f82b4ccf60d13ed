"""Quality and toxicity: gradients, held-out accuracy, and awkward rows."""

import random
import zlib

import numpy as np
import pytest

from tests.compare import TESTDATA
from tests.llm.cases import awkward, documents, prose
from vaultferry.llm import quality as ql
from vaultferry.llm import toxicity as tx
from vaultferry.llm.labelled import training_sample


def test_network_gradients_are_slopes():
    texts = [b"", b"some bytes of text", bytes(range(256)) * 3, b"ab" * 700]
    wanted = np.array([0, 1, 1, 0], np.float32)
    net = ql._fresh(1)
    for p in net.parts():
        p += np.random.default_rng(2).normal(0, 0.05, p.shape).astype(np.float32)
    grads = ql._gradients(net, texts, wanted)

    def loss():
        p = np.clip(ql.probabilities(net, texts), 1e-9, 1 - 1e-9)
        return -(wanted * np.log(p) + (1 - wanted) * np.log(1 - p)).mean()

    rng = np.random.default_rng(3)
    for value, grad in zip(net.parts(), grads):
        direction = (rng.normal(size=value.shape) * 1e-3).astype(np.float32)
        value += direction
        up = loss()
        value -= 2 * direction
        down = loss()
        value += direction
        slope = float((grad * direction).sum())
        assert abs((up - down) / 2 - slope) < 0.1 * abs(slope) + 2e-6


def test_probability_does_not_depend_on_neighbours():
    net = ql._fresh(4)
    texts = [b"", b"x", b"abc" * 50, b"\xc3\xa9" * 400, b"words " * 3000]
    together = ql.probabilities(net, texts)
    alone = [ql.probabilities(net, [t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)
    assert ql.probabilities(net, []).size == 0


def noisy(seed):
    return " ".join(w + random.Random(seed).choice(["%%%", "$$$", "&&&"]) for w in prose(seed, 60))


def test_network_learns_noise():
    texts = [(" ".join(prose(n, 60)) if n % 3 else noisy(n)).encode() for n in range(300)]
    labels = [int(n % 3 > 0) for n in range(300)]
    net = ql.train(texts[:200], labels[:200])
    assert ((ql.probabilities(net, texts[200:]) >= ql.ACCEPT) == np.array(labels[200:])).mean() > 0.95


INSULT = ["grobian", "lumpenkerl", "schuftig"]


def insulted(seed, bad):
    rng, words = random.Random(seed), prose(seed, 200)
    for _ in range(4 if bad else 0):
        words[rng.randrange(len(words))] = rng.choice(INSULT)
    return " ".join(words)


def test_misspellings_share_subwords():
    texts = [insulted(n, n % 4 == 0) for n in range(600)]
    labels = [int(n % 4 == 0) for n in range(600)]
    bag = tx.train(texts[:400], labels[:400])
    assert ((tx.probabilities(bag, texts[400:], {}) >= 0.5) == np.array(labels[400:])).mean() > 0.97
    clean, known, unseen = bag.word_scores(["deßaé", "lumpenkerl", "lumpenkerrl"])
    assert known > clean and unseen > clean + 0.3 * (known - clean)


def test_memory_limit_does_not_change_scores(monkeypatch):
    bag = tx.train([insulted(n, n % 2 == 0) for n in range(60)], [1 - n % 2 for n in range(60)])
    texts = [insulted(n, False) for n in range(70, 80)]
    want = tx.probabilities(bag, texts, {})
    monkeypatch.setattr(tx, "MEMO", 10)
    memo = {}
    assert np.allclose(np.concatenate([tx.probabilities(bag, [t], memo) for t in texts]), want)


@pytest.mark.parametrize("module", [ql, tx])
def test_one_class_scores_its_share(module):
    texts = ["a b c", "d e f"] if module is tx else [b"a b c", b"d e f"]
    for labels, sign in (([1, 1], 1), ([0, 0], -1)):
        model = module.train(texts, labels)
        args = (model, texts, {}) if module is tx else (model, texts)
        assert (sign * (module.probabilities(*args) - 0.5) > 0).all()
    module.train([], [])


def test_awkward_rows(spark):
    docs = documents(spark, awkward())
    rows = [(9, 1, 0), (7, 0, 1), (7, 0, 1), (8, None, None), (None, 1, 1), (4, 1, 0), (77, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    for scores, folds, out in ((ql.quality_scores, 4, 2), (tx.toxicity_scores, 5, 0)):
        got = scores(docs, labels).collect()
        assert len(got) == len(awkward())
        for r in got:
            assert 0 <= r.score <= 1 and r.predicted in (0, 1)
            crc = None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
            assert r.held_out == (crc is not None and crc % folds == out)
        assert scores(docs.limit(0), labels).collect() == []
        assert len(scores(docs, labels.limit(0)).collect()) == len(awkward())


def test_sample_is_outside_the_fold(spark):
    docs = documents(spark, [(n, f"text {n}") for n in range(300)] + [(301, "x" * 99)])
    labels = spark.createDataFrame([(n, n % 2) for n in range(302)], "doc_id bigint, toxic int")
    texts, marks = training_sample(docs, labels, "toxic", 5, 0, rows=50, size=20)
    ids = [int(t.split()[1]) for t in texts]
    assert len(ids) == 50 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert marks == [i % 2 for i in ids]
    again = training_sample(docs.repartition(7), labels, "toxic", 5, 0, rows=50, size=20)
    assert again == (texts, marks)


def test_long_texts_are_in_the_sample(spark):
    docs = documents(spark, [(n, f"{n:03d}" * 10) for n in range(60)] + [(60, "x" * 99)])
    labels = spark.createDataFrame([(n, n % 2) for n in range(61)], "doc_id bigint, toxic int")
    texts, marks = training_sample(docs, labels, "toxic", 5, 0, rows=4, size=20)
    assert [len(t) for t in texts] == [30, 30]  # 80 bytes at most, no text alone is short
    assert marks == [int(t[:3]) % 2 for t in texts]


def test_gradients_of_a_batch_in_steps(monkeypatch):
    texts = [b"some bytes of text", bytes(range(256)) * 3, b"ab" * 700, b""]
    wanted = np.array([0, 1, 1, 0], np.float32)
    net = ql._fresh(1)
    whole = ql._gradients(net, texts, wanted)
    monkeypatch.setattr(ql, "STEP_BYTES", 1000)
    for a, b in zip(ql._batch_gradients(net, texts, wanted), whole):
        assert np.allclose(a, b, atol=1e-6)


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the test tables")
def test_held_out_accuracy(spark):
    folder = f"{TESTDATA}/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for scores, column, least in (
        (ql.quality_scores, "quality", 0.97),
        (tx.toxicity_scores, "toxic", 0.93),
    ):
        held = scores(docs, labels).where("held_out").join(labels, "doc_id")
        right = held.selectExpr(f"avg(cast(predicted = {column} as int)) as r").first().r
        assert right >= least, (column, right)


LABELS = "doc_id bigint, quality int, toxic int"


def test_one_long_text_keeps_no_other_out(spark):
    """A text near the bound, wherever its hash puts it, is passed over; both labels stay."""
    for long_id in range(20):
        rows = [(n, "x" * (380 if n == long_id else 5)) for n in range(20)]
        docs = documents(spark, rows)
        labels = spark.createDataFrame([(n, n % 2, n % 2) for n in range(20)], LABELS)
        texts, marks = training_sample(docs, labels, "toxic", 100, 99, rows=20, size=20)
        assert len(texts) >= 19 and set(marks) == {0, 1}
        if long_id > 2:
            break


def test_a_rare_label_is_in_the_sample(spark):
    docs = documents(spark, [(n, f"t{n}") for n in range(300)])
    labels = spark.createDataFrame([(n, 0, int(n == 7)) for n in range(300)], LABELS)
    texts, marks = training_sample(docs, labels, "toxic", 1000, 999, rows=30, size=20)
    assert marks.count(1) == 1 and 30 <= len(texts) <= 31


def plain_probability(net, text):
    """The network written out: one filter at one step at a time."""
    panes = max(1, -(-len(text) // ql.PANE))
    raw = text.ljust(panes * ql.PANE + ql.STRIDE, b"\0")
    tops = []
    for pane in range(panes):
        best = [0.0] * ql.FILTERS
        for step in range(ql.STEPS):
            at = pane * ql.PANE + step * ql.STRIDE
            if at >= len(text):
                continue
            one = np.concatenate([net.embed[b] for b in raw[at : at + ql.STRIDE]])
            two = np.concatenate([net.embed[b] for b in raw[at + ql.STRIDE : at + 2 * ql.STRIDE]])
            for f in range(ql.FILTERS):
                value = one @ net.left[:, f] + two @ net.right[:, f] + net.shift[f]
                best[f] = max(best[f], float(value))
        tops.append(best)
    pairs = list(zip(tops, tops[1:])) or [(tops[0], tops[0])]
    features = [np.mean([max(a[f], b[f]) for a, b in pairs]) for f in range(ql.FILTERS)]
    return 1 / (1 + np.exp(-(np.dot(features, net.out) + net.bias[0])))


def test_scores_equal_the_plain_network(monkeypatch):
    net = ql._fresh(3)
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 5, 256, 257, 700, 1500)]
    want = [plain_probability(net, t) for t in texts]
    assert np.allclose(ql.probabilities(net, texts), want, atol=1e-5)
    monkeypatch.setattr(ql, "STEP_BYTES", 600)
    assert np.allclose(ql.probabilities(net, texts), want, atol=1e-5)


def test_long_texts_in_runs(monkeypatch):
    """Scores and gradients of a text in several runs are those of the whole."""
    net = ql._fresh(5)
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (5000, 2048, 300, 4097)]
    wanted = np.array([1, 0, 1, 0], np.float32)
    scores, grads = ql.probabilities(net, texts), ql._batch_gradients(net, texts, wanted)
    monkeypatch.setattr(ql, "STEP_BYTES", 1024)
    assert np.allclose(ql.probabilities(net, texts), scores, atol=1e-6)
    for a, b in zip(ql._batch_gradients(net, texts, wanted), grads):
        assert np.allclose(a, b, atol=1e-5)
