"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.llm.labelled import fold, training_sample
from vaultferry.llm.support import GOLDEN, mixed

FOLDS, HELD_OUT = 5, 0
TOXIC = 0.5

GRAMS = (3, 4, 5)  # characters, word borders included
ROWS = 1 << 17  # embedding rows that n-grams are hashed to
DIM = 4
GAIN = 60.0  # fixed factor on the averaged vector: a few words among hundreds must count
MEMO = 500_000  # distinct words whose score a task remembers
PASSES = 5
LEAST_STEPS = 400  # a small sample is passed more often
BATCH = 64
RATE = 0.02
SPARSE = 0.4  # how strongly n-grams that explain little are drawn to zero
LEAST = 5  # texts an n-gram must occur in
SAMPLE_ROWS = 6000  # labelled rows at most that the model is fitted on
EDGE = "\t\n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: str) -> list[str]:
    """Lower-case words between white space, without punctuation at their ends."""
    return [w for w in (t.strip(EDGE) for t in text.lower().split()) if w]


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the character n-grams of the words, and the word of each.

    A word of fewer than three characters has its borders and so still one n-gram.
    """
    points = np.frombuffer(
        "".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32
    )
    points = points.astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    rows, owners = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        usable = max(0, len(points) - n + 1)
        rolled = rolled[:usable] * GOLDEN + points[n - 1 : n - 1 + usable] + np.uint64(1)
        if n in GRAMS:
            inside = np.arange(usable) + n <= end[:usable]
            rows.append((mixed(rolled[inside]) % np.uint64(ROWS)).astype(np.int32))
            owners.append(owner[:usable][inside])
    return np.concatenate(rows), np.concatenate(owners)


@dataclass
class Bag:
    """Embeddings of n-gram rows and the softmax over (clean, toxic)."""

    embed: np.ndarray  # [ROWS, DIM]
    out: np.ndarray  # [DIM, 2]
    bias: np.ndarray  # [2]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Toxic minus clean logit that a word brings; the mean over its n-grams."""
        rows, owner = gram_rows(words)
        direction = self.embed @ (self.out[:, 1] - self.out[:, 0])
        count = np.bincount(owner, minlength=len(words))
        return np.bincount(owner, direction[rows], len(words)) / count


def probabilities(bag: Bag, texts: list[str], memo: dict[str, float]) -> np.ndarray:
    """Probability of toxic per text: softmax of the average over all words."""
    split = [tokens(t) for t in texts]
    fresh = list({w for words in split for w in words if w not in memo})
    if len(memo) + len(fresh) > MEMO:
        memo.clear()
        fresh = list({w for words in split for w in words})
    if fresh:
        memo.update(zip(fresh, bag.word_scores(fresh).tolist()))
    mean = np.array([sum(map(memo.__getitem__, words)) / max(1, len(words)) for words in split])
    logit = GAIN * mean + bag.bias[1] - bag.bias[0]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _sums(group: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
    """Sums of the rows of each group."""
    return np.stack(
        [np.bincount(group, rows[:, d], groups) for d in range(rows.shape[1])], axis=1
    )


@dataclass
class _Corpus:
    """Training texts as word counts, and the words' frequent n-grams as compact numbers."""

    docs: list[tuple[np.ndarray, np.ndarray]]  # word numbers, share of the text's words
    rows: np.ndarray  # embedding row of each compact n-gram
    grams: np.ndarray  # compact n-grams, word by word
    first: np.ndarray  # place of a word's first n-gram
    size: np.ndarray  # frequent n-grams of a word
    total: np.ndarray  # all n-grams of a word


def _spread(first: np.ndarray, size: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the n-grams of the given words, word by word."""
    take = size[words]
    return np.arange(take.sum()) - np.repeat(np.cumsum(take) - take - first[words], take)


def _corpus(texts: list[str]) -> _Corpus:
    """An n-gram of fewer than ``LEAST`` texts says nothing about others and is left out."""
    number: dict[str, int] = {}
    docs = []
    for text in texts:
        ids = np.array([number.setdefault(w, len(number)) for w in tokens(text)], np.int64)
        words, count = np.unique(ids, return_counts=True)
        docs.append((words, count / max(1, len(ids))))
    row, owner = gram_rows(list(number)) if number else (np.empty(0, np.int64),) * 2
    order = np.argsort(owner, kind="stable")
    row, owner = row[order], owner[order]
    total = np.bincount(owner, minlength=len(number))
    first = np.cumsum(total) - total
    seen = np.zeros(ROWS, np.int64)
    for words, _ in docs:
        seen[np.unique(row[_spread(first, total, words)])] += 1
    frequent = seen[row] >= LEAST
    rows, grams = np.unique(row[frequent], return_inverse=True)
    size = np.bincount(owner[frequent], minlength=len(number))
    return _Corpus(docs, rows, grams, np.cumsum(size) - size, size, np.maximum(total, 1))


def train(texts: list[str], labels: list[int], seed: int = 11) -> Bag:
    """Fit embeddings and softmax together by Adam on mini-batches.

    After each step every embedding is drawn towards zero by a fixed length, so n-grams that
    explain little vanish instead of learning the texts by heart. With labels of one class
    only, every text scores the share of ones.
    """
    rng = np.random.default_rng(seed)
    wanted = np.array(labels, np.int64)
    share = min(0.99, max(0.01, float(wanted.mean()))) if labels else 0.01
    bag = Bag(np.zeros((ROWS, DIM)), rng.normal(0, 1, (DIM, 2)), np.log([1 - share, share]))
    if len(set(labels)) < 2:
        return bag
    corpus = _corpus(texts)
    embed = rng.normal(0, 0.01, (len(corpus.rows), DIM))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (embed, bag.out, bag.bias)]
    per_pass = -(-len(texts) // BATCH)
    passes = max(PASSES, -(-LEAST_STEPS // per_pass))
    turn, turns = 0, passes * per_pass
    for _ in range(passes):
        shuffled = rng.permutation(len(texts))
        for at in range(0, len(shuffled), BATCH):
            batch = shuffled[at : at + BATCH]
            rate = RATE * (1 - turn / turns)
            turn += 1
            words, place = np.unique(
                np.concatenate([corpus.docs[i][0] for i in batch]), return_inverse=True
            )
            weight = GAIN * np.concatenate([corpus.docs[i][1] for i in batch])[:, None]
            doc = np.repeat(np.arange(len(batch)), [len(corpus.docs[i][0]) for i in batch])
            gram = corpus.grams[_spread(corpus.first, corpus.size, words)]
            owner = np.repeat(np.arange(len(words)), corpus.size[words])
            total = corpus.total[words][:, None]
            word_vectors = _sums(owner, embed[gram], len(words)) / total
            vectors = _sums(doc, weight * word_vectors[place], len(batch))
            logits = vectors @ bag.out + bag.bias
            logits -= logits.max(axis=1, keepdims=True)
            error = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), wanted[batch]] -= 1
            error /= len(batch)
            to_word = _sums(place, weight * (error @ bag.out.T)[doc], len(words)) / total
            slopes = (_sums(gram, to_word[owner], len(embed)), vectors.T @ error, error.sum(axis=0))
            for value, slope, (m, v) in zip((embed, bag.out, bag.bias), slopes, moments):
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                value -= rate * m / (1 - 0.9**turn) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
            length = np.sqrt((embed * embed).sum(axis=1, keepdims=True))
            embed *= np.maximum(0, 1 - rate * SPARSE / np.maximum(length, 1e-12))
    bag.embed[corpus.rows] = embed
    return bag


def scorer(bag: Bag) -> Callable[[Column], Column]:
    """Score of a text column, evaluated in Arrow batches."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, float] = {}
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            parts = [probabilities(bag, texts[i : i + 500], memo) for i in range(0, len(texts), 500)]
            yield pa.array(np.concatenate(parts or [np.empty(0)]), pa.float64())

    return score


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Bag:
    """Train on a bounded sample of ``labels(doc_id, toxic)`` outside the held-out fold."""
    texts, marks = training_sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows)
    return train([t.decode() for t in texts], marks)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` with ``held_out``, ``score`` (0 to 1, higher is more toxic), ``predicted``.

    Every whole text is scored from its words alone. Null and empty texts get the score of
    the bias; a null ``doc_id`` is not held out. Columns of these names are replaced. Without
    labels of both kinds the score is the share of ones.
    """
    score = scorer(fit(docs, labels))(F.col("text"))
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.withColumns({"held_out": held_out, "score": score}).withColumn(
        "predicted", (F.col("score") >= TOXIC).cast("int")
    )
