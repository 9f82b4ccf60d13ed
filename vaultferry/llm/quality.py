"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultferry.llm.labelled import SAMPLE_ROWS, fold, training_sample

FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7

DIM = 8  # embedding of a byte
STRIDE = 4  # bytes between two positions of a filter
FILTERS = 24
PANE = 256  # bytes; a chunk is two neighbouring panes, so chunks overlap by half
STEPS = PANE // STRIDE
STEP_BYTES = 1 << 20  # bytes of text that one numpy step handles
PASSES = 6
LEAST_STEPS = 300  # a small sample is passed more often
BATCH = 48
RATE = 0.01


@dataclass
class Network:
    """Weights: byte embeddings, filters over two strides, and the output unit."""

    embed: np.ndarray  # [256, DIM]
    left: np.ndarray  # [STRIDE * DIM, FILTERS], the first half of a filter
    right: np.ndarray  # the second half
    shift: np.ndarray  # [FILTERS]
    out: np.ndarray  # [FILTERS]
    bias: np.ndarray  # [1]

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.left, self.right, self.shift, self.out, self.bias]


def _fresh(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    scale = (2 * STRIDE * DIM) ** -0.5
    return Network(
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        rng.normal(0, scale, (STRIDE * DIM, FILTERS)).astype(np.float32),
        rng.normal(0, scale, (STRIDE * DIM, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    )


@dataclass
class Panes:
    """Texts laid out one after the other, each filled up with zero bytes to whole panes."""

    data: np.ndarray  # bytes
    first: np.ndarray  # first pane of each text
    count: np.ndarray  # panes of each text
    idle: np.ndarray  # steps that hold no byte of a text
    ends: np.ndarray  # last step of each text


def _lay_out(texts: list[bytes]) -> Panes:
    sizes = np.array([len(t) for t in texts])
    count = np.maximum(1, -(-sizes // PANE))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    data = np.frombuffer(
        b"".join(t.ljust(int(c) * PANE, b"\0") for t, c in zip(texts, count)), np.uint8
    )
    used = -(-sizes // STRIDE)
    start, stop = first * STEPS + used, (first + count) * STEPS
    idle = np.concatenate([np.arange(a, b) for a, b in zip(start, stop)])
    return Panes(data, first, count, idle.astype(np.int64), stop - 1)


def _activations(net: Network, panes: Panes) -> tuple[np.ndarray, np.ndarray]:
    """Embedded steps and filter outputs after the rectifier, ``[steps, FILTERS]``.

    A filter covers two strides of bytes. The last step of a text is followed by padding.
    """
    steps = net.embed[panes.data].reshape(-1, STRIDE * DIM)
    out = steps @ net.left
    out += net.shift
    second = steps @ net.right
    out[:-1] += second[1:]
    after = np.tile(net.embed[0], STRIDE) @ net.right
    inner = panes.ends[:-1]
    out[inner] += after - second[inner + 1]
    out[panes.ends[-1]] += after
    np.maximum(out, 0, out=out)
    out[panes.idle] = 0
    return steps, out


def _chunks(panes: Panes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second pane of every chunk, and its text. One pane alone is a chunk."""
    chunks = np.maximum(1, panes.count - 1)
    text = np.repeat(np.arange(len(chunks)), chunks)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    one = panes.first[text] + inside
    return one, one + (panes.count[text] > 1), text


def _features(net: Network, panes: Panes) -> np.ndarray:
    """Max-pooled chunks, averaged per text."""
    _, out = _activations(net, panes)
    top = out.reshape(-1, STEPS, FILTERS).max(axis=1)
    one, two, text = _chunks(panes)
    pooled = np.maximum(top[one], top[two])
    starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    return np.add.reduceat(pooled, starts, axis=0) / np.bincount(text)[:, None]


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _runs(net: Network, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """A long text pane by pane, some at a time: first pane, bytes, embedded steps, outputs.

    The bytes and steps of a run end with the step after it, which its last filter covers.
    """
    count, used = -(-len(text) // PANE), -(-len(text) // STRIDE)
    width = max(1, STEP_BYTES // PANE)
    for start in range(0, count, width):
        size = (min(start + width, count) - start) * PANE + STRIDE
        raw = text[start * PANE : start * PANE + size].ljust(size, b"\0")
        data = np.frombuffer(raw, np.uint8)
        steps = net.embed[data].reshape(-1, STRIDE * DIM)
        out = steps[:-1] @ net.left
        out += net.shift
        out += steps[1:] @ net.right
        np.maximum(out, 0, out=out)
        out[max(0, used - start * STEPS) :] = 0
        yield start, data.reshape(-1, STRIDE), steps, out.reshape(-1, STEPS, FILTERS)


def _pane_maxima(net: Network, text: bytes) -> np.ndarray:
    return np.concatenate([cells.max(axis=1) for _, _, _, cells in _runs(net, text)])


def _long_features(net: Network, text: bytes) -> np.ndarray:
    """Features of one long text; of every pane only the maxima are kept."""
    top = _pane_maxima(net, text)
    return np.maximum(top[:-1], top[1:]).mean(axis=0, dtype=np.float64).astype(np.float32)[None]


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """One probability per text, in steps of bounded size; a long text takes several."""
    parts, start = [], 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= STEP_BYTES):
            size += len(texts[end])
            end += 1
        if size > max(STEP_BYTES, PANE):
            features = _long_features(net, texts[start])
        else:
            features = _features(net, _lay_out(texts[start:end]))
        parts.append(_squash(features @ net.out + net.bias[0]))
        start = end
    return np.concatenate(parts).astype(np.float64) if parts else np.empty(0)


def _gradients(net: Network, texts: list[bytes], wanted: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss; only the step that won a pane's maximum gets any."""
    panes = _lay_out(texts)
    steps, out = _activations(net, panes)
    cells = out.reshape(-1, STEPS, FILTERS)
    winner = cells.argmax(axis=1)
    top = np.take_along_axis(cells, winner[:, None, :], axis=1)[:, 0, :]
    one, two, text = _chunks(panes)
    second = top[two] > top[one]
    pooled = np.where(second, top[two], top[one])
    chunks = np.bincount(text)
    starts = np.cumsum(chunks) - chunks
    features = np.add.reduceat(pooled, starts, axis=0) / chunks[:, None]
    error = ((_squash(features @ net.out + net.bias[0]) - wanted) / len(texts)).astype(np.float32)
    to_chunk = (error / chunks)[text][:, None] * net.out
    to_pane = np.zeros_like(top)
    np.add.at(to_pane, one, np.where(second, 0, to_chunk))
    np.add.at(to_pane, two, np.where(second, to_chunk, 0))
    to_pane[top <= 0] = 0
    at = (winner + np.arange(len(top))[:, None] * STEPS).ravel()
    filters = np.tile(np.arange(FILTERS), len(top))
    weight = to_pane.ravel()
    live = weight != 0
    at, filters, weight = at[live], filters[live], weight[live]
    ends = np.isin(at, panes.ends)
    padding = np.tile(net.embed[0], STRIDE)
    follow = np.where(ends[:, None], padding, steps[np.minimum(at + 1, len(steps) - 1)])
    d_left, d_right = np.zeros_like(net.left.T), np.zeros_like(net.right.T)
    np.add.at(d_left, filters, weight[:, None] * steps[at])
    np.add.at(d_right, filters, weight[:, None] * follow)
    d_embed = np.zeros_like(net.embed)
    byte = panes.data.reshape(-1, STRIDE)
    after = np.where(ends[:, None], 0, byte[np.minimum(at + 1, len(byte) - 1)])
    for half, seen in ((net.left, byte[at]), (net.right, after)):
        back = (weight[:, None] * half.T[filters]).reshape(-1, STRIDE, DIM)
        np.add.at(d_embed, seen.ravel(), back.reshape(-1, DIM))
    d_shift = np.bincount(filters, weight, FILTERS).astype(np.float32)
    return [d_embed, d_left.T, d_right.T, d_shift, features.T @ error, error.sum(keepdims=True)]


def _long_gradients(net: Network, text: bytes, wanted: np.float32) -> list[np.ndarray]:
    """Gradients of one long text: its panes are gone through twice, run by run."""
    top = _pane_maxima(net, text)
    second = top[1:] > top[:-1]
    features = np.maximum(top[:-1], top[1:]).mean(axis=0, dtype=np.float64).astype(np.float32)
    error = (_squash(features @ net.out + net.bias[0]) - wanted).astype(np.float32)
    to_chunk = (error / len(second) * net.out).astype(np.float32)
    to_pane = np.zeros_like(top)
    to_pane[:-1] += np.where(second, 0, to_chunk)
    to_pane[1:] += np.where(second, to_chunk, 0)
    to_pane[top <= 0] = 0
    d_embed = np.zeros_like(net.embed)
    d_left, d_right = np.zeros_like(net.left.T), np.zeros_like(net.right.T)
    d_shift = np.zeros_like(net.shift)
    for start, byte, steps, cells in _runs(net, text):
        weight = to_pane[start : start + len(cells)].ravel()
        at = (cells.argmax(axis=1) + np.arange(len(cells))[:, None] * STEPS).ravel()
        filters = np.tile(np.arange(FILTERS), len(cells))
        live = weight != 0
        at, filters, weight = at[live], filters[live], weight[live]
        np.add.at(d_left, filters, weight[:, None] * steps[at])
        np.add.at(d_right, filters, weight[:, None] * steps[at + 1])
        for half, seen in ((net.left, byte[at]), (net.right, byte[at + 1])):
            back = (weight[:, None] * half.T[filters]).reshape(-1, STRIDE, DIM)
            np.add.at(d_embed, seen.ravel(), back.reshape(-1, DIM))
        d_shift += np.bincount(filters, weight, FILTERS).astype(np.float32)
    return [d_embed, d_left.T, d_right.T, d_shift, features * error, np.array([error])]


def _batch_gradients(net: Network, texts: list[bytes], wanted: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss of a batch, in steps of bounded size as for scores."""
    total, start = None, 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= STEP_BYTES):
            size += len(texts[end])
            end += 1
        if size > max(STEP_BYTES, PANE):
            grads = _long_gradients(net, texts[start], wanted[start])
        else:
            grads = _gradients(net, texts[start:end], wanted[start:end])
        if end - start < len(texts):
            grads = [g * np.float32((end - start) / len(texts)) for g in grads]
        total = grads if total is None else [a + b for a, b in zip(total, grads)]
        start = end
    return total


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Network:
    """Fit all weights together by Adam. With one class only, the share of ones is the score."""
    net = _fresh(seed)
    wanted = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.out[:] = 0
        share = float(wanted.mean()) if len(wanted) else 0.5
        net.bias[0] = np.log((share + 0.01) / (1.01 - share))
        return net
    share = float(wanted.mean())
    net.bias[0] = np.log(share / (1 - share))
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    per_pass = -(-len(texts) // BATCH)
    passes = max(PASSES, -(-LEAST_STEPS // per_pass))
    turn, turns = 0, passes * per_pass
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            grads = _batch_gradients(net, [texts[i] for i in batch], wanted[batch])
            turn += 1
            rate = RATE * (1 - turn / (turns + 1))
            for value, grad, m, v in zip(net.parts(), grads, first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return net


def scorer(net: Network) -> Callable[[Column], Column]:
    """Score of a text column, evaluated in Arrow batches."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or b"" for t in batch.cast(pa.large_binary()).to_pylist()]
            yield pa.array(probabilities(net, texts), pa.float64())

    return score


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """Train on a bounded sample of ``labels(doc_id, quality)`` outside the held-out fold."""
    return train(*training_sample(docs, labels, "quality", FOLDS, HELD_OUT, rows))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` with ``held_out``, ``score`` (0 to 1, higher is better) and ``predicted``.

    Every whole text is scored from its bytes alone. Null and empty texts get the score of a
    text without any pattern; a null ``doc_id`` is not held out. Columns of these names are
    replaced. Without labels of both kinds the score is the share of ones.
    """
    score = scorer(fit(docs, labels))(F.col("text"))
    return docs.withColumns(
        {"held_out": F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)), "score": score}
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
