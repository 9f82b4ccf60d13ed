"""Nearest neighbours by collision counting over single projections.

Every vector is projected on ``PROJECTIONS`` random directions, and each block of the index
keeps one sorted array per direction. A query opens a window around its own projection in every
array; the windows of radius R are wider by the same factor than those of radius 1, so a larger
radius only adds entries at both ends (virtual rehashing). A vector that lies in at least
``THRESHOLD`` of the windows is verified on the original components. A query's search of a block
ends when its ``k``-th distance found so far is no more than R, or all entries are counted.

A vector at distance R from the query lies in one window with probability 0.77, independently
for each direction, and so misses the threshold with probability 0.0031; there is no cap on
candidates. Equal vectors are one entry of the index with their smallest ``k + 1`` ids: as ties
go to the smaller id, no other copy can be among the ``k`` nearest of any query.

Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do
rows without an id. Vectors are compared with those of the same length only. A repeated row is
a candidate, and a query, of its own. Fewer candidates than ``k`` are all returned. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultferry.llm.support import arrow_rows, stored

PROJECTIONS = 48
# Windows a vector must lie in to be verified.
THRESHOLD = 29
# Half width of a window of radius 1, in standard deviations of a projected unit distance.
HALF_WIDTH = 1.2
# First radius, as a share of the spread of a block's projections, and growth of the radius.
FIRST_RADIUS, GROWTH = 0.1, 1.2
SEED = 20_011
# Distinct vectors of a block of the index, and queries that one job sends to every executor
# (8 bytes a component: 5 MB at 64 components).
BLOCK_ROWS = 16_384
QUERY_ROWS = 10_000

FOUND = T.StructType(
    [
        T.StructField("query", T.LongType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: components, all of them finite, not all zero."""
    infinite = F.lit(float("inf"))
    finite = F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < infinite), F.lit(False))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) in double precision of the rows that take part."""
    named = rows.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )
    return named.where(F.col("id").isNotNull() & usable(F.col("vector")))


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """Each different vector once, with the smallest ``k + 1`` ids of its rows.

    The limit is applied in every partition before the rows of a vector meet, so a vector
    that most rows share moves ``k + 1`` rows of each partition.
    """
    smallest = Window.partitionBy("vector").orderBy("id")
    few = vectors.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


@dataclass
class Best:
    """The nearest rows found so far of one query, and the radius they allow."""

    k: int
    ids: list[np.ndarray] = field(default_factory=list)
    scores: list[np.ndarray] = field(default_factory=list)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([*self.ids, ids]), np.concatenate([*self.scores, scores])
        order = np.lexsort((ids, scores))[: self.k]
        self.ids, self.scores = [ids[order]], [scores[order]]

    def radius(self) -> float:
        """Beyond it nothing can enter; infinite while fewer than ``k`` are known."""
        if not self.scores or len(self.scores[0]) < self.k:
            return np.inf
        return float(self.scores[0][-1])


class Block:
    """Some vectors of one length with a sorted array of projections for each direction."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray]):
        self.vectors, self.ids = vectors, ids
        size = vectors.shape[1]
        self.directions = np.random.default_rng([SEED, size]).standard_normal((size, PROJECTIONS))
        values = vectors @ self.directions
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(values, axis=0).T.copy()
        spread = float(np.median(values.std(axis=0)))
        self.first = max(spread * FIRST_RADIUS, 1e-9 * float(np.abs(values).max()), 1e-300)

    def search(self, query: np.ndarray, own: int, best: Best) -> None:
        """Add the block's nearest rows of a query to those it has; ``own`` is its id."""
        n = len(self.vectors)
        centres = query @ self.directions
        counts = np.zeros(n, dtype=np.int32)
        waiting = np.ones(n, dtype=bool)
        low = high = np.array([np.searchsorted(v, c) for v, c in zip(self.sorted, centres)])
        radius = self.first
        while True:
            reach = HALF_WIDTH * radius
            wide = [
                (np.searchsorted(v, c - reach, "left"), np.searchsorted(v, c + reach, "right"))
                for v, c in zip(self.sorted, centres)
            ]
            new_low = np.minimum(low, [x for x, _ in wide])
            new_high = np.maximum(high, [x for _, x in wide])
            entries = [
                part
                for row, a, b, c, d in zip(self.order, new_low, low, high, new_high)
                for part in (row[a:b], row[c:d])
            ]
            counts += np.bincount(np.concatenate(entries), minlength=n).astype(np.int32)
            low, high = new_low, new_high
            hits = np.flatnonzero(waiting & (counts >= THRESHOLD))
            if len(hits):
                waiting[hits] = False
                self.verify(query, own, hits, best)
            if best.radius() <= radius or ((low == 0).all() and (high == n).all()):
                return
            radius *= GROWTH

    def verify(self, query: np.ndarray, own: int, hits: np.ndarray, best: Best) -> None:
        """Exact distances of some entries; the query's own row is left out once."""
        apart = self.vectors[hits] - query
        scores = np.sqrt((apart * apart).sum(axis=1))
        close = scores <= best.radius()
        ids, values = [], []
        for at, score in zip(hits[close], scores[close]):
            mine = self.ids[at]
            if score == 0 and np.array_equal(self.vectors[at], query):
                here = np.flatnonzero(mine == own)[:1]
                mine = np.delete(mine, here)
            ids.append(mine)
            values.append(np.full(len(mine), score))
        if ids:
            best.add(np.concatenate(ids), np.concatenate(values))


def blocks_of(frame: pd.DataFrame) -> Iterator[Block]:
    """Blocks of the rows of a frame, one for each length of vector."""
    sizes = frame["vector"].map(len)
    for _, rows in frame.groupby(sizes):
        ids = [np.asarray(i, dtype=np.int64) for i in rows["ids"]]
        yield Block(np.array(rows["vector"].tolist(), dtype=np.float64), ids)


def _search(index: DataFrame, queries: list, k: int) -> DataFrame:
    """The nearest ``k`` rows of each query in every partition of the index.

    A partition's blocks are searched one after another, and what was found in the first
    bounds the radius in the next, so a partition returns ``k`` rows for each query.
    """
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = [(n, own, np.asarray(vector)) for n, own, vector in sent.value]
        best = {n: Best(k) for n, _, _ in asked}
        for frame in frames:
            for block in blocks_of(frame):
                for n, own, query in asked:
                    if len(query) == block.vectors.shape[1]:
                        block.search(query, own, best[n])
        for n, b in best.items():
            if b.ids:
                yield pd.DataFrame({"query": n, "vec_id": b.ids[0], "score": b.scores[0]})

    return index.mapInPandas(work, FOUND)


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    query_rows: int = QUERY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest rows of each query: query_id, rank, vec_id, score.

    The index is stored, spread evenly by a hash of the vector. Queries go to it in groups of
    about ``query_rows``; each group is one job over all blocks, and only groups reach the
    driver.
    """
    spark = rows.sparkSession
    asked = vectors_of(queries, id_column, vector_column)
    asked = stored(asked.withColumn("n", F.monotonically_increasing_id()), "queries")
    vectors = distinct_vectors(vectors_of(rows, id_column, vector_column), k)
    index = stored(vectors.repartition(F.xxhash64("vector")), "index")
    groups = max(1, -(-asked.count() // query_rows))
    group = F.pmod(F.xxhash64("n"), F.lit(groups))
    found = None
    for g in range(groups):
        part = [tuple(r) for r in asked.where(group == g).select("n", "id", "vector").collect()]
        with arrow_rows(spark, block_rows):
            hits = stored(_search(index, part, k), "hits", block_rows)
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = asked.select(F.col("n").alias("query"), F.col("id").alias("query_id"))
    return ranked.join(named, "query").select("query_id", "rank", "vec_id", "score")
