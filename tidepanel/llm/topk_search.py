"""Exact top-k search by inner product, with block-at-a-time pruning.

Candidates are dealt to shards of bounded size. In a shard they are ordered by the nearest and second nearest of some leading vectors and
cut into document-range blocks where the nearest leader changes, and within its run; a block keeps the largest and the smallest value of
every term (dimension) and its rows as a forward index. For a query, the sum over terms of the larger of weight * largest and weight *
smallest bounds every score in the block. Blocks are taken in falling order of that bound and scored through the forward index until the
bound is below the k-th best score.

Plan: queries are copied to every shard, the union is partitioned and sorted by shard with candidates first, and each task streams its
partition: the candidates of one shard are held as a matrix, queries pass by in Arrow batches. A first pass scores, in each shard, only the
block with the best bound; the k-th best of these scores is a floor that travels with the query through the second pass, so that a
shard without good blocks scores none. Each shard gives its k best for a query, and a ranking by query ends it. Memory is one shard, whose
bytes are bounded whatever the width; what is shuffled is candidates + queries * shards, twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import frames

#: Bytes of a shard's matrix at most, and rows from which a table is dealt to more shards so that all cores have one.
SHARD_BYTES = 64 << 20
SHARD_ROWS = 4096
BLOCK_ROWS = 32
LEADERS = 256
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", more: dict[str, Column] | None = None) -> DataFrame:
    """id, vec: floor(scale * x) of every component as long; and ``more``. Rows with a null id, or a vector that is null or holds a null or non-finite component, go."""
    extra = [c.alias(k) for k, c in (more or {}).items()]
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), *extra).filter("id IS NOT NULL AND vec IS NOT NULL")
    own = own.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return own.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale)))


def matrix(vectors: pa.ListArray, width: int | None = None) -> np.ndarray:
    """One row a vector, short ones filled with zeros, long ones cut to ``width``: what is cut has no partner to be multiplied with."""
    ends = np.asarray(vectors.offsets)
    sizes, values = np.diff(ends), np.asarray(vectors.values)
    most = width if width is not None else int(sizes.max(initial=0))
    if (sizes == most).all():
        return values[ends[0] : ends[-1]].reshape(len(sizes), most)
    out = np.zeros((len(sizes), most), dtype=np.int64)
    for i, n in enumerate(np.minimum(sizes, most)):
        out[i, :n] = values[ends[i] : ends[i] + n]
    return out


def _leaders(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second nearest leading vector of each row, a few thousand rows at a time."""
    leaders = rows[:: max(1, len(rows) // LEADERS)]
    half = (leaders**2).sum(axis=1) / 2
    first, second = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for at in range(0, len(rows), 4096):
        near = rows[at : at + 4096] @ leaders.T - half
        own = np.arange(len(near))
        first[at : at + 4096] = best = near.argmax(axis=1)
        near[own, best] = -np.inf
        second[at : at + 4096] = near.argmax(axis=1)
    return first, second


class Blocks:
    """The blocks of one shard. ``exact``: whether float64 holds every score and bound; else integers are summed in 64 bits, and nothing is pruned."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, exact: bool = True):
        self.exact = exact
        rows = rows.astype(np.float64) if exact else rows
        first, second = _leaders(rows) if exact else (np.zeros(len(ids), dtype=np.int64),) * 2
        order = np.lexsort((ids, second, first))
        self.ids, self.rows = ids[order], rows[order]
        turns = np.flatnonzero(np.append(True, np.diff(first[order]) != 0))
        run = np.repeat(turns, np.diff(np.append(turns, len(ids))))
        self.starts = np.flatnonzero((np.arange(len(ids)) - run) % BLOCK_ROWS == 0)
        self.sizes = np.diff(np.append(self.starts, len(ids)))
        self.most, self.least = np.maximum.reduceat(self.rows, self.starts), np.minimum.reduceat(self.rows, self.starts)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def score(self, blocks: np.ndarray, query_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of all rows of some blocks but the query's own, through the forward index."""
        sizes = self.sizes[blocks]
        rows = np.arange(int(sizes.sum())) + np.repeat(self.starts[blocks] - (np.cumsum(sizes) - sizes), sizes)
        rows = rows[self.ids[rows] != query_id]
        return self.ids[rows], (self.rows[rows] @ query).astype(np.int64)

    def first_scores(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` best scores of the block with the best bound."""
        return np.sort(self.score(np.array([bounds.argmax()]), query_id, query)[1])[::-1][:k]

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray | None, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ids and scores of the k best, ties to the smaller id, and the blocks scored; without scores below ``floor``.

        Blocks are taken a few more at a time, so a query ends in few steps.
        """
        order = np.arange(len(self.starts)) if bounds is None else np.argsort(-bounds, kind="stable")
        if bounds is not None:
            order = order[: np.searchsorted(-bounds[order], -floor, side="right")]
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at, step = 0, 1
        while at < len(order) and not (bounds is not None and len(scores) == k and bounds[order[at]] < scores[-1]):
            new = self.score(order[at : at + step], query_id, query)
            at, step = min(at + step, len(order)), step * 2
            ids, scores = np.concatenate([ids, new[0]]), np.concatenate([scores, new[1]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        good = scores >= floor
        return ids[good], scores[good], at


def _dealt(candidates: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """Candidates once and queries in every shard, partitioned and sorted by shard, candidates first."""
    own = candidates.select("id", "vec", F.lit(None).cast("double").alias("floor"), F.lit(0).alias("part"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard")
    both = own.unionByName(asked.select("id", "vec", "floor", F.lit(1).alias("part"), every))
    return both.repartition(shards, "shard").sortWithinPartitions("shard", "part")


def _shard_runs(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[tuple[Blocks, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each batch of queries: the blocks of their shard, ids, vectors, floors. Shards without candidates have none."""
    shard, held, blocks = None, [], None
    for batch in batches:
        key = np.asarray(batch.column("shard")) * 2 + np.asarray(batch.column("part"))
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            own = batch.slice(start, end - start)
            ids, vectors = np.asarray(own.column("id")), own.column("vec")
            if key[start] // 2 != shard:
                shard, held, blocks = key[start] // 2, [], None
            if key[start] % 2 == 0:
                held.append((ids, vectors))
                continue
            if held:
                blocks, held = Blocks(np.concatenate([x for x, _ in held]), matrix(pa.concat_arrays([x for _, x in held])), exact), []
            if blocks:
                floors = np.asarray(own.column("floor").fill_null(-np.inf))
                for first in range(0, len(ids), 256):
                    part = slice(first, first + 256)
                    asked = matrix(vectors.slice(first, 256), blocks.rows.shape[1])
                    yield blocks, ids[part], asked.astype(np.float64) if exact else asked, floors[part]


def _floors(candidates: DataFrame, asked: DataFrame, shards: int, k: int) -> DataFrame:
    """id, floor: the k-th best score of each query among the best blocks of all shards, where there are as many."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, ids, queries, _ in _shard_runs(batches, True):
            found = [blocks.first_scores(q, v, b, k) for q, v, b in zip(ids, queries, blocks.bounds(queries), strict=True)]
            owners = np.repeat(ids, [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(np.concatenate(found), pa.int64())], ["id", "score"])

    scores = frames.bounded_batches(_dealt(candidates, asked, shards)).mapInArrow(first, "id long, score long")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score")))
    return scores.withColumn("place", place).filter(F.col("place") == k).select("id", F.col("score").cast("double").alias("floor"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, seen: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best candidates, all if fewer; from two tables of id and vec (array<long>).

    The score is the integer inner product; components that the other vector lacks count as 0, so an empty vector scores 0. Ties go to
    the smaller vec_id. Candidates with the query's own id are left out. A repeated candidate row is a candidate each time; of query rows
    with one id the smallest vector asks. No queries or no candidates give no rows. Scores beyond 64 bits wrap around; where scores could pass
    2**53 nothing is pruned. Both tables are read more than once, and candidates are numbered as they come, so they must come in one order.

    ``seen``: two accumulators that get the blocks scored, and all blocks, of all queries in the second pass: what pruning saves.
    """
    largest = F.max(F.greatest(*[F.abs(x("vec").cast("double")) for x in (F.array_max, F.array_min)]))
    n, width, most = candidates.agg(F.count("*"), F.max(F.size("vec")), largest).first()
    asked_most = queries.agg(largest).first()[0]
    # two to the 53rd bounds the sums that float64 holds exactly
    exact = (width or 0) * (most or 0) * (asked_most or 0) < 2**53
    rows = max(BLOCK_ROWS, min(SHARD_BYTES // (8 * max(1, width or 0)), max(SHARD_ROWS, -(-n // candidates.sparkSession.sparkContext.defaultParallelism))))
    shards = max(1, -(-n // rows))
    asked = queries.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("floor", F.lit(None).cast("double"))
    if exact and shards > 1:
        asked = asked.drop("floor").join(_floors(candidates, asked, shards, k), "id", "left")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, ids, own, floors in _shard_runs(batches, exact):
            bounds = blocks.bounds(own) if exact else [None] * len(ids)
            found = [blocks.search(q, v, b, f, k) for q, v, b, f in zip(ids, own, bounds, floors, strict=True)]
            if seen:
                seen[0].add(sum(x[2] for x in found))
                seen[1].add(len(found) * len(blocks.starts))
            columns = [np.repeat(ids, [len(x[0]) for x in found]), np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = frames.bounded_batches(_dealt(candidates, asked, shards)).mapInArrow(search, FOUND)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
