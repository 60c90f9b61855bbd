"""Approximate nearest neighbours by an inverted multi-index.

The halves of the vectors are quantised apart, each by its own codebook, so K centroids a half
give K^2 cells.  A query meets cells in the order of a sum over its halves, walked with a heap,
until the cells met hold enough entries; those entries are ranked by the true inner product.
A half's term is the inner product with the centroid plus ``spread`` standard deviations of what
the centroid's members may add to it, so that cells with long vectors come early.  A walk ends at a
sum; that sum is all that is kept of it, since a cell was met if its own sum is not greater.

Codebooks are fitted on a bounded sample; every row is indexed.  How many entries are enough is
measured: for a bounded sample of queries all rows are ranked, and the depth of the walk at which
a share ``target`` of their true neighbours is met becomes the depth of every walk.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import materialise
from tributary.llm.vectors import Best, bounded_sample, doubles, numbered, one_by_id, padded, ranked, shared_out, tile_counts, tiled


@dataclass(frozen=True)
class MultiIndexParams:
    """``sample`` rows fit the codebooks, ``calibration`` queries the depth; centroids a half grow as the root
    of the rows over ``per_cell`` up to ``max_centroids``, which bounds the table of cells that tasks hold.
    Entries lie in parts of about ``part_rows``, queries in blocks of ``block``."""

    k: int = 20
    query_divisor: int = 20
    sample: int = 20_000
    calibration: int = 128
    target: float = 0.95
    per_cell: float = 2.5
    max_centroids: int = 256
    spread: float = 2.0
    iterations: int = 12
    block: int = 256
    part_rows: int = 4096


def kmeans(points: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """Lloyd's centroids from a fixed start; k at most the number of distinct points."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(11)
    centroids = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]]
    for _ in range(iterations):
        near = nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * points @ centroids.T).argmin(1)


@dataclass(frozen=True)
class Codebook:
    """Centroids of one half and the deviation by component of their members."""

    centroids: np.ndarray
    deviation: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, k: int, iterations: int) -> Codebook:
        if not points.shape[1]:
            return cls(np.zeros((1, 0)), np.zeros(1))
        centroids = kmeans(points, k, iterations)
        near = nearest(points, centroids)
        n = np.bincount(near, minlength=len(centroids))
        apart = np.bincount(near, ((points - centroids[near]) ** 2).sum(1), len(centroids))
        return cls(centroids, np.sqrt(apart / np.maximum(n, 1) / points.shape[1]))

    def dissimilarity(self, queries: np.ndarray, spread: float) -> np.ndarray:
        """[query, centroid]: less is nearer."""
        return -(queries @ self.centroids.T) - spread * np.sqrt((queries**2).sum(1))[:, None] * self.deviation


def cells_met(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of first[i] + second[j] until they hold ``wanted`` entries (multi-sequence walk)."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, rows, columns = first[a].tolist(), second[b].tolist(), (a * len(b)).tolist(), b.tolist()
    heap, cells, held = [(x[0] + y[0], 0, 0)], [], 0
    n, m, held_by = len(x), len(y), sizes.tolist() if len(sizes) <= 4096 else sizes
    push, pop = heapq.heappush, heapq.heappop
    while heap and held < wanted:
        _, i, j = pop(heap)
        cell = rows[i] + columns[j]
        if held_by[cell]:
            cells.append(cell)
            held += held_by[cell]
        # each pair has one way in: along its row, or down the first column
        if j + 1 < m:
            push(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < n:
            push(heap, (x[i + 1] + y[0], i + 1, 0))
    return cells


def depth_of(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many entries a full walk has met when it has met each of ``cells``."""
    order = np.argsort((first[:, None] + second).ravel(), kind="stable")
    met = np.empty(len(order), np.int64)
    met[order] = np.cumsum(sizes[order])
    return met[cells]


def cutoff(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> float:
    """The sum at which a walk ends."""
    last = cells_met(first, second, sizes, wanted)[-1]
    return first[last // len(second)] + second[last % len(second)]


def rerank(best: Best, queries: np.ndarray, entries: np.ndarray, names: np.ndarray, met: np.ndarray | None = None) -> None:
    """Rank entries by inner product for the queries that met their cells ([query, entry]; none: all did).

    One matrix product finds the pairs that can still matter; their scores are then summed in one
    order for every pair, so that copies tie exactly.
    """
    met = np.ones((len(queries), len(entries)), bool) if met is None else met
    asked = np.flatnonzero(met.any(1))
    if not len(asked):
        return
    rough = np.where(met[asked], queries[asked] @ entries.T, -np.inf)
    enough = min(best.k + 1, rough.shape[1])  # one more: the query itself may be among them
    least = np.maximum(np.partition(rough, -enough, axis=1)[:, -enough], best.scores[asked, -1])
    size = np.sqrt((queries[asked] ** 2).sum(1) * (entries**2).sum(1).max(initial=0))
    row, column = np.nonzero((rough >= (least - 1e-12 * size)[:, None]) & np.isfinite(rough))
    for lo in range(0, len(row), 100_000):
        r, c = asked[row[lo : lo + 100_000]], column[lo : lo + 100_000]
        best.add_pairs(r, (queries[r] * entries[c]).sum(1), names[c])


def approximate_neighbours(vectors: DataFrame, params: MultiIndexParams = MultiIndexParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products found for every query.

    Queries are the ids divisible by ``query_divisor``, candidates every other id.  Ties go to the
    lesser id; with fewer candidates all are returned.  Vectors that are null, zero or hold null or
    non-finite components take no part; a shorter vector counts as ending in zeros; repeated ids
    count once (the least vector).  Extra columns are ignored; an empty table gives no row.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    whole = materialise(one_by_id(vectors).where(F.exists("v", lambda x: x != 0)), "vectors")
    asks = F.col("vec_id") % params.query_divisor == 0
    facts = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if(asks).alias("queries")).first()
    n, width = facts["n"], facts["width"]
    if not facts["queries"]:
        return empty
    half = (width + 1) // 2
    sample = padded(bounded_sample(whole, n, params.sample)["v"].combine_chunks(), width, np.float64)
    k = int(np.clip(np.sqrt(n / params.per_cell), 2, params.max_centroids))
    one, two = (Codebook.fit(part, k, params.iterations) for part in (sample[:, :half], sample[:, half:]))
    second = len(two.centroids)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = padded(batch.column(1), width, np.float64)
            cell = nearest(x[:, :half], one.centroids) * second + nearest(x[:, half:], two.centroids)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

    placed = materialise(whole.mapInArrow(quantise, "vec_id long, v array<double>, cell int"), "placed")
    sizes, asking = np.zeros((2, len(one.centroids) * second), np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(asks).alias("asking")).collect():  # at most max_centroids^2 rows
        sizes[r["cell"]], asking[r["cell"]] = r["n"], r["asking"]

    # neighbouring cells share a part, their queries a block; a crowded cell is dealt over parts of its own
    part, many, parts = shared_out(sizes, params.part_rows)
    block, blocks_of, blocks = shared_out(asking, params.block)

    def stack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        entries = doubles(rows["v"], width)
        return pd.DataFrame({"part": [key[0]], "names": [rows["vec_id"].tolist()], "cells": [rows["cell"].tolist()], "entries": [entries.tobytes()]})

    dealt = numbered(placed, "cell", part, many, "part").repartition(parts, "part")
    index = materialise(dealt.groupBy("part").applyInPandas(stack, "part int, names array<long>, cells array<int>, entries binary"), "index")

    def terms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return one.dissimilarity(x[:, :half], params.spread), two.dissimilarity(x[:, half:], params.spread)

    def depths() -> np.ndarray:
        """Depths at which walks of sampled queries meet their true neighbours."""
        chosen = bounded_sample(whole.where(asks), facts["queries"], params.calibration)
        ids, x = chosen["vec_id"].to_numpy(), padded(chosen["v"].combine_chunks(), width, np.float64)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    best, names = Best(ids, params.k, np.float64), np.array(row["names"])
                    rerank(best, x, np.frombuffer(row["entries"]).reshape(-1, width), names)
                    out = best.batch()
                    at = np.searchsorted(names, out.column(1).to_numpy())
                    yield out.append_column("cell", pa.array(np.array(row["cells"], np.int32)[at]))

        found = index.mapInArrow(look, "query_id long, vec_id long, score double, cell int")
        true = ranked(found, params.k, "cell").toPandas()  # at most calibration * k rows
        a, b = terms(x)
        at = {q: i for i, q in enumerate(ids.tolist())}
        return np.concatenate([np.zeros(0, np.int64), *(depth_of(a[at[q]], b[at[q]], sizes, g["cell"].to_numpy()) for q, g in true.groupby("query_id"))])

    measured = depths()
    wanted = max(int(np.quantile(measured, params.target)) if len(measured) else n, params.k + 1)

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """A block's vectors, the sums where their walks end and the parts that any of them meets."""
        x, met = doubles(rows["v"], width), np.zeros(len(sizes), bool)
        a, b = terms(x)
        ends = np.array([cutoff(p, q, sizes, wanted) for p, q in zip(a, b, strict=True)])
        for p, q, end in zip(a, b, ends, strict=True):
            met |= (p[:, None] + q <= end).ravel()
        cells = np.flatnonzero(met & (sizes > 0))
        asked = np.unique(np.concatenate([part[cells[many[cells] > j]] + j for j in range(int(many[cells].max()))]))
        return pd.DataFrame({"block": [int(key[0])], "parts": [asked.tolist()], "ids": [rows["vec_id"].tolist()], "queries": [x.tobytes()], "ends": [ends.tobytes()]})

    asked = numbered(placed.where(asks), "cell", block, blocks_of, "block").repartition(blocks, "block")
    walked = materialise(asked.groupBy("block").applyInPandas(walk, "block int, parts array<int>, ids array<long>, queries binary, ends binary"), "walked")

    def find(tile: pa.Table, asking: pa.Table) -> pa.Table:
        held, found = [], []
        for row in tile.select(["names", "cells", "entries"]).to_pylist():
            held.append((np.array(row["names"]), np.array(row["cells"]), np.frombuffer(row["entries"]).reshape(-1, width)))
        for row in asking.select(["ids", "queries", "ends"]).to_pylist() if held else []:
            x, ends = np.frombuffer(row["queries"]).reshape(-1, width), np.frombuffer(row["ends"])
            a, b = terms(x)
            found.append(Best(np.array(row["ids"]), params.k, np.float64))
            for names, cells, entries in held:
                met = a[:, cells // second] + b[:, cells % second] <= ends[:, None]
                some = met.any(0)
                rerank(found[-1], x, entries[some], names[some], met[:, some])
        return Best.table(found, np.float64)

    tasks = 4 * spark.sparkContext.defaultParallelism
    counts = tile_counts(parts, blocks, 8 * width * params.part_rows, 8 * width * params.block, tasks)
    return ranked(tiled(index, walked, counts, parts, blocks, find, "query_id long, vec_id long, score double"), params.k)
