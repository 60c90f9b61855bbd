"""Vector tables for the searches: what takes part, blocks of queries, best rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITE = float("inf")


def usable(embedding: Column) -> Column:
    """Not null, and every component finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == INFINITE)
    return embedding.isNotNull() & ~F.exists(F.coalesce(embedding, F.array().cast("array<double>")), odd)


def one_by_id(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of usable rows; of rows with one id the least vector stays, a null id is left out."""
    v = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null").where(usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"))


def padded(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    """Rows of a list column as a matrix; a shorter vector counts as ending in zeros."""
    out = np.zeros((len(column), width), dtype)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(column):
        out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def doubles(column: pd.Series, width: int) -> np.ndarray:
    """A pandas column of lists as a matrix of doubles."""
    return padded(pa.array(column.tolist(), pa.list_(pa.float64())), width, np.float64)


def bounded_sample(rows: DataFrame, n: int, most: int) -> pa.Table:
    """At most ``most`` of ``n`` rows, the least by the hash of their id: alike at every partitioning.

    A threshold that about 1.2 times as many pass goes first, so the sort sees only those.
    """
    mark = F.xxhash64("vec_id", F.lit(17))
    if n > 4 * most:
        share = 1.2 * most / n + 100 / n
        rows = rows.where(mark < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return rows.orderBy(mark, "vec_id").limit(most).toArrow()


def shared_out(sizes: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first, many, n): cells in their order share parts of about ``per`` rows; a crowded one has ``many`` of its own."""
    lone = sizes > per
    begin = np.cumsum(np.where(lone, 0, sizes)) - 1
    first = np.maximum(begin, 0) // per
    many = np.where(lone, -(-sizes // per), 1)
    after = int(first.max()) + 1
    first = np.where(lone, after + np.cumsum(np.where(lone, many, 0)) - many, first)
    return first, many, int((first + many).max())


def numbered(rows: DataFrame, cell: str, first: np.ndarray, many: np.ndarray, name: str) -> DataFrame:
    """Add the part ``name`` that ``shared_out`` gives a row of ``cell``; a crowded cell is dealt by the hash of the id."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, mark = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (cell, "__mark"))
            yield batch.append_column(name, pa.array((first[at] + mark % many[at]).astype(np.int32)))

    marked = rows.withColumn("__mark", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)))
    schema = T.StructType([*marked.schema.fields, T.StructField(name, T.IntegerType())])
    return marked.mapInArrow(add, schema).drop("__mark")


def tile_counts(n_parts: int, n_blocks: int, part_bytes: int, block_bytes: int, tasks: int, most_bytes: int = 48 << 20) -> tuple[int, int]:
    """(rows, columns) of the grid of tiles: no side of a tile beyond ``most_bytes`` (or one part or block), ``tasks`` tiles
    if there are so many.  The index moves once a column, the queries once a row."""
    rows = -(-n_parts // max(1, most_bytes // part_bytes))
    columns = -(-n_blocks // max(1, most_bytes // block_bytes))
    rows = min(n_parts, max(rows, -(-tasks // columns)))
    return rows, min(n_blocks, max(columns, -(-tasks // rows)))


def tiled(index: DataFrame, blocks: DataFrame, counts: tuple[int, int], n_parts: int, n_blocks: int, find: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``find`` over tiles of index rows (part, ...) and query rows (block, parts, ...), ``parts`` being those a block asks.

    A tile meets in one task and holds each part and each block once, so what moves is the index once a column of
    tiles and the queries once a row; tiles that no block asks do not exist.
    """
    rows, columns = counts
    par = index.sparkSession.sparkContext.defaultParallelism
    tasks = min(rows * columns, max(4 * par, rows * columns // 4))
    right = blocks.withColumn("__column", F.expr(f"CAST(block * {columns}L DIV {n_blocks} AS INT)"))
    right = right.withColumn("__row", F.explode(F.array_distinct(F.expr(f"transform(parts, p -> CAST(p * {rows}L DIV {n_parts} AS INT))")))).drop("parts")
    tiles = right.select("__row", "__column").distinct().toDF("__row", "__at")
    left = index.withColumn("__row", F.expr(f"CAST(part * {rows}L DIV {n_parts} AS INT)")).join(tiles, "__row").withColumnRenamed("__at", "__column")
    left, right = (x.repartition(tasks, "__row", "__column").groupBy("__row", "__column") for x in (left, right))
    return left.cogroup(right).applyInArrow(find, schema)


class Best:
    """The k best (greatest score, then least id) of each query of a block."""

    def __init__(self, queries: np.ndarray, k: int, dtype: type):
        self.queries, self.k, self.dtype = queries, k, dtype
        self.least = np.iinfo(dtype).min if np.issubdtype(dtype, np.integer) else -np.inf
        self.scores = np.full((len(queries), k), self.least, dtype)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores [row, entry] of entries for some rows; a query's own id is left out."""
        scores = np.where(ids[None] == self.queries[rows, None], self.least, scores)
        live = (scores > self.scores[rows, -1:]) | ((scores == self.scores[rows, -1:]) & (ids[None] < self.ids[rows, -1:]))
        some = live.any(1)
        rows, scores = rows[some], scores[some]
        if not len(rows):
            return
        every = np.concatenate([self.scores[rows], scores], 1)
        names = np.concatenate([self.ids[rows], np.where(scores == self.least, np.iinfo(np.int64).max, np.broadcast_to(ids, scores.shape))], 1)
        descending = -every if self.dtype is np.float64 else ~every
        order = np.lexsort((names, descending), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(every, order, 1)
        self.ids[rows] = np.take_along_axis(names, order, 1)

    def add_pairs(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of (row, id) pairs, any number by row; a query's own id is left out."""
        keep = ids != self.queries[rows]
        touched = np.unique(rows[keep])
        if not len(touched):
            return
        rows = np.concatenate([rows[keep], np.repeat(touched, self.k)])
        scores = np.concatenate([scores[keep], self.scores[touched].ravel()])
        ids = np.concatenate([ids[keep], self.ids[touched].ravel()])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        best = place < self.k
        self.scores[rows[best], place[best]], self.ids[rows[best], place[best]] = scores[best], ids[best]

    @staticmethod
    def table(found: list[Best], dtype: type) -> pa.Table:
        """query_id, vec_id, score of several blocks."""
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.from_numpy_dtype(dtype))])
        return pa.Table.from_batches([b.batch() for b in found], schema)

    def batch(self) -> pa.RecordBatch:
        row, column = np.nonzero(self.ids != np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(self.queries[row]), pa.array(self.ids[row, column]), pa.array(self.scores[row, column])], ["query_id", "vec_id", "score"])


def ranked(found: DataFrame, k: int, *more: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what the tasks found for each query."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score", *more)
