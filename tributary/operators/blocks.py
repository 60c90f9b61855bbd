"""Vector columns as blocks: matrix products and softmax states, one numpy call a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

Weights = dict[str, np.ndarray]


def block(column: pa.Array) -> np.ndarray:
    """Rows of an array column, none of them null, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def column(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * width), pa.array(values.ravel()))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, no negative zero; without the decimal that ``F.round`` makes of each value."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    with np.errstate(invalid="ignore"):  # infinities stay
        near = (whole + np.copysign(np.abs(y - whole) >= 0.5, y)) / 10.0**digits
    return np.where(np.isfinite(y), near, x) + 0.0


def _turned(values: pa.Array, weights: np.ndarray | Weights, rel: pa.Array | None) -> pa.Array:
    """Each row times the matrix, or times its relation's matrix; rows of other relations and nulls stay."""
    if values.null_count or (rel is not None and rel.null_count):
        rows = values.to_pylist()
        names = rel.to_pylist() if rel is not None else [None] * len(rows)
        out = [v if v is None or (w := weights.get(r) if isinstance(weights, dict) else weights) is None else (np.asarray(v) @ w).tolist() for v, r in zip(rows, names, strict=True)]
        return pa.array(out, pa.list_(pa.float64()))
    x = block(values) if len(values) else np.zeros((0, 1))
    if not isinstance(weights, dict):
        return column(x @ weights) if len(values) else values
    names, out = rel.to_numpy(zero_copy_only=False), x.copy()
    for name, w in weights.items():
        hit = names == name
        out[hit] = x[hit] @ w
    return column(out)


def turn(df: DataFrame, name: str, weights: np.ndarray | Weights | None, into: str | None = None, rel: str = "rel") -> DataFrame:
    """``df`` with the vectors of column ``name`` times a matrix, as column ``into`` (default: the same one).

    A dictionary has a matrix for each value of column ``rel``; rows of other values keep their vectors, null
    vectors stay null.  Square matrices in dictionaries; a single one may change the width.
    """
    if weights is None or isinstance(weights, dict) and not weights:
        return df if into is None or into == name else df.withColumn(into, F.col(name))
    into = into or name
    kept = [f for f in df.schema.fields if f.name != into]
    schema = StructType([*kept, StructField(into, ArrayType(DoubleType()))])
    weights = {k: np.asarray(w, float) for k, w in weights.items()} if isinstance(weights, dict) else np.asarray(weights, float)
    by_rel = isinstance(weights, dict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _turned(batch.column(name), weights, batch.column(rel) if by_rel else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], out], schema.names)

    return df.mapInArrow(run, schema).select(*[c for c in df.columns if c != into], into)


def combine(df: DataFrame, first: str, second: str, how: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` with column ``first`` replaced by ``how`` of both vector columns, a batch of rows at a time; ``second`` goes."""
    kept = [f for f in df.schema.fields if f.name not in (first, second)]
    schema = StructType([*kept, StructField(first, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = column(how(block(batch.column(first)), block(batch.column(second))))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], out], schema.names)

    return df.mapInArrow(run, schema)


class _States:
    """Softmax states (maximum, rescaled sum, rescaled vector) by key; merging two of a key is associative."""

    def __init__(self, keep: int = 20_000):
        self.keep, self.held = keep, []

    @staticmethod
    def merged(idx: np.ndarray, rel: np.ndarray, top: np.ndarray, total: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((rel, idx))
        idx, rel, top, total, vector = idx[order], rel[order], top[order], total[order], vector[order]
        first = np.flatnonzero(np.r_[True, (idx[1:] != idx[:-1]) | (rel[1:] != rel[:-1])])
        best = np.maximum.reduceat(top, first)
        w = np.exp(top - np.repeat(best, np.diff(np.r_[first, len(idx)])))
        return idx[first], rel[first], best, np.add.reduceat(total * w, first), np.add.reduceat(vector * w[:, None], first)

    def add(self, *state: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """Hold a batch's states; what is held goes out once merging no longer makes it small."""
        self.held.append(self.merged(*state))
        if sum(len(h[0]) for h in self.held) <= self.keep:
            return None
        self.held = [self.merged(*map(np.concatenate, zip(*self.held, strict=True)))]
        return self.held.pop() if len(self.held[0][0]) > self.keep // 2 else None

    def rest(self) -> tuple[np.ndarray, ...] | None:
        return self.merged(*map(np.concatenate, zip(*self.held, strict=True))) if self.held else None


def softmax_states(pairs: DataFrame, products: Weights, scale: float) -> DataFrame:
    """(idx, rel, top, total, vector): what each task knows of each node's softmax.

    ``pairs`` (idx, rel, q, v): a node's vector, a neighbour's.  A score is q M v / ``scale`` with the relation's matrix
    M in ``products`` (none: the plain product); vector is the sum of exp(score - top) v, total that of the weights.
    """
    products = {k: np.asarray(m, float) for k, m in products.items()}
    schema = "idx long, rel string, top double, total double, vector array<double>"

    def out(state: tuple[np.ndarray, ...], names: list[str]) -> pa.RecordBatch:
        idx, rel, top, total, vector = state
        return pa.RecordBatch.from_arrays([pa.array(idx), pa.array([names[r] for r in rel], pa.string()), pa.array(top), pa.array(total), column(vector)], ["idx", "rel", "top", "total", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, names, places = _States(), [], {}
        for batch in batches:
            if batch.num_rows:
                rel = batch.column("rel").dictionary_encode()
                seen = rel.dictionary.to_pylist()
                for name in seen:
                    if name not in places:
                        places[name] = len(names)
                        names.append(name)
                codes = np.array([places[n] for n in seen])[rel.indices.to_numpy(zero_copy_only=False)]
                q, v = block(batch.column("q")), block(batch.column("v"))
                turned = q.copy() if products else q
                for name, m in products.items():
                    if name in places:
                        hit = codes == places[name]
                        turned[hit] = q[hit] @ m
                score = np.einsum("ij,ij->i", turned, v) / scale
                full = states.add(batch.column("idx").to_numpy(zero_copy_only=False), codes, score, np.ones(len(score)), v)
                if full:
                    yield out(full, names)
        if rest := states.rest():
            yield out(rest, names)

    return pairs.select("idx", F.coalesce("rel", F.lit("")).alias("rel"), "q", "v").mapInArrow(run, schema)


def softmax_sums(states: DataFrame, width: int, max_scope: str) -> DataFrame:
    """(idx, rel, summed, all): states of all tasks merged by node and relation, rescaled to the maximum of the scope.

    A node has at most a state a relation and task, so even a hub's are few.
    """
    dealt = states.repartition("idx")
    top = F.max("top").over(Window.partitionBy("idx", *(["rel"] if max_scope == "type" else [])))
    scaled = dealt.withColumn("w", F.exp(F.col("top") - top))
    part = lambda i: F.sum(F.element_at("vector", i + 1) * F.col("w"))
    return scaled.groupBy("idx", "rel").agg(F.array(*[part(i) for i in range(width)]).alias("summed"), F.sum(F.col("total") * F.col("w")).alias("all"))
