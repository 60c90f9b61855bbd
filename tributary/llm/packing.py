"""Best-fit packing of documents into token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the histogram of lengths is all that the
plan needs: at most ``capacity`` rows, whatever the corpus.  On it:
1. Large lengths are sorted and cut into groups of equal cardinality; each is rounded up to
   its group's greatest.
2. Configurations of the few rounded sizes are optimised: column generation for the cutting
   stock program, whose whole parts are used.
3. The lengths themselves take the slots of their group, which leaves more room than rounding.
4. What is over and the small lengths go, greatest first, where they fit best: the sequence
   with the least room that is enough, else a new one.
All of this counts sequences by kind; it never lists documents.  The plan says, for ranks
from..to of one length, which sequence and offset each has, and documents look their place
up by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import materialise, small_batches
from tributary.llm.tokens import ids_of, json_encoding


@dataclass(frozen=True)
class PackingParams:
    """``large``: least shares of the capacity that configurations may plan; the best plan is taken.

    A low share leaves more to the configurations, whose rounding costs room; a high one leaves
    more small lengths to fill that room.  A plan costs about a second whatever the corpus.
    """

    capacity: int = 1024
    end_id: int = 2
    groups: int = 48
    large: tuple[float, ...] = (0.34, 0.42, 0.5)
    vocabulary: str = field(default_factory=lambda: public_tokenizers.path("byte_bpe_50k.json"))


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each size of greatest total value within the capacity (sizes may repeat)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = sizes <= room
        if fits.any():
            gain = np.where(fits, values + best[room - np.minimum(sizes, room)], -1.0)
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], last[room] = gain[k], k
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= sizes[last[room]]
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(counts by size, times) that meet at most the demand: whole parts of an optimal fractional plan.

    Column generation with a revised simplex over as many columns as there are sizes; new columns
    come from a knapsack over the dual prices.
    """
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    for _ in range(20 * n):
        inverse = np.linalg.inv(columns)
        duals = np.ones(n) @ inverse
        new = _knapsack(sizes, duals, capacity)
        if duals @ new <= 1 + 1e-9:
            break
        level, move = inverse @ demand, inverse @ new
        ratio = np.where(move > 1e-12, level / np.where(move > 1e-12, move, 1), np.inf)
        columns[:, int(ratio.argmin())] = new
    level = np.linalg.inv(columns) @ demand
    return [(columns[:, k].astype(np.int64), int(level[k] + 1e-9)) for k in range(n) if level[k] >= 1]


class _Plan:
    """Kinds of sequences: all sequences of a kind hold the same lengths in the same order."""

    def __init__(self, capacity: int):
        self.capacity, self.next_sequence = capacity, 0
        self.kinds: dict[int, list[tuple[int, int]]] = {r: [] for r in range(capacity + 1)}  # by room: (first sequence, how many)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, how many, first sequence, offset
        self.rank: dict[int, int] = {}

    def place(self, length: int, first: int, many: int, offset: int) -> None:
        rank = self.rank.get(length, 0)
        self.rows.append((length, rank, many, first, offset))
        self.rank[length] = rank + many

    def open(self, runs: list[list[tuple[int, int]]]) -> None:
        """New sequences, one for each position of the slots' runs; a run is (length, how many)."""
        runs, many = [list(r) for r in runs], sum(m for _, m in runs[0])
        while many:
            step = min(r[0][1] for r in runs)
            offset = 0
            for r in runs:
                length, left = r[0]
                self.place(length, self.next_sequence, step, offset)
                offset += length
                r[0] = (length, left - step)
                if left == step:
                    r.pop(0)
            self.kinds[self.capacity - offset].append((self.next_sequence, step))
            self.next_sequence += step
            many -= step

    def best_fit(self, length: int, many: int) -> None:
        for room in range(length, self.capacity + 1):
            while many and self.kinds[room]:
                first, there = self.kinds[room].pop()
                use = min(many, there)
                self.place(length, first, use, self.capacity - room)
                self.kinds[room - length].append((first, use))
                if there > use:
                    self.kinds[room].append((first + use, there - use))
                many -= use
            if not many:
                return
        each = self.capacity // length
        full, rest = divmod(many, each)
        for count, times in ((each, full), (rest, 1)):
            if count and times:
                self.open([[(length, times)]] * count)


def _take(stock: list[list[int]], many: int) -> list[tuple[int, int]]:
    """The greatest ``many`` of a group's (length, count) stock, as runs."""
    runs = []
    while many:
        length, count = stock[-1]
        use = min(count, many)
        runs.append((length, use))
        stock[-1][1] -= use
        many -= use
        if use == count:
            stock.pop()
    return runs


def plan(histogram: dict[int, int], params: PackingParams) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset) of the shortest plan found."""
    found = [_planned(histogram, params, large) for large in params.large]
    best = min(found, key=lambda p: p.next_sequence)
    return np.array(best.rows, np.int64).reshape(-1, 5)


def _planned(histogram: dict[int, int], params: PackingParams, least: float) -> _Plan:
    """Plan for counts by length 1..capacity, with configurations for lengths from ``least`` of it.

    Every length's ranks 0..count-1 are covered once.  Full lengths are alone.  Independent of the
    number of documents: at most a few thousand rows.
    """
    capacity = params.capacity
    out = _Plan(capacity)
    left = {k: v for k, v in histogram.items() if v > 0}
    if full := left.pop(capacity, 0):
        out.open([[(capacity, full)]])
    large = sorted((k, v) for k, v in left.items() if k >= least * capacity)
    total = sum(v for _, v in large)
    if large:
        groups: list[list[list[int]]] = []
        share, filled = -(-total // params.groups), 0
        for length, count in large:
            while count:
                if not groups or filled == share:
                    groups.append([])
                    filled = 0
                use = min(count, share - filled)
                groups[-1].append([length, use])
                filled, count = filled + use, count - use
        merged: dict[int, list[list[int]]] = {}
        for g in groups:  # groups that round to one size are one size
            merged.setdefault(g[-1][0], []).extend(g)
        sizes = np.array(sorted(merged))
        demand = np.array([sum(c for _, c in merged[s]) for s in sizes])
        stock = {int(s): sorted(map(list, merged[int(s)])) for s in sizes}
        for counts, times in configurations(sizes, demand, capacity):
            slots = [int(s) for s, c in zip(sizes, counts, strict=True) for _ in range(c)]
            times = min([times, *(sum(c for _, c in stock[int(s)]) // int(c0) for s, c0 in zip(sizes, counts, strict=True) if c0)])
            if times and slots:
                out.open([_take(stock[s], times) for s in reversed(slots)])
        for length, _ in large:
            left.pop(length)
        for g in stock.values():
            for length, count in g:
                left[length] = left.get(length, 0) + count
    for length in sorted(left, reverse=True):
        if left[length]:
            out.best_fit(length, left[length])
    return out


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task long, rank long"


def pieces(documents: DataFrame, params: PackingParams) -> DataFrame:
    """One row per piece with its rank among the pieces of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = json_encoding(params.vocabulary)
        task, seen = TaskContext.get().partitionId(), np.zeros(params.capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(ids_of(encoding, text or ""), np.array([params.end_id], "<u4")).astype("<u4", copy=False)
                first = len(ids) % params.capacity or params.capacity
                cuts = [0, *range(min(first, len(ids)), len(ids) + 1, params.capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), task, int(seen[hi - lo])))
                    seen[hi - lo] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(documents: DataFrame, params: PackingParams | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null text is empty text: its piece holds the end id alone.  Texts longer than the capacity
    are cut so that only the first piece is shorter.  Rows are packed one by one: repeated rows
    and null ids are documents of their own.  Very long texts give as many pieces as they need.  Equal
    lengths go in the order of tasks and rows.  Extra columns are ignored; no row gives no row.
    """
    params = params or PackingParams()
    cut = materialise(pieces(documents, params), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows = plan(histogram, params)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = (rows[:, 0] << 48) | rows[:, 1]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            sequence = rows[at, 3] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(length), batch.column(4), pa.array(sequence), pa.array(rows[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(starts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(locate, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
