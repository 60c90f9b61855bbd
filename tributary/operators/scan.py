"""Running values within keys, without bringing a key to one task.

Rows are dealt by ranges of (keys, order), so a key with many rows lies in many partitions.  Each
partition is read once, in order, and what it cannot know of the rows before it is one state a
partition: how it begins and ends.  The states of the partitions before give what is carried in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tributary.operators.prefix import written


@dataclass(frozen=True)
class Running:
    """What to add to rows ordered by (keys, order).

    ``sums``: column of whole numbers -> name of its running sum within the key, the row included, nulls as 0.
    ``back``: column -> (name, most): list of the values of up to ``most`` rows before within the key, nulls left out.
    ``gaps``: (column, limit, name): running count over all rows of those that begin a key or follow a null or a
    value that is smaller by more than ``limit``.
    ``blocks``: (name, rows): partitions are cut into blocks of so many rows, whose number is ``name``; name_at is the
    place in the block.  A list of ``back`` is then given at place 0 only, with its nulls, and is empty elsewhere;
    list_size is the number of rows that it is of, so the rows of a block tell all its lists.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    sums: dict[str, str] = field(default_factory=dict)
    back: dict[str, tuple[str, int]] = field(default_factory=dict)
    gaps: tuple[str, int, str] | None = None
    blocks: tuple[str, int] | None = None

    @property
    def added(self) -> list[str]:
        lists = [name for name, _ in self.back.values()]
        return [*self.sums.values(), *lists, *([self.gaps[2]] if self.gaps else []), *([self.blocks[0], f"{self.blocks[0]}_at", *[f"{n}_size" for n in lists]] if self.blocks else [])]


def _same(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each value equals the one before it; null equals null."""
    first = pa.nulls(1, column.type) if before is None else pa.array([before.as_py()], column.type)
    previous = pa.concat_arrays([first, column.slice(0, len(column) - 1)])
    equal = pc.fill_null(pc.equal(column, previous), False)
    out = pc.or_(equal, pc.and_(pc.is_null(column), pc.is_null(previous))).to_numpy(zero_copy_only=False).copy()
    if before is None:
        out[0] = False
    return out


class _Partition:
    """Reads the batches of one partition in order."""

    def __init__(self, spec: Running, part: int):
        self.spec, self.part = spec, part
        self.last: dict[str, pa.Scalar] = {}
        self.first: dict[str, object] = {}
        self.run_rows = self.runs = self.starts = self.rows = 0
        self.run_sums = dict.fromkeys(spec.sums, 0)
        self.tails: dict[str, pa.Array] = {}

    def read(self, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        spec, n = self.spec, batch.num_rows
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        same = np.logical_and.reduce([_same(column(k), self.last.get(k)) for k in spec.keys])
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(same, -1, at))  # -1: the run goes on from the batch before
        runs = self.runs + np.cumsum(~same)
        place = np.where(start < 0, at + self.run_rows, at - start)
        if not self.runs:
            self.first = {k: column(k)[0].as_py() for k in spec.keys} | ({"time": column(spec.gaps[0])[0].as_py()} if spec.gaps else {})
        out = {"__head": pa.array(np.where(runs == 1, place, -1))}
        for c, name in spec.sums.items():
            values = pc.fill_null(column(c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(values)
            before = np.where(start < 0, -self.run_sums[c], (upto - values)[np.maximum(start, 0)])
            out[name] = pa.array(upto - before)
            self.run_sums[c] = int((upto - before)[-1])
        place_in_block = None
        if spec.blocks:
            name, rows = spec.blocks
            block, place_in_block = np.divmod(self.rows + at, rows)
            out |= {name: pa.array((self.part << 32) + block), f"{name}_at": pa.array(place_in_block)}
        for c, (name, most) in spec.back.items():
            out[name] = self._lists(column(c), c, most, place, place_in_block)
            if spec.blocks:
                out[f"{name}_size"] = pa.array(np.minimum(place, most))
        if spec.gaps:
            c, limit, name = spec.gaps
            time = column(c)
            previous = pa.concat_arrays([pa.array([self.last[c].as_py() if self.last else None], time.type), time.slice(0, n - 1)])
            far = pc.fill_null(pc.greater(pc.subtract(time, previous), limit), False).to_numpy(zero_copy_only=False)
            fresh = ~same | pc.is_null(previous).to_numpy(zero_copy_only=False) | far
            out[name] = pa.array(self.starts + np.cumsum(fresh))
            self.starts += int(fresh.sum())
        self.runs, self.run_rows, self.rows = int(runs[-1]), int(place[-1]) + 1, self.rows + n
        self.last = {c: column(c)[n - 1] for c in (*spec.keys, *([spec.gaps[0]] if spec.gaps else []))}
        return out

    def _lists(self, values: pa.Array, c: str, most: int, place: np.ndarray, place_in_block: np.ndarray | None) -> pa.Array:
        tail = self.tails.get(c, pa.nulls(0, values.type))
        every = pa.concat_arrays([tail, values])
        end = np.arange(len(values)) + len(tail)
        size = np.minimum(place, most)
        if place_in_block is not None:
            size = np.where(place_in_block == 0, size, 0)
        offsets = np.concatenate([[0], np.cumsum(size)])
        flat = every.take(pa.array(np.repeat(end - size - offsets[:-1], size) + np.arange(offsets[-1])))
        if flat.null_count and place_in_block is None:
            valid = flat.is_valid().to_numpy(zero_copy_only=False)
            offsets, flat = np.concatenate([[0], np.cumsum(valid)])[offsets], flat.drop_null()
        kept = min(int(place[-1]) + 1, most)
        self.tails[c] = every.slice(len(every) - kept)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    def edge(self) -> dict[str, object]:
        """How the partition begins and ends."""
        spec = self.spec
        out: dict[str, object] = {"first": {k: self.first[k] for k in spec.keys}, "last": {k: self.last[k].as_py() for k in spec.keys}}
        out |= {f"sum_{c}": self.run_sums[c] for c in spec.sums} | {f"tail_{c}": self.tails[c].to_pylist() for c in spec.back}
        return out | ({"first_time": self.first["time"], "last_time": self.last[spec.gaps[0]].as_py(), "starts": self.starts} if spec.gaps else {})


def _schema(df: DataFrame, spec: Running) -> tuple[StructType, StructType]:
    """Columns that the scan adds, and those of a partition's state."""
    added = [StructField("__part", IntegerType()), StructField("__head", LongType()), *[StructField(n, LongType()) for n in spec.sums.values()]]
    added += [StructField(name, ArrayType(df.schema[c].dataType)) for c, (name, _) in spec.back.items()]
    keys = StructType([StructField(k, df.schema[k].dataType) for k in spec.keys])
    state = [StructField("first", keys), StructField("last", keys), *[StructField(f"sum_{c}", LongType()) for c in spec.sums], *[StructField(f"tail_{c}", ArrayType(df.schema[c].dataType)) for c in spec.back]]
    if spec.gaps:
        added.append(StructField(spec.gaps[2], LongType()))
        time = df.schema[spec.gaps[0]].dataType
        state += [StructField("first_time", time), StructField("last_time", time), StructField("starts", LongType())]
    if spec.blocks:
        added += [StructField(spec.blocks[0], LongType()), StructField(f"{spec.blocks[0]}_at", IntegerType()), *[StructField(f"{name}_size", IntegerType()) for name, _ in spec.back.values()]]
    return StructType(added), StructType(state)


def _carries(edges: DataFrame, spec: Running) -> DataFrame:
    """(__part, what is carried in): a row a partition."""
    line = Window.orderBy("__part")  # a row a partition
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    of_key = Window.partitionBy("last").orderBy("__part")
    upto = {f"sum_{c}": F.sum(f"sum_{c}").over(of_key) for c in spec.sums}
    for c, (_, most) in spec.back.items():
        # a partition that a key fills has a row of it at least, so as many partitions as rows hold all that is asked for
        tails = F.flatten(F.collect_list(f"tail_{c}").over(of_key.rowsBetween(1 - most, 0)))
        upto[f"tail_{c}"] = F.slice(tails, F.greatest(F.size(tails) - most + 1, F.lit(1)), most)
    edges = edges.withColumns(upto)
    previous = F.lag(F.struct(*edges.columns)).over(line)
    edges = edges.withColumn("__before", previous).withColumn("__on", F.col("__before").isNotNull() & F.col("__before.last").eqNullSafe(F.col("first")))
    on = lambda c, otherwise: F.when(F.col("__on"), F.col(f"__before.{c}")).otherwise(otherwise).alias(f"__{c}")
    carried = [on(f"sum_{c}", F.lit(0)) for c in spec.sums] + [on(f"tail_{c}", F.array().cast(edges.schema[f"tail_{c}"].dataType)) for c in spec.back]
    if spec.gaps:
        near = ~F.coalesce(F.col("first_time") - F.col("__before.last_time") > spec.gaps[1], F.lit(False)) & F.col("__before.last_time").isNotNull()
        edges = edges.withColumn("__joined", (F.col("__on") & near).cast("long"))
        carried.append((F.coalesce(F.sum(F.col("starts") - F.col("__joined")).over(before), F.lit(0)) - F.col("__joined")).alias("__starts"))
    return edges.select("__part", *carried)


def running(df: DataFrame, spec: Running) -> DataFrame:
    """``df`` with the columns that ``spec`` names.

    ``spec.order`` should end in a unique column: rows that are equal in keys and order lie in one partition and follow
    each other in any order.  Null keys are one key and come first.  The rows are written once: ranges come from
    sampling and may differ when they are computed again.
    """
    added, state = _schema(df, spec)
    whole = StructType([*df.schema.fields, *added.fields, StructField("__edge", state)])
    names = [f.name for f in added.fields[1:]]
    types = to_arrow_schema(StructType(whole.fields[len(df.columns) :]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = TaskContext.get().partitionId(), None
        edge = types.field("__edge").type

        def out(batch: pa.RecordBatch, columns: dict[str, pa.Array], last: dict | None) -> pa.RecordBatch:
            n = batch.num_rows
            arrays = [pa.array(np.full(n, part, "i4")), *[columns[c] for c in names], pa.concat_arrays([pa.nulls(n - 1, edge), pa.array([last], edge)])]
            return pa.RecordBatch.from_arrays([*batch.columns, *[a.cast(f.type) for a, f in zip(arrays, types, strict=True)]], [*batch.schema.names, *types.names])

        scan = _Partition(spec, part)
        for batch in batches:
            if batch.num_rows:
                if waiting:
                    yield out(*waiting, None)
                waiting = batch, scan.read(batch)
        if waiting:
            yield out(*waiting, scan.edge())

    order = [F.col(c) for c in (*spec.keys, *spec.order)]
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, whole), "scan", keep_shuffles=False)
    carried = _carries(dealt.where(F.col("__edge").isNotNull()).select("__part", "__edge.*"), spec)
    rows = dealt.join(F.broadcast(carried), "__part")
    head = F.col("__head")
    final: dict[str, Column] = {name: F.col(name) + F.when(head >= 0, F.col(f"__sum_{c}")).otherwise(0) for c, name in spec.sums.items()}
    for c, (name, most) in spec.back.items():
        tail, missing = F.col(f"__tail_{c}"), F.least(most - head, F.size(f"__tail_{c}")).cast("int")
        earlier, carries = F.slice(tail, F.size(tail) - missing + 1, missing), (head >= 0) & (missing > 0)
        if spec.blocks:
            final[f"{name}_size"] = F.col(f"{name}_size") + F.when(carries, missing).otherwise(0)
            carries &= F.col(f"{spec.blocks[0]}_at") == 0
        else:
            earlier = F.array_compact(earlier)
        final[name] = F.when(carries, F.concat(earlier, F.col(name))).otherwise(F.col(name))
    if spec.gaps:
        final[spec.gaps[2]] = F.col(spec.gaps[2]) + F.col("__starts")
    return rows.withColumns(final).select(*df.columns, *spec.added)
