"""Global order without a single-task window."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session on one machine that has none (tests) gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def _own_shuffles_only(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, label: str, keep_shuffles: bool = True) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut in the lineage that survives executors.

    Without ``keep_shuffles`` the shuffle files that this took go at once, not when the driver forgets them.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with nullcontext() if keep_shuffles else _own_shuffles_only(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_prefix(df: DataFrame, order: list[Column], rank: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Add the 0-based global rank and running sums (inclusive) of columns in an order.

    ``order`` must end in a unique key, else ties are arbitrary.  Rows are dealt by ranges of the
    order and written once, since ranges come from sampling and may differ when computed again; the
    offset of a range is the prefix of the ranges' totals, one row a partition.
    """
    sums = sums or {}
    part, place = "__part", "__place"
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), "prefix")
    totals = dealt.groupBy(part).agg(F.count("*").alias("__rows"), *[F.sum(c).alias(f"__{c}_sum") for c in sums])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = totals.select(part, *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}_before") for c in ("rows", *[f"{c}_sum" for c in sums])])
    within = Window.partitionBy(part).orderBy(place)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), part)
    added = {name: F.sum(c).over(upto) + F.col(f"__{c}_sum_before") for c, name in sums.items()}
    if rank:
        added[rank] = (F.row_number().over(within) - 1 + F.col("__rows_before")).cast("long")
    return out.withColumns(added).select(*df.columns, *added)
