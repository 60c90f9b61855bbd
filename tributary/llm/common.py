"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset (tests); it then gets a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def _own_shuffles_only(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has ended: its result is written by then."""
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


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: later stages read the files, so a lost executor costs only
    its own unfinished tasks.  ``release`` removes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _own_shuffles_only(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def materialise_bucketed(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """``materialise``, bucketed by ``column``: joins on it move only their other side."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with _own_shuffles_only(spark):
        df.write.option("path", path).option("compression", "zstd").format("parquet").bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: files in a path of their own stay
    _FOLDERS[out] = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove the files of what ``materialise`` returned, once nothing reads it any more."""
    for df in frames:
        if path := _FOLDERS.pop(df, None):
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def id_remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus`` (null id: as empty text)."""
    text = F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``rows`` rows: texts are long, workers are small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) > rows or int(df.sparkSession.conf.get(name)) <= 0:
        df.sparkSession.conf.set(name, str(rows))
    return df


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores put before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case: the runs without space, tab, LF, VT, FF and CR."""
    return text.lower().split() if text else []


class Memo(dict):
    """Dictionary that computes missing values and forgets everything beyond ``limit`` entries."""

    def __init__(self, make, limit: int = 150_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
