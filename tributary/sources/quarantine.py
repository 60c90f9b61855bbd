"""What is wrong in input files: values that are not of their column's type, lines of the wrong length, repeated keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_LINE = "__line"


def checked_csv(spark: SparkSession, paths: list[str], types: dict[str, str]) -> DataFrame:
    """The lines of CSV files with a header as texts, with __file, __line (of lines with too few or too many fields) and __bad.

    ``types`` has the SQL type by column; columns that the files lack are skipped.  __bad lists the columns
    whose text is not of its type: what a reader makes null although it is there.
    """
    names = [c.strip() for c in spark.read.option("header", True).csv(paths).columns]
    schema = StructType([StructField(n, StringType()) for n in (*names, _LINE)])
    # without pruning, so that every field of a line is counted whatever is read of it
    df = spark.read.schema(schema).options(header=True, columnPruning=False, columnNameOfCorruptRecord=_LINE, enforceSchema=True).csv(paths)
    bad = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items() if c in names]
    file = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(/part-[^/]*)?$", 1)
    return df.withColumn("__file", file).withColumn("__bad", F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))


def rejects(checked: DataFrame) -> DataFrame:
    """(file, column, reason, n): rejected values by column, and lines of the wrong length (column null), of ``checked_csv``.

    A line of the wrong length counts once as a line and again for each bad value in what was read of it.
    """
    line = F.when(F.col(_LINE).isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit("line").alias("reason")))).otherwise(F.array().cast("array<struct<column:string,reason:string>>"))
    values = F.transform("__bad", lambda c: F.struct(c.alias("column"), F.lit("value").alias("reason")))
    each = checked.select(F.col("__file").alias("file"), F.explode(F.concat(line, values)).alias("x"))
    return each.groupBy("file", "x.column", "x.reason").agg(F.count("*").alias("n"))


def bad_rows(checked: DataFrame) -> DataFrame:
    """(file, columns, line, fields): the lines that ``rejects`` counts, with what stood in them."""
    fields = [c for c in checked.columns if c not in (_LINE, "__file", "__bad")]
    row = F.to_json(F.struct(*[F.col(c) for c in fields]))
    return checked.where(F.col(_LINE).isNotNull() | (F.size("__bad") > 0)).select(F.col("__file").alias("file"), F.col("__bad").alias("columns"), F.col(_LINE).alias("line"), row.alias("fields"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n): values that occur in more than one row; nulls are no key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df``, failing with the key where a value of ``key`` occurs in several rows; rows without a key stay as they are.

    The count is a grouping by the key, as a join on it is: both share one shuffle.
    """
    others = [c for c in df.columns if c != key]
    apart = df.withColumn("__null", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    grouped = apart.groupBy(key, "__null").agg(F.count("*").alias("__n"), F.first(F.struct(*others) if others else F.lit(None)).alias("__row"))
    problem = F.concat(F.lit(f"{what}: {key} "), F.col(key).cast("string"), F.lit(" has "), F.col("__n").cast("string"), F.lit(" rows"))
    sound: Column = F.when(F.col("__n") > 1, F.raise_error(problem).cast("boolean")).otherwise(True)
    return grouped.where(sound).select(*[F.col(c) if c == key else F.col(f"__row.{c}").alias(c) for c in df.columns])
