"""Recorded runs: histories, training logs, predictions; writers of splits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import metrics

METRICS = "split string, loss double, auc double, ap double, logloss double, ndcg10 double, n_samples long, n_pos long"
HISTORY = f"epoch int, train struct<{METRICS.replace(' ', ':').replace(',:', ',')}>, test struct<{METRICS.replace(' ', ':').replace(',:', ',')}>, lr double, time_s double"
RUN = r"([^/]+)/[^/]+$"
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def read_run_histories(spark: SparkSession, folder: str, name: str = "history.json") -> DataFrame:
    """(run, epoch, train, test, lr, time_s, readable, text): one row an epoch, runs named by their folder.

    A file that is no JSON, or an entry without an epoch, gives a row with ``readable`` false; the file's ``text`` stays
    with it if it is no JSON.
    """
    df = spark.read.options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="text").schema(f"{HISTORY}, text string").json(f"{folder}/*/{name}")
    run = F.regexp_extract(F.input_file_name(), RUN, 1)
    return df.select(run.alias("run"), "epoch", "train", "test", "lr", "time_s", F.col("epoch").isNotNull().alias("readable"), "text")


def read_training_logs(spark: SparkSession, folder: str, known: DataFrame | None = None, marker: str = "Test evaluation") -> DataFrame:
    """(run, auc, ap, logloss, ndcg10): metrics after the last marker of each log; runs in ``known`` are left out."""
    logs = spark.read.text(f"{folder}/*/*.log", wholetext=True).select(F.regexp_extract(F.input_file_name(), RUN, 1).alias("run"), "value")
    last = F.element_at(F.split("value", marker), -1)
    metric = lambda label: F.regexp_extract(last, f"{label}: *{NUMBER}", 1).try_cast("double")
    found = logs.where(F.col("value").contains(marker)).select("run", metric("AUC").alias("auc"), metric("AP").alias("ap"), metric("logloss").alias("logloss"), metric(r"NDCG\(10\)").alias("ndcg10"))
    return found if known is None else found.join(known.select("run").distinct(), "run", "left_anti")


def read_predictions(predictions: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame | None:
    """(key, label, score): the first floating column as the score, joined on a row id.

    None if there is no such column or the row counts differ.
    """
    floats = [c for c, t in predictions.dtypes if t in ("float", "double")]
    if not floats or predictions.count() != labels.count():
        return None
    return labels.select(key, F.col(label).alias("label")).join(predictions.select(key, F.col(floats[0]).cast("double").alias("score")), key)


def split_metrics(predictions: DataFrame | None, labels: DataFrame, key: str, label: str, log_metrics: DataFrame | None = None) -> DataFrame:
    """One row (auc, ap, logloss, n_samples, n_pos) of a split.

    From predictions if they fit the labels; else the log's ``auc`` and ``logloss`` (one row) beside the
    counts of labels; else the counts alone.
    """
    counted = metrics.counts(labels, label).select("n_samples", "n_pos")
    fit = None if predictions is None else read_predictions(predictions, labels, key, label)
    if fit is not None:
        parts = (metrics.auc(fit), metrics.average_precision(fit), metrics.log_loss(fit))
        return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(counted)  # single rows
    none = F.lit(None).cast("double")
    if log_metrics is not None:
        return log_metrics.limit(1).select("auc", none.alias("ap"), "logloss").crossJoin(counted)  # single rows
    return counted.select(none.alias("auc"), none.alias("ap"), none.alias("logloss"), "n_samples", "n_pos")


def write_splits(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """A folder a split."""
    writer = rows.write.mode("overwrite").partitionBy("split")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_rows(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Statistics, final metrics, histories (json) or result tables (csv)."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def history_as_text(rows: DataFrame, column: str = "hist") -> DataFrame:
    """A sequence joined by spaces, "0" where it is empty: the form of text files."""
    return rows.withColumn(column, F.when(F.size(column) > 0, F.array_join(F.col(column).cast("array<string>"), " ")).otherwise("0"))
