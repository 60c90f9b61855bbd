"""Comparison of recorded training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("auc", "ap", "logloss", "ndcg10")

# The recorded runs that each table compares, in order.
GROUPS: dict[str, tuple[str, ...]] = {
    "baselines_progression": ("DIN", "BST", "1k_kgat_ips0_L2_h128d64", "1k_kgat_ips1_L2_h128d64", "1k_single_kg0_ips1_rg1", "1k_dual_kg0_ips1_rg1", "1k_dual_kg64_ips1_rg1"),
    "ablations": ("1k_dual_kg64_ips1_rg1", "1k_dual_kg64_ips0_rg1", "1k_dual_kg64_ips1_rg0", "1k_dual_kg64_ips0_rg0"),
    "sensitivity": ("1k_dual_kg64_ips1_rg1", "1k_dual_kg64_ips1_rg1_L1", "1k_dual_kg64_ips1_rg1_L3", "1k_dual_kg32_ips1_rg1_h64d32", "1k_dual_kg128_ips1_rg1_h256d128"),
}


def run_groups(spark: SparkSession) -> DataFrame:
    """(grp, place, run): the groups as a table."""
    return spark.createDataFrame([(g, k, run) for g, names in GROUPS.items() for k, run in enumerate(names, 1)], "grp string, place int, run string")


def results_of(history: DataFrame, logged: DataFrame | None = None) -> DataFrame:
    """(run, metrics): the last epoch of each recorded history, and what the logs of other runs say."""
    found = last_epoch(history).select("run", *METRICS)
    return found if logged is None else found.unionByName(logged.select("run", *METRICS).join(found.select("run"), "run", "left_anti"))


def last_epoch(history: DataFrame) -> DataFrame:
    """(run, epoch, metrics) of each run's last epoch that has test metrics."""
    kept = history.where(F.col("test").isNotNull())
    last = kept.groupBy("run").agg(F.max("epoch").alias("epoch"), F.max_by("test", "epoch").alias("t"))
    return last.select("run", "epoch", *[F.col(f"t.{m}").alias(m) for m in METRICS])


def best_epoch(history: DataFrame, metric: str = "auc") -> DataFrame:
    """(run, best_epoch, best): greatest test metric, the first epoch of equal ones."""
    kept = history.where(F.col(f"test.{metric}").isNotNull())
    best = F.max_by(F.struct("epoch", F.col(f"test.{metric}").alias("v")), F.struct(F.col(f"test.{metric}"), -F.col("epoch")))
    return kept.groupBy("run").agg(best.alias("b")).select("run", F.col("b.epoch").alias("best_epoch"), F.col("b.v").alias("best"))


def convergence(history: DataFrame, metric: str = "auc") -> DataFrame:
    """(run, epoch, value) of epochs with test metrics; runs with any missing value are left out."""
    rows = history.where(F.col("test").isNotNull()).select("run", "epoch", F.col(f"test.{metric}").alias("value"))
    return rows.join(rows.where(F.col("value").isNull()).select("run").distinct(), "run", "left_anti")


def leaderboard(results: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, place, run, metrics as text): the catalog (grp, place, run) with each run's metrics, n/a where absent."""
    joined = groups.join(results, "run", "left")
    return joined.select("grp", "place", "run", *[F.when(F.col(m).isNotNull(), F.format_string("%.4f", m)).otherwise("n/a").alias(m) for m in METRICS])


def parse_run_name(df: DataFrame, column: str = "run") -> DataFrame:
    """Add what a run's name encodes: scale, model, kg, ips, rg, layers, hidden, out, tag; defaults L2 and h128 d64."""
    take = lambda pattern: F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
    number = lambda pattern, default: F.coalesce(take(pattern).cast("int"), F.lit(default).cast("int"))
    return df.withColumns({
        "scale": take(r"^(\d+k)_"), "model": take(r"^\d+k_([a-z]+)"), "kg": number(r"_kg(\d+)", None), "ips": number(r"_ips([01])", None), "rg": number(r"_rg([01])", None),
        "layers": number(r"_L(\d+)", 2), "hidden": number(r"_h(\d+)d", 128), "out": number(r"_h\d+d(\d+)", 64), "tag": take(r"_tag-([A-Za-z0-9]+)$"),
    })


def deltas(results: DataFrame, baseline: str) -> DataFrame:
    """(run, d_metric): each run's metrics less the baseline run's; no rows if that is absent."""
    base = results.where(F.col("run") == baseline).limit(1).select(*[F.col(m).alias(f"b_{m}") for m in METRICS])
    return results.where(F.col("run") != baseline).crossJoin(F.broadcast(base)).select("run", *[(F.col(m) - F.col(f"b_{m}")).alias(f"d_{m}") for m in METRICS])  # one row
