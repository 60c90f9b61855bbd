"""Exact ranking metrics, tie-aware, without a global sort in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.prefix import ordered_prefix, written


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.coalesce(F.col(label).cast("long"), F.lit(0))
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row (auc): area under the ROC curve, ties counting half; 0 with one class only."""
    cum = ordered_prefix(_by_score(df, label, score), [F.col("score")], sums={"neg": "upto"})
    below = F.col("upto") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return cum.agg(wins.alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(F.coalesce(F.col("w") / F.nullif(F.col("p") * F.col("n"), F.lit(0)), F.lit(0.0)).alias("auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row (ap): precision at every distinct score, weighed by the recall gained there; 0 without positives."""
    grouped = _by_score(df, label, score).withColumn("n", F.col("pos") + F.col("neg"))
    cum = ordered_prefix(grouped, [F.col("score").desc()], sums={"pos": "cum_pos", "n": "cum_n"})
    gained = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    return cum.agg(gained.alias("g"), F.sum("pos").alias("p")).select(F.coalesce(F.col("g") / F.nullif(F.col("p"), F.lit(0)), F.lit(0.0)).alias("ap"))


def log_loss(df: DataFrame, label: str = "label", score: str = "score", eps: float = 1e-7) -> DataFrame:
    """One row (logloss): mean cross entropy with probabilities held in [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.coalesce(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))), F.lit(0.0)).alias("logloss"))


def ips_log_loss(df: DataFrame, label: str = "label", logit: str = "logit", weight: str = "ips", cap: float = 10.0) -> DataFrame:
    """One row (loss): cross entropy of logits, weights capped and divided by their mean; stable for any logit."""
    z, y, w = F.col(logit), F.col(label), F.least(F.col(weight), F.lit(cap))
    bce = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return df.agg(F.sum(w * bce).alias("s"), F.sum(w).alias("w")).select(F.coalesce(F.col("s") / F.nullif(F.col("w"), F.lit(0.0)), F.lit(0.0)).alias("loss"))


def _dcg(groups: DataFrame, by: str, k: int, name: str) -> DataFrame:
    """(user, name): discounted gain of (user, by, n, g) groups, tied rows sharing the mean discount of their places."""
    upto = [0.0]
    for i in range(1, k + 1):
        upto.append(upto[-1] + 1 / math.log2(i + 1))
    table = F.array(*[F.lit(x) for x in upto])
    at = lambda n: F.element_at(table, (F.least(n, F.lit(k)) + 1).cast("int"))
    end = F.sum("n").over(Window.partitionBy("user").orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, 0))
    placed = groups.withColumn("end", end)
    part = F.col("g") / F.col("n") * (at(F.col("end")) - at(F.col("end") - F.col("n")))
    return placed.groupBy("user").agg(F.sum(part).alias(name))


def _ndcg_of(rows: DataFrame, k: int = 10) -> DataFrame:
    """(user, ndcg) of counted rows (user, score, g, n): users with at least two rows and a positive one."""
    gain = F.sum(F.col("g") * F.col("n")).alias("g")
    fit = rows.groupBy("user").agg(F.sum("n").alias("n"), gain).where("n >= 2 and g > 0").select("user")
    dcg = _dcg(rows.groupBy("user", F.col("score").alias("by")).agg(F.sum("n").alias("n"), gain), "by", k, "dcg")
    ideal = _dcg(rows.groupBy("user", F.col("g").alias("by")).agg(F.sum("n").alias("n"), gain), "by", k, "ideal")
    return fit.join(dcg, "user").join(ideal, "user").select("user", (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def ndcg_by_user(df: DataFrame, user: str = "user_idx", label: str = "label", score: str = "score", k: int = 10) -> DataFrame:
    """(user, ndcg) of users with at least two rows and a positive one."""
    rows = df.groupBy(F.col(user).alias("user"), F.col(score).alias("score"), F.col(label).cast("double").alias("g")).agg(F.count("*").alias("n"))
    return _ndcg_of(rows, k).withColumnRenamed("user", user)


def ndcg(df: DataFrame, user: str = "user_idx", label: str = "label", score: str = "score", k: int = 10) -> DataFrame:
    """One row (ndcg10): mean over eligible users; 0 if there is none."""
    return ndcg_by_user(df, user, label, score, k).agg(F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg10"))


def counts(df: DataFrame, label: str = "label") -> DataFrame:
    """One row (n_samples, n_pos, pos_rate)."""
    y = F.coalesce(F.col(label).cast("long"), F.lit(0))
    out = df.agg(F.count("*").alias("n_samples"), F.coalesce(F.sum(y), F.lit(0)).alias("n_pos"))
    return out.withColumn("pos_rate", F.col("n_pos") / F.greatest("n_samples", F.lit(1)))


def evaluate_split(df: DataFrame, split: str, user: str = "user_idx", label: str = "label", score: str = "score", eps: float = 1e-7) -> DataFrame:
    """One metrics row (split, auc, ap, logloss, ndcg10, n_samples, n_pos); metrics are 0 with one class only.

    Rows are grouped by user, score and label once; that table and its sums by score give all metrics.
    """
    y = F.coalesce(F.col(label).cast("long"), F.lit(0))
    rows = written(df.groupBy(F.col(user).alias("user"), F.col(score).cast("double").alias("score"), y.alias("y"), F.col(label).cast("double").alias("g")).agg(F.count("*").alias("n")), "scores")
    by = rows.groupBy("score").agg(F.sum(F.col("n") * F.col("y")).alias("pos"), F.sum(F.col("n") * (1 - F.col("y"))).alias("neg"))
    cum = ordered_prefix(by.where("score is not null").withColumn("n", F.col("pos") + F.col("neg")), [F.col("score").desc()], sums={"pos": "cum_pos", "neg": "cum_neg"})
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    seen = cum.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)).alias("wins"), F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("gained"),
        F.sum(-F.col("pos") * F.log(p) - F.col("neg") * F.log(1 - p)).alias("cross"),
    )
    whole = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"), F.coalesce(F.sum(F.col("n") * F.col("y")), F.lit(0)).alias("n_pos"))
    row = whole.crossJoin(seen).crossJoin(_ndcg_of(rows).agg(F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg10")))  # single rows
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_samples"))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    found = {"auc": over(F.col("wins"), F.col("p") * F.col("q")), "ap": over(F.col("gained"), F.col("p")), "logloss": over(F.col("cross"), F.col("p") + F.col("q")), "ndcg10": F.col("ndcg10")}
    return row.select(F.lit(split).alias("split"), *[F.when(both, v).otherwise(F.lit(0.0)).alias(k) for k, v in found.items()], "n_samples", "n_pos")


def side_by_side(metrics: DataFrame, missing: str = "N/A") -> DataFrame:
    """(metric, one column a model and split): metrics of (model, split, metric, value) rows, missing ones as N/A."""
    names = [r["c"] for r in metrics.select(F.concat_ws("_", "model", "split").alias("c")).distinct().orderBy("c").collect()]  # models
    wide = metrics.withColumn("c", F.concat_ws("_", "model", "split")).groupBy("metric").pivot("c", names).agg(F.first(F.format_number("value", 4)))
    return wide.select("metric", *[F.coalesce(F.col(f"`{n}`"), F.lit(missing)).alias(n) for n in names])
