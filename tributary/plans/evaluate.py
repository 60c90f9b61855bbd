"""Queries of metrics, the click model and run comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tributary.operators import metrics as M
from tributary.operators import model as L
from tributary.operators import runs as R
from tributary.operators.prefix import written
from tributary.plans import bind as B
from tributary.plans.bind import sql
from tributary.plans.graph import KG_PATHS

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, text: str | None):
    def keep(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return keep


def r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


AUC = "SELECT sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM {0} GROUP BY 1))"
AP = "SELECT sum(pos * cp / cn) / sum(pos) AS ap FROM (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM (SELECT score, sum(label) AS pos, count(*) AS n FROM {0} GROUP BY 1) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"
LOSS = "SELECT avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS logloss FROM (SELECT label, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM {0})"
_DISCOUNT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY {1} DESC) AS place FROM {0})"
_DCG = "SELECT user_idx, sum(g * d) AS v FROM (SELECT user_idx, {1}, avg(label) AS g, sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) AS d FROM (" + _DISCOUNT + ") GROUP BY 1, 2) GROUP BY 1"
NDCG_USERS = "SELECT user_idx, a.v / b.v AS ndcg FROM (" + _DCG.replace("{1}", "score") + ") a JOIN (" + _DCG.replace("{1}", "label") + ") b USING (user_idx) WHERE user_idx IN (SELECT user_idx FROM {0} GROUP BY 1 HAVING count(*) >= 2 AND sum(label) > 0)"


@query("auc", sql(f"SELECT round(auc, 6) AS auc FROM ({AUC.format('pred')})", "pred"))
def auc(s, sf):
    return r6(M.auc(B.predictions(s, sf)))


@query("average_precision", sql(f"SELECT round(ap, 6) AS ap FROM ({AP.format('pred')})", "pred"))
def average_precision(s, sf):
    return r6(M.average_precision(B.predictions(s, sf)))


@query("log_loss", sql(f"SELECT round(logloss, 6) AS logloss FROM ({LOSS.format('pred')})", "pred"))
def log_loss(s, sf):
    return r6(M.log_loss(B.predictions(s, sf)))


@query("ips_log_loss", sql("SELECT round(sum(w * (greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit))))) / sum(w), 6) AS loss FROM (SELECT *, least(ips, 10) AS w FROM pred)", "pred"))
def ips_log_loss(s, sf):
    return r6(M.ips_log_loss(B.predictions(s, sf)))


@query("ndcg10", sql(f"SELECT user_idx, round(ndcg, 6) AS ndcg FROM ({NDCG_USERS.format('pred')})", "pred"))
def ndcg10(s, sf):
    return r6(M.ndcg_by_user(B.predictions(s, sf)))


@query("metrics_row", sql(f"SELECT 'test' AS split, round(auc, 6) AS auc, round(ap, 6) AS ap, round(logloss, 6) AS logloss, round(ndcg10, 6) AS ndcg10, n_samples, n_pos FROM ({AUC.format('pred')}), ({AP.format('pred')}), ({LOSS.format('pred')}), (SELECT avg(ndcg) AS ndcg10 FROM ({NDCG_USERS.format('pred')})), (SELECT count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS n_pos FROM pred)", "pred"))
def metrics_row(s, sf):
    return r6(M.evaluate_split(B.predictions(s, sf), "test"))


@query("sample_counts", sql("SELECT count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS n_pos, round(avg(label), 6) AS pos_rate FROM pred", "pred"))
def sample_counts(s, sf):
    return r6(M.counts(B.predictions(s, sf)))


def half(k: int) -> str:
    return f"(SELECT * FROM pred WHERE user_idx % 2 = {k})"


@query("metric_pivot", sql("SELECT metric, format('{:.4f}', max(CASE WHEN k = 0 THEN v END)) AS base_test, format('{:.4f}', max(CASE WHEN k = 1 THEN v END)) AS full_test FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, '{m}' AS metric, {m} AS v FROM ({q.format(half(k))})" for k in (0, 1) for m, q in (("auc", AUC), ("ap", AP), ("logloss", LOSS))) + ") GROUP BY 1", "pred"))
def metric_pivot(s, sf):
    p = B.predictions(s, sf)
    rows = []
    for k, name in enumerate(("base", "full")):
        part = p.where(F.col("user_idx") % 2 == k)
        for metric, f in (("auc", M.auc), ("ap", M.average_precision), ("logloss", M.log_loss)):
            rows.append(f(part).select(F.lit(name).alias("model"), F.lit("test").alias("split"), F.lit(metric).alias("metric"), F.col(metric).alias("value")))
    return M.side_by_side(reduce(lambda a, b: a.unionByName(b), rows))


@query("last_epoch", sql("SELECT run, max(epoch) AS epoch, last(auc ORDER BY epoch) AS auc, last(ap ORDER BY epoch) AS ap, last(logloss ORDER BY epoch) AS logloss, last(ndcg10 ORDER BY epoch) AS ndcg10 FROM hist WHERE tested GROUP BY 1", "hist"))
def last_epoch(s, sf):
    return R.last_epoch(B.history(s, sf))


@query("best_epoch", sql("SELECT run, epoch AS best_epoch, auc AS best FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY auc DESC, epoch) AS place FROM hist WHERE tested) WHERE place = 1", "hist"))
def best_epoch(s, sf):
    return R.best_epoch(B.history(s, sf))


@query("convergence", sql("SELECT run, epoch, ap AS value FROM hist WHERE tested AND run NOT IN (SELECT run FROM hist WHERE tested AND ap IS NULL)", "hist"))
def convergence(s, sf):
    return R.convergence(B.history(s, sf), "ap")


GROUPS = "SELECT * FROM (VALUES " + ", ".join(f"('{g}', {k}, '{run}')" for g, names in R.GROUPS.items() for k, run in enumerate(names, 1)) + ") t(grp, place, run)"
LAST = "SELECT run, last(auc ORDER BY epoch) AS auc, last(ap ORDER BY epoch) AS ap, last(logloss ORDER BY epoch) AS logloss, last(ndcg10 ORDER BY epoch) AS ndcg10 FROM hist WHERE tested GROUP BY 1"


@query("leaderboard", sql(f"SELECT grp, place, run, " + ", ".join(f"coalesce(format('{{:.4f}}', {m}), 'n/a') AS {m}" for m in R.METRICS) + f" FROM ({GROUPS}) LEFT JOIN ({LAST}) USING (run)", "hist"))
def leaderboard(s, sf):
    """Runs with kg 32 have a log only."""
    h = B.history(s, sf)
    recorded, logged = h.where("run not like '%kg32%'"), R.last_epoch(h.where("run like '%kg32%'"))
    return R.leaderboard(R.results_of(recorded, logged), R.run_groups(s))


@query("parse_run_name", sql("SELECT run, '1k' AS scale, 'dual' AS model, CAST(regexp_extract(run, '_kg(\\d+)', 1) AS INTEGER) AS kg, CAST(regexp_extract(run, '_ips([01])', 1) AS INTEGER) AS ips, CAST(regexp_extract(run, '_rg([01])', 1) AS INTEGER) AS rg, 2 AS layers, 128 AS hidden, 64 AS out, NULL AS tag FROM (SELECT DISTINCT run FROM hist)", "hist"))
def parse_run_name(s, sf):
    return R.parse_run_name(B.history(s, sf).select("run").distinct())


@query("run_deltas", sql(f"SELECT a.run, " + ", ".join(f"round(a.{m} - b.{m}, 6) AS d_{m}" for m in R.METRICS) + f" FROM ({LAST}) a, ({LAST}) b WHERE b.run = '1k_dual_kg64_ips1_rg1' AND a.run <> b.run", "hist"))
def run_deltas(s, sf):
    return r6(R.deltas(R.last_epoch(B.history(s, sf)), "1k_dual_kg64_ips1_rg1"))


FEATURES = ["play_ratio", "tab", "same_author", "same_category"]
WEIGHTS, INTERCEPT = [1.283719371, -0.131173919, 0.471919713, -0.071393717], -0.713919717


def model_rows(s, sf):
    from tributary.functions.derive import ips_weight
    from tributary.operators.propagate import path_counts

    log = B.log(s, sf)
    tags = B.videos(s, sf).select("video_id", F.explode("tag_list").alias("tag"))
    return log.join(path_counts(log, B.authors(s, sf), tags), "row_key").withColumn("ips", ips_weight("is_rand"))


@query("click_scores_given", sql(f"SELECT row_key, is_click, round(z, 6) AS logit, round(1 / (1 + exp(-z)), 6) AS score FROM (SELECT row_key, CAST(is_click AS TINYINT) AS is_click, {INTERCEPT} + play_ratio * {WEIGHTS[0]} + tab * {WEIGHTS[1]} + same_author * {WEIGHTS[2]} + same_category * {WEIGHTS[3]} AS z FROM ({KG_PATHS}) JOIN log USING (row_key))", "log", "authors", "tags"))
def click_scores_given(s, sf):
    """The head's scores under given weights."""
    return r6(L.linear_score(model_rows(s, sf), FEATURES, WEIGHTS, INTERCEPT).select("row_key", "is_click", "logit", "score"))


def fitted_sql(steps: int = 9) -> str:
    """Newton's method written out: derivatives by one aggregate a step, the linear system by elimination."""
    from tributary.functions.derive import IPS_WEIGHTS

    d = range(len(FEATURES) + 1)
    z = " + ".join(f"b{i} * x{i}" for i in d)
    ctes = [f"base AS MATERIALIZED (SELECT row_key, CAST(is_click AS DOUBLE) AS y, CASE WHEN is_rand = 1 THEN {IPS_WEIGHTS['random']} ELSE {IPS_WEIGHTS['standard']} END AS w, " + ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(FEATURES)) + f", 1.0::DOUBLE AS x{len(FEATURES)} FROM ({KG_PATHS}) JOIN log USING (row_key))"]
    ctes.append("at0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in d) + ")")
    for n in range(steps):
        sums = [f"sum(w * p * (1 - p) * x{i} * x{j}) AS a{i}_{j}" for i in d for j in d] + [f"sum(w * (y - p) * x{i}) AS a{i}_{len(d)}" for i in d]
        ctes.append(f"e{n}_0 AS MATERIALIZED (SELECT {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM base, at{n}))")
        for k in d:
            cells = [f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in d for j in range(len(d) + 1)]
            ctes.append(f"e{n}_{k + 1} AS MATERIALIZED (SELECT {', '.join(cells)} FROM e{n}_{k})")
        ctes.append(f"at{n + 1} AS MATERIALIZED (SELECT " + ", ".join(f"b{i} + a{i}_{len(d)} AS b{i}" for i in d) + f" FROM at{n}, e{n}_{len(d)})")
    return "WITH " + ", ".join(ctes) + f" SELECT row_key, CAST(y AS TINYINT) AS is_click, round(z, 6) AS logit, round(1 / (1 + exp(-z)), 6) AS score FROM (SELECT *, {z} AS z FROM base, at{steps})"


@query("click_model_scores", sql(f"SELECT * FROM ({fitted_sql()})", "log", "authors", "tags"))
def click_model_scores(s, sf):
    """Probability of a click of every interaction, from the best weighted logistic head on log and path features."""
    rows = written(model_rows(s, sf).select("row_key", "is_click", "ips", *FEATURES), "rows")
    fitted = L.coefficients(L.train_click_model(rows, FEATURES, maxIter=20))
    return r6(L.linear_score(rows, FEATURES, *L.refine(rows, FEATURES, *fitted)).select("row_key", "is_click", "logit", "score"))


@query("clamped_index", sql("SELECT row_key, greatest(0, least(video_id, 49)) AS video_idx, greatest(0, least(user_id - 20, 99)) AS user_idx FROM log", "log"))
def clamped_index(s, sf):
    """Indexes held within tables of 50 and 100 rows."""
    from tributary.functions.derive import clamp

    return B.log(s, sf).select("row_key", clamp("video_id", 50).alias("video_idx"), clamp(F.col("user_id") - 20, 100).alias("user_idx"))


@query("uniform_weights", sql("SELECT is_rand, 1.0::DOUBLE AS weight, count(*) AS n FROM log GROUP BY 1", "log"))
def uniform_weights(s, sf):
    """Both policies weigh 1 where weighting is off."""
    from tributary.functions.derive import ips_weight

    return B.log(s, sf).groupBy("is_rand", ips_weight("is_rand", enabled=False).alias("weight")).agg(F.count("*").alias("n"))
