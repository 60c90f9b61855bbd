"""Queries of sessions, histories, splits, graph tables and propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.functions.arrays import rounded
from tributary.functions.derive import IPS_WEIGHTS, keep
from tributary.operators import graph as G
from tributary.operators import propagate as P
from tributary.operators import sessions as S
from tributary.plans import bind as B
from tributary.plans.bind import sql
from tributary.schema import KEEP, MERGED_ALL

QUERIES, ORACLE_SQL = {}, {}
WIDTH = B.WIDTH


def query(name: str, text: str | None):
    def keep(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return keep


def sessions(s, sf):
    return S.sessionize(B.log(s, sf), B.GAP_MS)


def pairs(s, sf):
    return S.next_in_session(sessions(s, sf))


@query("sessionize", sql("SELECT row_key, session_id FROM sess", "sess"))
def sessionize(s, sf):
    return sessions(s, sf).select("row_key", "session_id")


@query("session_summary", sql("SELECT count(DISTINCT user_id) AS users, count(DISTINCT video_id) AS videos, CAST(sum(1 - is_rand) AS BIGINT) AS standard_rows, CAST(sum(is_rand) AS BIGINT) AS random_rows, count(DISTINCT session_id) AS sessions FROM sess", "sess"))
def session_summary(s, sf):
    return S.summary(sessions(s, sf))


@query("session_tail", sql("SELECT session_id, row_key FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_ms DESC, row_key DESC) AS back FROM sess) WHERE back <= 2", "sess"))
def session_tail(s, sf):
    return S.session_tail(sessions(s, sf), 2).select("session_id", "row_key")


@query("next_in_session", sql("SELECT * FROM nxt", "nxt"))
def next_in_session(s, sf):
    return pairs(s, sf)


@query("last_in_session", sql("SELECT session_id, last(dst ORDER BY seq) AS last FROM nxt GROUP BY 1", "nxt"))
def last_in_session(s, sf):
    return S.last_items(pairs(s, sf))


@query("transition_counts", sql("SELECT src, dst, count(*) AS n FROM nxt GROUP BY 1, 2", "nxt"))
def transition_counts(s, sf):
    return pairs(s, sf).groupBy("src", "dst").agg(F.count("*").alias("n"))


HISTORY = "SELECT row_key, user_id, video_id, list(video_id) OVER (PARTITION BY user_id ORDER BY time_ms, row_key ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS hist, CAST(is_click AS INTEGER) AS y FROM log"


@query("history50", sql(f"SELECT row_key, hist FROM ({HISTORY}) WHERE hist IS NOT NULL", "log"))
def history50(s, sf):
    return S.histories(B.log(s, sf)).select("row_key", "hist")


@query("sequence_encode", sql(f"""SELECT row_key, list_concat(CAST(list_transform(range(50 - len(codes)), lambda i: 0) AS BIGINT[]), codes) AS seq FROM (
    SELECT row_key, list(coalesce(idx, 0) ORDER BY pos) AS codes FROM (SELECT row_key, unnest(hist) AS item, unnest(range(len(hist))) AS pos FROM ({HISTORY}) WHERE hist IS NOT NULL)
      LEFT JOIN (SELECT token, row_number() OVER (ORDER BY token) AS idx FROM (SELECT CAST(video_id AS VARCHAR) AS token FROM log WHERE is_click = 1 GROUP BY 1 HAVING count(*) >= 2)) ON token = CAST(item AS VARCHAR) GROUP BY 1)""", "log"))
def sequence_encode(s, sf):
    from tributary.operators.clean import encode_sequences, vocabulary

    log = B.log(s, sf)
    return encode_sequences(S.histories(log).select("row_key", "hist"), "row_key", "hist", vocabulary(log.where("is_click = 1"), "video_id", 2), "seq").select("row_key", "seq")


@query("temporal_split", sql("SELECT row_key, CASE WHEN row_number() OVER (ORDER BY time_ms, row_key) <= (SELECT floor(count(*) * 0.8) FROM log) THEN 'train' ELSE 'test' END AS split FROM log", "log"))
def temporal_split(s, sf):
    return S.temporal_split(B.log(s, sf)).select("row_key", "split")


POSITION = "SELECT *, CASE WHEN place <= (SELECT floor(count(*) * 0.8) FROM log) THEN 'train' WHEN place <= (SELECT floor(count(*) * 0.9) FROM log) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY CAST(user_id AS VARCHAR), time_ms, row_key) AS place FROM log)"


@query("positional_split", sql(f"SELECT row_key, split FROM ({POSITION})", "log"))
def positional_split(s, sf):
    return S.positional_split(B.log(s, sf)).select("row_key", "split")


@query("split_stats", sql(f"SELECT coalesce(split, 'ALL') AS split, count(*) AS total, CAST(sum(is_click) AS BIGINT) AS pos, CAST(sum(1 - is_click) AS BIGINT) AS neg, round(avg(is_click), 6) AS ctr FROM ({POSITION}) GROUP BY ROLLUP (split)", "log"))
def split_stats(s, sf):
    return S.split_statistics(S.positional_split(B.log(s, sf))).withColumn("ctr", F.round("ctr", 6))


@query("id_map", sql("SELECT raw_id, idx FROM aid", "aid"))
def id_map(s, sf):
    return G.id_map(B.videos(s, sf), "author_id")


@query("category_map", sql("SELECT raw_id, idx FROM cid", "cid"))
def category_map(s, sf):
    return G.category_map(B.videos(s, sf))


def graph(s, sf):
    return G.build_graph(sessions(s, sf), B.users(s, sf), B.videos(s, sf), scope="all")


def known(s, sf):
    from tributary.operators.clean import in_domain

    return in_domain(sessions(s, sf), G.id_map(B.users(s, sf), "user_id"), G.id_map(B.raw_videos(s, sf), "video_id"))


@query("edges_interacted", sql("SELECT user_idx AS src, video_idx AS dst, is_rand = 1 AS is_rand, count(*) AS n, CAST(sum(CAST(round(play_ratio * 1000000) AS BIGINT)) AS BIGINT) AS play, CAST(sum(long_view) AS BIGINT) AS long_view, CAST(sum(tab) AS BIGINT) AS tab, round(sum(CASE is_rand WHEN 1 THEN " + str(IPS_WEIGHTS["random"]) + " ELSE " + str(IPS_WEIGHTS["standard"]) + " END), 6)::DOUBLE AS ips FROM known GROUP BY 1, 2, 3", "known"))
def edges_interacted(s, sf):
    e = G.interacted(known(s, sf))
    return e.groupBy("src", "dst", "is_rand").agg(F.count("*").alias("n"), F.sum(F.round(F.element_at("attr", 1) * 1_000_000).cast("long")).alias("play"), F.sum(F.element_at("attr", 2)).cast("long").alias("long_view"), F.sum(F.round(F.element_at("attr", 3) * 14).cast("long")).alias("tab"), F.round(F.sum(F.element_at("attr", 4)), 6).alias("ips"))


@query("edges_feedback", sql("SELECT rel, src, dst, count(*) AS n FROM feedback GROUP BY 1, 2, 3", "feedback"))
def edges_feedback(s, sf):
    return G.feedback(known(s, sf)).groupBy("rel", "src", "dst").agg(F.count("*").alias("n"))


def made(s, sf):
    v = B.videos(s, sf)
    return G.made_by(v, G.id_map(v, "video_id"), G.id_map(v, "author_id"))


@query("edges_made_by", sql("SELECT src, dst FROM made", "made"))
def edges_made_by(s, sf):
    return made(s, sf).select("src", "dst")


@query("edges_follows", sql("SELECT src, dst, count(*) AS n FROM followed_authors GROUP BY 1, 2", "followed_authors"))
def edges_follows(s, sf):
    return G.follows(known(s, sf), made(s, sf)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("edges_tagged", sql("SELECT src, dst, count(*) AS n FROM tagged GROUP BY 1, 2", "tagged"))
def edges_tagged(s, sf):
    v = B.videos(s, sf)
    return G.tagged_as(v, G.id_map(v, "video_id"), G.category_map(v)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("edges_in_session", sql("SELECT session_id, seq, src, dst, round(tab / 14, 6) AS tab FROM knxt", "knxt"))
def edges_in_session(s, sf):
    return G.in_session(known(s, sf)).select("session_id", "seq", "src", "dst", F.round(F.element_at("attr", 1), 6).alias("tab"))


NODES = "SELECT 'user' AS name, (SELECT count(*) FROM uid) AS n UNION ALL SELECT 'video', (SELECT count(*) FROM vid) UNION ALL SELECT 'author', (SELECT count(*) FROM aid) UNION ALL SELECT 'category', (SELECT count(*) FROM cid) UNION ALL SELECT 'session', (SELECT max(session_id) + 1 FROM sess)"
EDGES = "SELECT 'interacted' AS name, (SELECT count(*) FROM known) AS n UNION ALL SELECT rel, count(*) FROM feedback GROUP BY 1 UNION ALL SELECT 'follows', (SELECT count(*) FROM followed_authors) UNION ALL SELECT 'made_by', (SELECT count(*) FROM made) UNION ALL SELECT 'tagged_as', (SELECT count(*) FROM tagged) UNION ALL SELECT 'next_in_session', (SELECT count(*) FROM knxt)"
ALL = ("feedback", "followed_authors", "tagged", "knxt")


@query("graph_summary", sql(f"SELECT 'node' AS kind, * FROM ({NODES}) UNION ALL SELECT 'edge', * FROM ({EDGES})", *ALL))
def graph_summary(s, sf):
    return G.graph_counts(sessions(s, sf), B.users(s, sf), B.videos(s, sf))


@query("structural_view", sql(f"SELECT 'node' AS kind, * FROM ({NODES}) WHERE name <> 'session' UNION ALL SELECT 'edge', * FROM ({EDGES}) WHERE name NOT IN ('followed', 'next_in_session')", *ALL))
def structural_view(s, sf):
    return G.graph_summary(G.structural_view(graph(s, sf)))


@query("sequential_view", sql(f"SELECT 'node' AS kind, * FROM ({NODES}) WHERE name IN ('video', 'session') UNION ALL SELECT 'edge', * FROM ({EDGES}) WHERE name = 'next_in_session'", *ALL))
def sequential_view(s, sf):
    return G.graph_summary(G.sequential_view(graph(s, sf)))


@query("merged_edges", sql("""SELECT rel_id, src, dst, count(*) AS n FROM (
    SELECT CASE rel WHEN 'clicked' THEN 0 WHEN 'liked' THEN 1 ELSE 4 END AS rel_id, src, dst + (SELECT count(*) FROM uid) AS dst FROM feedback WHERE rel <> 'followed' UNION ALL
    SELECT 5, src + (SELECT count(*) FROM uid), dst + (SELECT count(*) FROM uid) + (SELECT count(*) FROM vid) FROM made UNION ALL
    SELECT 6, src + (SELECT count(*) FROM uid), dst + (SELECT count(*) FROM uid) + (SELECT count(*) FROM vid) + (SELECT count(*) FROM aid) FROM tagged) GROUP BY 1, 2, 3""", "feedback", "made", "tagged"))
def merged_edges(s, sf):
    return G.merged_edges(graph(s, sf)).groupBy("rel_id", "src", "dst").agg(F.count("*").alias("n"))


U, V, A, C = (f"(SELECT count(*) FROM {t})" for t in ("uid", "vid", "aid", "cid"))


@query("merged_edges_all", sql(f"""SELECT rel_id, src, dst, count(*) AS n FROM (
    SELECT 0 AS rel_id, user_idx AS src, video_idx + {U} AS dst FROM known UNION ALL SELECT CASE rel WHEN 'clicked' THEN 1 WHEN 'liked' THEN 2 ELSE 5 END, src, dst + {U} FROM feedback WHERE rel <> 'followed' UNION ALL
    SELECT 6, src, dst + {U} + {V} FROM followed_authors UNION ALL SELECT 7, src + {U}, dst + {U} + {V} FROM made UNION ALL SELECT 8, src + {U}, dst + {U} + {V} + {A} FROM tagged UNION ALL SELECT 9, src + {U}, dst + {U} FROM knxt) GROUP BY 1, 2, 3""", *ALL))
def merged_edges_all(s, sf):
    return G.merged_edges(graph(s, sf), list(MERGED_ALL)).groupBy("rel_id", "src", "dst").agg(F.count("*").alias("n"))


@query("keep_list", sql("SELECT user_id, video_id, CAST(is_click AS INTEGER) AS is_click, author_id, duration_ms, count(*) AS n FROM log LEFT JOIN authors USING (video_id) GROUP BY ALL", "log", "authors"))
def keep_list(s, sf):
    """Of the columns that the sequence model keeps, those that are there."""
    kept = keep(B.log(s, sf).join(B.authors(s, sf), "video_id", "left"), KEEP).withColumn("is_click", F.col("is_click").cast("int"))
    return kept.groupBy(*kept.columns).agg(F.count("*").alias("n"))


@query("edge_cap", sql("""SELECT rel, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY md5(concat_ws('|', 42, src, dst, seq)), src, dst) AS place FROM (
    SELECT rel, src, dst, -1 AS seq FROM feedback UNION ALL SELECT 'next_in_session', src, dst, seq FROM knxt)) WHERE place <= 300""", "feedback", "knxt"))
def edge_cap(s, sf):
    k = known(s, sf)
    return G.cap_edges(G.feedback(k).unionByName(G.in_session(k)), 300).select("rel", "src", "dst")


def item_edges(s, sf):
    """Session transitions as edges of two relations among items that have vectors."""
    return pairs(s, sf).select(F.when(F.col("tab") < 7, "low").otherwise("high").alias("rel"), "src", "dst", "session_id", "seq")


ITEM = "SELECT CASE WHEN tab < 7 THEN 'low' ELSE 'high' END AS rel, src, dst, session_id, seq FROM nxt"
OUT = "SELECT idx, list(round(x, 5) + 0.0 ORDER BY i) AS emb FROM ({}) GROUP BY idx"


def out(df):
    return df.select("idx", rounded(F.col("emb"), 5).alias("emb"))


@query("propagate_mean", sql(OUT.format(f"""SELECT c.idx, c.i, c.x + coalesce(m, 0) AS x FROM comp c LEFT JOIN (
    SELECT dst, i, sum(m) AS m FROM (SELECT dst, rel, i, avg(x) AS m FROM ({ITEM}) JOIN comp ON idx = src GROUP BY 1, 2, 3) GROUP BY 1, 2) g ON g.dst = c.idx AND g.i = c.i"""), "comp", "nxt"))
def propagate_mean(s, sf):
    return out(P.propagate_mean(B.vectors(s, sf), item_edges(s, sf), WIDTH, layers=1, normalise=False))


def layer(vectors: str) -> str:
    """One round over (idx, i, x): own and means by relation, layer norm, ReLU."""
    return f"""SELECT idx, i, greatest((x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5), 0) AS x FROM (SELECT c.idx, c.i, c.x + coalesce(m, 0) AS x FROM {vectors} c LEFT JOIN (
      SELECT dst, i, sum(m) AS m FROM (SELECT dst, rel, i, avg(x) AS m FROM ({ITEM}) JOIN {vectors} ON idx = src GROUP BY 1, 2, 3) GROUP BY 1, 2) g ON g.dst = c.idx AND g.i = c.i) WINDOW w AS (PARTITION BY idx)"""


@query("propagate_mean_layers", sql(f"SELECT * FROM (WITH l1 AS ({layer('comp')}) " + OUT.format(layer("l1")) + ")", "comp", "nxt"))
def propagate_mean_layers(s, sf):
    return out(P.propagate_mean(B.vectors(s, sf), item_edges(s, sf), WIDTH, layers=2))


TURNED = "SELECT m.idx, m.rel, j AS i, sum(x * w) AS x FROM ({}) m JOIN mat ON mat.i = m.i AND k = CASE rel {} END GROUP BY 1, 2, 3"
OWN = "SELECT idx, j AS i, sum(x * w) AS x FROM comp JOIN mat USING (i) WHERE k = {} GROUP BY 1, 2"


@query("propagate_mean_weighted", sql(OUT.format(f"""SELECT c.idx, c.i, c.x + coalesce(m, 0) AS x FROM ({OWN.format(2)}) c LEFT JOIN (
    SELECT idx, i, sum(x) AS m FROM ({TURNED.format(f"SELECT src AS idx, rel, i, avg(x) AS x FROM ({ITEM}) JOIN comp ON idx = dst GROUP BY 1, 2, 3", "WHEN 'low' THEN 0 WHEN 'high' THEN 1")}) GROUP BY 1, 2) g ON g.idx = c.idx AND g.i = c.i"""), "comp", "nxt", "mat"))
def propagate_mean_weighted(s, sf):
    """With a matrix a relation and one for the own vector, against the direction of the edges."""
    return out(P.propagate_mean(B.vectors(s, sf), item_edges(s, sf), WIDTH, layers=1, normalise=False, weights={"low": B.weights(0), "high": B.weights(1)}, own=B.weights(2), direction="out"))


@query("propagate_sum", sql(OUT.format("""SELECT c.idx, c.i, 0.5 * c.x + 0.5 * tanh(c.x + coalesce(m, 0)) AS x FROM comp c LEFT JOIN (
    SELECT dst, i, sum(x) AS m FROM nxt JOIN comp ON idx = src GROUP BY 1, 2) g ON g.dst = c.idx AND g.i = c.i"""), "comp", "nxt"))
def propagate_sum(s, sf):
    return out(P.propagate_sum(B.vectors(s, sf), item_edges(s, sf), WIDTH))


@query("propagate_sum_layers", sql("SELECT * FROM (WITH s1 AS ({0}) ".format("""SELECT c.idx, c.i, 0.5 * c.x + 0.5 * tanh(c.x + coalesce(m, 0)) AS x FROM comp c LEFT JOIN (
    SELECT dst, i, sum(x) AS m FROM nxt JOIN comp ON idx = src GROUP BY 1, 2) g ON g.dst = c.idx AND g.i = c.i""") + OUT.format("""SELECT c.idx, c.i, 0.5 * c.x + 0.5 * tanh(c.x + coalesce(m, 0)) AS x FROM s1 c LEFT JOIN (
    SELECT dst, i, sum(x) AS m FROM nxt JOIN s1 ON idx = src GROUP BY 1, 2) g ON g.dst = c.idx AND g.i = c.i""") + ")", "comp", "nxt"))
def propagate_sum_layers(s, sf):
    """Two steps over edges that are laid out by their source once."""
    return out(P.propagate_sum(B.vectors(s, sf), item_edges(s, sf), WIDTH, steps=2))


GATED = """WITH hm AS (SELECT c.idx, c.i, c.x AS h, coalesce(m, 0) AS m FROM comp c LEFT JOIN (SELECT dst, i, sum(x) AS m FROM nxt JOIN comp ON idx = src GROUP BY 1, 2) g ON g.dst = c.idx AND g.i = c.i),
  w AS (SELECT i, j, max(w) FILTER (k = 0) AS wz, max(w) FILTER (k = 1) AS uz, max(w) FILTER (k = 2) AS wr, max(w) FILTER (k = 3) AS ur, max(w) FILTER (k = 4) AS wh, max(w) FILTER (k = 5) AS uh FROM mat GROUP BY 1, 2),
  turned AS (SELECT idx, j AS i, 1 / (1 + exp(-sum(m * wz + h * uz))) AS z, 1 / (1 + exp(-sum(m * wr + h * ur))) AS r, sum(m * wh) AS c FROM hm JOIN w USING (i) GROUP BY 1, 2),
  kept AS (SELECT idx, j AS i, sum(r * h * uh) AS u FROM turned JOIN hm USING (idx, i) JOIN w USING (i) GROUP BY 1, 2)
  SELECT idx, i, (1 - z) * h + z * tanh(c + u) AS x FROM turned JOIN hm USING (idx, i) JOIN kept USING (idx, i)"""


@query("propagate_sum_gated", sql(OUT.format(GATED), "comp", "nxt", "mat"))
def propagate_sum_gated(s, sf):
    """With an update and a reset gate of each node, from matrices."""
    return out(P.propagate_sum(B.vectors(s, sf), item_edges(s, sf), WIDTH, gate=P.Gates(*[B.weights(k) for k in range(6)])))


SCORED = "SELECT e.*, (SELECT 1) AS one, w.score FROM (SELECT *, row_number() OVER () AS e FROM ({item})) e JOIN (SELECT src AS ws, dst AS wd, sum(a.x * b.x) / {by} AS score FROM (SELECT DISTINCT src, dst FROM nxt) JOIN comp a ON a.idx = src JOIN comp b ON b.idx = dst AND b.i = a.i GROUP BY 1, 2) w ON ws = src AND wd = dst"


def attention(to: str, other: str, by: str) -> str:
    scored = SCORED.format(item=ITEM, by=by)
    return OUT.format(f"""SELECT c.idx, c.i, c.x + coalesce(m, 0) AS x FROM comp c LEFT JOIN (
      SELECT {to} AS at, v.i, sum(exp(score) * v.x) / sum(exp(score)) AS m FROM ({scored}) JOIN comp v ON v.idx = {other} GROUP BY 1, 2) g ON g.at = c.idx AND g.i = c.i""")


@query("propagate_attention_in", sql(attention("dst", "src", "sqrt(64)"), "comp", "nxt"))
def propagate_attention_in(s, sf):
    return out(P.propagate_attention_in(B.vectors(s, sf), item_edges(s, sf), WIDTH))


EACH = "SELECT idx, rel, i, x FROM comp, (VALUES ('low'), ('high')) r(rel)"


@query("propagate_attention_in_weighted", sql(OUT.format(f"""SELECT c.idx, c.i, c.x + coalesce(m, 0) AS x FROM comp c LEFT JOIN (SELECT dst, v.i, sum(exp(score) * v.x) / sum(exp(score)) AS m FROM (
    SELECT e.dst, e.src, e.rel, score FROM ({ITEM}) e JOIN (SELECT p.src, p.dst, p.rel, sum(q.x * k.x) / sqrt(64) AS score FROM (SELECT DISTINCT src, dst, rel FROM ({ITEM})) p
      JOIN ({TURNED.format(EACH, "WHEN 'low' THEN 0 WHEN 'high' THEN 1")}) q ON q.idx = p.dst AND q.rel = p.rel JOIN ({TURNED.format(EACH, "WHEN 'low' THEN 2 WHEN 'high' THEN 3")}) k ON k.idx = p.src AND k.rel = p.rel AND k.i = q.i GROUP BY 1, 2, 3) w
      ON w.src = e.src AND w.dst = e.dst AND w.rel = e.rel) s JOIN ({TURNED.format(EACH, "WHEN 'low' THEN 4 WHEN 'high' THEN 5")}) v ON v.idx = s.src AND v.rel = s.rel GROUP BY 1, 2) g ON g.dst = c.idx AND g.i = c.i"""), "comp", "nxt", "mat"))
def propagate_attention_in_weighted(s, sf):
    q, k, v = ({"low": B.weights(a), "high": B.weights(a + 1)} for a in (0, 2, 4))
    return out(P.propagate_attention_in(B.vectors(s, sf), item_edges(s, sf), WIDTH, query=q, key=k, value=v))


def covisit() -> str:
    return attention("dst", "src", "sqrt(64)").replace(ITEM, "SELECT DISTINCT src, dst FROM nxt")


@query("propagate_covisit", sql(covisit(), "comp", "nxt"))
def propagate_covisit(s, sf):
    return out(P.propagate_covisit(B.vectors(s, sf), item_edges(s, sf), WIDTH))


@query("propagate_attention_out", sql(attention("src", "dst", "1"), "comp", "nxt"))
def propagate_attention_out(s, sf):
    return out(P.propagate_attention_out(B.vectors(s, sf), item_edges(s, sf), WIDTH, normalise=False))


@query("propagate_attention_out_weighted", sql(OUT.format(f"""SELECT idx, i, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5) AS x FROM (SELECT c.idx, c.i, c.x + coalesce(m, 0) AS x FROM comp c LEFT JOIN (
    SELECT e.src, v.i, sum(exp(score) * v.x) / sum(exp(score)) AS m FROM ({ITEM}) e JOIN (SELECT p.src, p.dst, p.rel, sum(q.x * k.x) AS score FROM (SELECT DISTINCT src, dst, rel FROM ({ITEM})) p
      JOIN ({TURNED.format(EACH, "WHEN 'low' THEN 0 WHEN 'high' THEN 1")}) q ON q.idx = p.src AND q.rel = p.rel JOIN comp k ON k.idx = p.dst AND k.i = q.i GROUP BY 1, 2, 3) w
      ON w.src = e.src AND w.dst = e.dst AND w.rel = e.rel JOIN comp v ON v.idx = e.dst GROUP BY 1, 2) g ON g.src = c.idx AND g.i = c.i) WINDOW w AS (PARTITION BY idx)"""), "comp", "nxt", "mat"))
def propagate_attention_out_weighted(s, sf):
    """With a matrix a relation, and the layer norm."""
    return out(P.propagate_attention_out(B.vectors(s, sf), item_edges(s, sf), WIDTH, weights={"low": B.weights(0), "high": B.weights(1)}))


READOUT = """SELECT session_id, i, sum(exp(score) * x) / sum(exp(score)) AS att, any_value(lx) AS last FROM (
    SELECT t.session_id, v.i, v.x, l.x AS lx, sum(tanh(l.x + v.x)) OVER (PARTITION BY t.session_id, t.idx) AS score FROM (SELECT DISTINCT session_id, unnest([src, dst]) AS idx FROM nxt) t
      JOIN (SELECT session_id, last(dst ORDER BY seq) AS last FROM nxt GROUP BY 1) z ON z.session_id = t.session_id JOIN comp v ON v.idx = t.idx JOIN comp l ON l.idx = z.last AND l.i = v.i) GROUP BY 1, 2"""
SESSION_OUT = "SELECT n.session_id, list(round(coalesce({}, 0), 5) + 0.0 ORDER BY n.i) AS emb FROM (SELECT session_id, i FROM (SELECT DISTINCT session_id FROM sess), (SELECT unnest(range(1, 65)) AS i)) n LEFT JOIN ({}) r ON r.session_id = n.session_id AND r.i = n.i GROUP BY 1"


def readout(s, sf):
    return P.session_readout(B.vectors(s, sf), pairs(s, sf), sessions(s, sf), WIDTH)


@query("session_readout", sql(SESSION_OUT.format("att", READOUT), "comp", "nxt"))
def session_readout(s, sf):
    return readout(s, sf).select("session_id", rounded(F.col("att"), 5).alias("emb"))


@query("recency_blend", sql(SESSION_OUT.format("0.7 * att + 0.3 * r.last", READOUT), "comp", "nxt"))
def recency_blend(s, sf):
    return P.recency_blend(readout(s, sf), 0.7).select("session_id", rounded(F.col("emb"), 5).alias("emb"))


def user_pairs(s, sf):
    """Rows with the user's and the video's vectors; users take the vector of their number."""
    v = B.vectors(s, sf)
    return P.gather_pairs(B.log(s, sf).select("row_key", "user_id", "video_id"), {"q": (v, "user_id"), "k": (v, "video_id")})


HEADS = """SELECT row_key, v.i, v.x * w AS x FROM (
    SELECT row_key, video_id, h, exp(score) / sum(exp(score)) OVER (PARTITION BY row_key) AS w FROM (
      SELECT row_key, video_id, (a.i - 1) // 32 AS h, sum(a.x * b.x) / sqrt(32) AS score FROM log JOIN comp a ON a.idx = user_id JOIN comp b ON b.idx = video_id AND b.i = a.i GROUP BY 1, 2, 3)) JOIN comp v ON v.idx = video_id AND (v.i - 1) // 32 = h"""


@query("align_pairs", sql(f"SELECT row_key, list(round(x, 5) + 0.0 ORDER BY i) AS pair_vector FROM ({HEADS}) GROUP BY 1", "log", "comp"))
def align_pairs(s, sf):
    return P.align_pairs(user_pairs(s, sf), "q", "k", ["k"], WIDTH, 2).select("row_key", rounded(F.col("pair_vector"), 5).alias("pair_vector"))


@query("pair_concat", sql("SELECT row_key, list_concat(list(round(a.x, 5) + 0.0 ORDER BY a.i), list(round(b.x, 5) + 0.0 ORDER BY b.i)) AS pair_vector FROM log JOIN comp a ON a.idx = user_id JOIN comp b ON b.idx = video_id AND b.i = a.i GROUP BY 1", "log", "comp"))
def pair_concat(s, sf):
    return P.concat_pairs(user_pairs(s, sf), ["q", "k"]).select("row_key", rounded(F.col("pair_vector"), 5).alias("pair_vector"))


KG_PATHS = """SELECT row_key, coalesce(a.n, 0) AS same_author, coalesce(c.n, 0) AS same_category FROM log
    LEFT JOIN (SELECT row_key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT row_key, coalesce(sum(is_click) OVER (PARTITION BY user_id, author_id ORDER BY time_ms, row_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM log JOIN authors USING (video_id)) GROUP BY 1) a USING (row_key)
    LEFT JOIN (SELECT row_key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT row_key, coalesce(sum(is_click) OVER (PARTITION BY user_id, tag ORDER BY time_ms, row_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM log JOIN (SELECT DISTINCT * FROM tags) USING (video_id)) GROUP BY 1) c USING (row_key)"""


@query("kg_paths", sql(KG_PATHS, "log", "authors", "tags"))
def kg_paths(s, sf):
    tags = B.videos(s, sf).select("video_id", F.explode("tag_list").alias("tag"))
    return P.path_counts(B.log(s, sf), B.authors(s, sf), tags)


@query("history_pool", sql(f"""SELECT h.row_key, list(round(coalesce(x, 0), 4) + 0.0 ORDER BY h.i) AS pooled FROM (SELECT row_key, i FROM ({HISTORY}), (SELECT unnest(range(1, 65)) AS i) WHERE hist IS NOT NULL) h LEFT JOIN (
    SELECT row_key, v.i, sum(w * v.x) AS x FROM (SELECT row_key, item, video_id FROM (SELECT row_key, video_id, unnest(hist) AS item FROM ({HISTORY}) WHERE hist IS NOT NULL))
      JOIN (SELECT ia, ib, sum(a.x * b.x) AS w FROM (SELECT DISTINCT unnest(hist) AS ia, video_id AS ib FROM ({HISTORY}) WHERE hist IS NOT NULL) JOIN comp a ON a.idx = ia JOIN comp b ON b.idx = ib AND b.i = a.i GROUP BY 1, 2) ON ia = item AND ib = video_id JOIN comp v ON v.idx = item GROUP BY 1, 2) p ON p.row_key = h.row_key AND p.i = h.i GROUP BY 1""", "log", "comp"))
def history_pool(s, sf):
    vectors = B.read(s, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("emb"))  # as stored: half the bytes of doubles
    return P.history_pool_of_log(B.raw_log(s, sf), vectors, WIDTH, digits=4)


FEATURE_ROWS = """SELECT 'user' AS node_type, u.idx, 0 AS k, f.i, f.x FROM uid u JOIN (
      SELECT c_custkey AS id, unnest(range(1, 3)) AS i, unnest([CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 3.0 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END, ln(1 + greatest(c_acctbal, 0))]) AS x FROM customer UNION ALL
      SELECT c_custkey, j + 2, w FROM customer JOIN mat ON k = 3 AND i = c_nationkey % 5 + 1 AND j <= 8 UNION ALL SELECT c_custkey, j + 10, w FROM customer JOIN mat ON k = 4 AND i = c_custkey % 3 + 1 AND j <= 8) f ON f.id = u.raw_id
    UNION ALL SELECT 'video', v.idx, 1, f.i, f.x FROM vid v JOIN (SELECT r.video_id AS id, unnest(range(1, 6)) AS i, unnest([CASE WHEN server_height = 0 THEN 1.0 ELSE server_width / server_height END, video_duration / 1000,
      coalesce(CASE WHEN show_cnt = 0 THEN 0.0 ELSE least(valid_play_cnt / show_cnt, 1) END, 0), coalesce(ln(1 + show_cnt), 0), coalesce(ln(1 + like_cnt), 0)]) AS x FROM raw_videos r LEFT JOIN stats USING (video_id)) f ON f.id = v.raw_id
    UNION ALL SELECT 'author', idx, 2, 1, 0.0 FROM aid UNION ALL SELECT 'category', idx, 2, 1, 0.0 FROM cid UNION ALL SELECT 'session', unnest(range(0, (SELECT max(session_id) + 1 FROM sess))), 2, 1, 0.0"""


@query("project_nodes", sql(f"SELECT node_type, idx, list(round(greatest(x, 0), 5) + 0.0 ORDER BY j) AS emb FROM (SELECT node_type, idx, j, sum(x * w) + CASE WHEN node_type = 'author' THEN 0.25 ELSE 0 END AS x FROM ({FEATURE_ROWS}) f JOIN mat ON mat.k = f.k AND mat.i = f.i GROUP BY 1, 2, 3) GROUP BY 1, 2", "uid", "vid", "aid", "cid", "sess", "stats", "mat"))
def project_nodes(s, sf):
    """Nodes of every type; two features of users are codes with tables of eight columns."""
    none = B.weights(2)[:1]
    weights = {"user": B.weights(0)[:18], "video": B.weights(1)[:5], "author": none, "category": none, "session": none}
    lookups = {"user": {2: B.weights(3)[:5, :8], 3: B.weights(4)[:3, :8]}}
    found = P.project_nodes(graph(s, sf).nodes, weights, {"author": 0.25}, lookups)
    return found.select("node_type", "idx", rounded(F.col("emb"), 5).alias("emb"))
