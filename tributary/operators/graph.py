"""Heterogeneous click graph as tables: id maps, nodes, edges, views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.derive import edge_attributes, ips_weight
from tributary.operators.clean import in_domain, vector
from tributary.operators.prefix import ordered_prefix, written
from tributary.operators.sessions import next_in_session
from tributary.operators.store import bucket_count, ddl, read_bucketed, write_bucketed
from tributary.schema import ENCRYPTED, NODE_TYPES, RELATIONS

USER_FEATURES = ("activity", "is_lowactive_period", "is_live_streamer", "is_video_author", "log_follow_user_num", "log_fans_user_num", "log_friend_user_num", "log_register_days", *ENCRYPTED)
VIDEO_FEATURES = ("aspect_ratio", "duration_s", "global_cvr", "log_show_cnt", "log_play_cnt", "log_like_cnt", "log_follow_cnt", "log_share_cnt", "log_collect_cnt", "log_comment_cnt")


@dataclass(frozen=True)
class Graph:
    """nodes (node_type, idx, features) and edges (see schema.EDGES)."""

    nodes: DataFrame
    edges: DataFrame


def id_map(df: DataFrame, column: str) -> DataFrame:
    """(raw_id, idx): sorted distinct values numbered from 0; null has no number."""
    return ordered_prefix(df.where(F.col(column).isNotNull()).select(F.col(column).alias("raw_id")).distinct(), [F.col("raw_id")], rank="idx")


def category_map(videos: DataFrame, tags: str = "tag_list") -> DataFrame:
    return id_map(videos.select(F.explode(tags).alias("tag")), "tag")


def node_table(ids: DataFrame, node_type: str, features: DataFrame | None = None, key: str = "", names: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of one type; without features a single zero."""
    if features is None:
        return ids.select(F.lit(node_type).alias("node_type"), "idx", F.array(F.lit(0.0)).alias("features"))
    joined = ids.join(features.withColumnRenamed(key, "raw_id"), "raw_id", "left")
    return joined.select(F.lit(node_type).alias("node_type"), "idx", vector(names, joined).alias("features"))


def session_nodes(sessions: DataFrame) -> DataFrame:
    """Session nodes 0 .. max id; ids start at 1, so node 0 has no rows; none for an empty log."""
    count = sessions.agg((F.coalesce(F.max("session_id"), F.lit(-1)) + 1).alias("n"))
    return count.where("n > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx")).select(F.lit("session").alias("node_type"), "idx", F.array(F.lit(0.0)).alias("features"))


def _edge(rel: str, src: str, dst: str, attr=None, is_rand=None, session=None, seq=None) -> list:
    kinds = RELATIONS[rel]
    null = lambda c, t: F.lit(None).cast(t) if c is None else c
    return [F.lit(kinds[0]).alias("src_type"), F.lit(rel).alias("rel"), F.lit(kinds[1]).alias("dst_type"), F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), null(attr, "array<double>").alias("attr"), null(is_rand, "boolean").alias("is_rand"), null(session, "long").alias("session_id"), null(seq, "long").alias("seq")]


def interacted(log: DataFrame) -> DataFrame:
    """Every row of a log with indexes, with [play ratio, long view, tab share, weight]."""
    return log.select(*_edge("interacted", "user_idx", "video_idx", edge_attributes("play_ratio", "long_view", "tab", ips_weight("is_rand")), F.col("is_rand") == 1))


def feedback(log: DataFrame) -> DataFrame:
    """One edge for every flag that is 1, all relations in one pass; absent flags are skipped."""
    marks = [F.when(F.col(flag) == 1, F.lit(rel)) for rel, (_, _, _, _, flag) in RELATIONS.items() if flag and flag in log.columns]
    hit = log.select("user_idx", "video_idx", F.explode(F.array_compact(F.array(*marks))).alias("rel"))
    return hit.select(F.lit("user").alias("src_type"), "rel", F.lit("video").alias("dst_type"), F.col("user_idx").cast("long").alias("src"), F.col("video_idx").cast("long").alias("dst"), F.lit(None).cast("array<double>").alias("attr"), F.lit(None).cast("boolean").alias("is_rand"), F.lit(None).cast("long").alias("session_id"), F.lit(None).cast("long").alias("seq"))


def made_by(videos: DataFrame, video_ids: DataFrame, author_ids: DataFrame) -> DataFrame:
    """Videos with a known author."""
    joined = videos.select("video_id", "author_id").join(video_ids.select(F.col("raw_id").alias("video_id"), F.col("idx").alias("v")), "video_id").join(author_ids.select(F.col("raw_id").alias("author_id"), F.col("idx").alias("a")), "author_id")
    return joined.select(*_edge("made_by", "v", "a"))


def follows(log: DataFrame, made: DataFrame) -> DataFrame:
    """Users to authors of videos from whose rows they followed; repeats stay."""
    rows = log.where(F.col("is_follow") == 1).select("user_idx", F.col("video_idx").alias("v"))
    return rows.join(made.select(F.col("src").alias("v"), F.col("dst").alias("a")), "v").select(*_edge("follows", "user_idx", "a"))


def tagged_as(videos: DataFrame, video_ids: DataFrame, categories: DataFrame) -> DataFrame:
    tags = videos.select("video_id", F.explode("tag_list").alias("tag"))
    joined = tags.join(video_ids.select(F.col("raw_id").alias("video_id"), F.col("idx").alias("v")), "video_id").join(categories.select(F.col("raw_id").alias("tag"), F.col("idx").alias("c")), "tag")
    return joined.select(*_edge("tagged_as", "v", "c"))


def in_session(log: DataFrame, most: int = 50) -> DataFrame:
    """Consecutive videos of sessions, after unknown users and videos have gone."""
    pairs = next_in_session(log, "video_idx", most)
    return pairs.select(*_edge("next_in_session", "src", "dst", F.array(F.coalesce(F.col("tab").cast("double"), F.lit(0.0)) / 14), None, F.col("session_id"), F.col("seq")))


def build_graph(log: DataFrame, users: DataFrame, videos: DataFrame, most: int = 50, scope: str = "train") -> Graph:
    """Nodes and edges of a sessionised log.

    With ``scope`` "train" and a ``split`` column only training rows give edges, so that no test
    click leaks; "all" takes every row.
    """
    if scope == "train" and "split" in log.columns:
        log = log.where(F.col("split") == "train")
    user_ids, video_ids, author_ids, categories = id_map(users, "user_id"), id_map(videos, "video_id"), id_map(videos, "author_id"), category_map(videos)
    known = written(in_domain(log, user_ids, video_ids), "known")  # five relations read it
    made = made_by(videos, video_ids, author_ids)
    parts = [interacted(known), feedback(known), follows(known, made), made, tagged_as(videos, video_ids, categories), in_session(known, most)]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    nodes = node_table(user_ids, "user", users, "user_id", USER_FEATURES)
    for more in (node_table(video_ids, "video", videos, "video_id", VIDEO_FEATURES), node_table(author_ids, "author"), node_table(categories, "category"), session_nodes(log)):
        nodes = nodes.unionByName(more)
    return Graph(nodes, edges)


def structural_view(graph: Graph) -> Graph:
    """Users, videos, authors and categories with the structural relations."""
    rels = [r for r, x in RELATIONS.items() if x[2]]
    return Graph(graph.nodes.where(F.col("node_type") != "session"), graph.edges.where(F.col("rel").isin(rels)))


def sequential_view(graph: Graph) -> Graph:
    return Graph(graph.nodes.where(F.col("node_type").isin("video", "session")), graph.edges.where(F.col("rel") == "next_in_session"))


def graph_summary(graph: Graph) -> DataFrame:
    """(kind, name, n): nodes by type and edges by relation."""
    n = graph.nodes.groupBy(F.col("node_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    e = graph.edges.groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    return n.unionByName(e)


def graph_counts(log: DataFrame, users: DataFrame, videos: DataFrame, most: int = 50) -> DataFrame:
    """(kind, name, n): what ``graph_summary`` of the whole graph says, counted without numbering or building it."""
    distinct = lambda df, c: df.where(F.col(c).isNotNull()).select(c).distinct()
    user_ids, video_ids = distinct(users, "user_id"), distinct(videos, "video_id")
    known = written(log.join(user_ids, "user_id", "left_semi").join(video_ids, "video_id", "left_semi"), "known")
    tags = videos.select("video_id", F.explode("tag_list").alias("tag"))
    made = videos.where(F.col("author_id").isNotNull()).select("video_id")
    marks = [F.sum((F.col(flag) == 1).cast("long")).alias(rel) for rel, (_, _, _, _, flag) in RELATIONS.items() if flag and flag in log.columns]
    flags = known.agg(F.count("*").alias("interacted"), *marks)
    seen = flags.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for c in flags.columns])).alias("x")).select("x.*")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    edges = seen.unionByName(n(known.where(F.col("is_follow") == 1).join(made, "video_id"), "follows")).unionByName(n(made, "made_by")).unionByName(n(tags, "tagged_as")).unionByName(n(next_in_session(known, "video_id", most), "next_in_session"))
    sessions = log.agg((F.coalesce(F.max("session_id"), F.lit(-1)) + 1).alias("n")).select(F.lit("session").alias("name"), "n")
    nodes = n(user_ids, "user").unionByName(n(video_ids, "video")).unionByName(n(distinct(videos, "author_id"), "author")).unionByName(n(tags.select("tag").distinct(), "category")).unionByName(sessions)
    kind = lambda df, k: df.where("n > 0").select(F.lit(k).alias("kind"), "name", "n")
    return kind(nodes, "node").unionByName(kind(edges, "edge"))


def merged_edges(graph: Graph, relations: list[str] | None = None) -> DataFrame:
    """(rel_id, src, dst) with node numbers offset by type: users, videos, authors, categories, sessions in turn."""
    relations = relations or [r for r, x in RELATIONS.items() if x[3]]
    counts = {r["node_type"]: r["n"] for r in graph.nodes.groupBy("node_type").agg(F.count("*").alias("n")).collect()}  # five rows
    offset, before = {}, 0
    for t in NODE_TYPES:
        offset[t] = before
        before += counts.get(t, 0)
    shift = F.create_map(*[F.lit(x) for t, o in offset.items() for x in (t, o)])
    rel_id = F.create_map(*[F.lit(x) for k, r in enumerate(relations) for x in (r, k)])
    return graph.edges.where(F.col("rel").isin(relations)).select(rel_id[F.col("rel")].alias("rel_id"), (F.col("src") + shift[F.col("src_type")]).alias("src"), (F.col("dst") + shift[F.col("dst_type")]).alias("dst"))


def cap_edges(edges: DataFrame, most: int = 200_000, seed: int = 42) -> DataFrame:
    """At most ``most`` edges of each relation, the first by a seeded hash: the same sample every time.

    A threshold on the hash that a few more than ``most`` pass goes first, so that no task sorts a
    relation; where too few pass, as with many equal edges, the relation is sorted whole.
    """
    marked = edges.withColumn("__mark", F.md5(F.concat_ws("|", F.lit(seed), "src", "dst", F.coalesce(F.col("seq"), F.lit(-1)))))
    place = F.conv(F.substring("__mark", 1, 12), 16, 10).cast("long") / float(1 << 48)
    n = {r["rel"]: r["n"] for r in edges.groupBy("rel").agg(F.count("*").alias("n")).collect()}  # the catalog's size
    if not n:
        return edges
    upto = {rel: min(1.0, (most + 6 * most**0.5 + 20) / k) for rel, k in n.items()}
    limit = lambda found: F.create_map(*[F.lit(x) for rel, v in found.items() for x in (rel, v)])[F.col("rel")]
    passed = {r["rel"]: r["n"] for r in marked.where(place <= limit(upto)).groupBy("rel").agg(F.count("*").alias("n")).collect()}
    upto = {rel: v if passed.get(rel, 0) >= min(most, n[rel]) else 1.0 for rel, v in upto.items()}
    first = Window.partitionBy("rel").orderBy("__mark", "src", "dst")
    return marked.where(place <= limit(upto)).withColumn("__place", F.row_number().over(first)).where(F.col("__place") <= most).drop("__mark", "__place")


def save_graph(graph: Graph, path: str, buckets: int | None = None) -> None:
    """Nodes and edges in matching buckets: nodes by (node_type, idx), edges by (src_type, src).

    Joins of saved edges with saved nodes, or with vectors by type and number, leave the edges where they are.
    """
    spark = graph.edges.sparkSession
    n = bucket_count(spark, buckets)
    write_bucketed(graph.nodes, f"{path}/nodes", ["node_type", "idx"], n)
    write_bucketed(graph.edges, f"{path}/edges", ["src_type", "src"], n)
    layout = spark.range(1).select(F.lit(n).alias("buckets"), F.lit(ddl(graph.nodes)).alias("nodes"), F.lit(ddl(graph.edges)).alias("edges"))
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")  # last: a graph without it is not whole


def load_graph(spark: SparkSession, path: str) -> Graph:
    (layout,) = spark.read.parquet(f"{path}/layout").collect()  # one row
    return Graph(read_bucketed(spark, f"{path}/nodes", layout["nodes"], ["node_type", "idx"], layout["buckets"]), read_bucketed(spark, f"{path}/edges", layout["edges"], ["src_type", "src"], layout["buckets"]))


def load_or_build(spark: SparkSession, path: str, make, rebuild: bool = False) -> Graph:
    """The saved graph, or the one that ``make`` builds, saved for the next time."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layout/_SUCCESS")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if rebuild or not there:
        save_graph(make(), path)
    return load_graph(spark, path)
