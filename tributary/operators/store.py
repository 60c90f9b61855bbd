"""Edges laid out by one of their ends, so that vectors come to them and they stay where they are."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.prefix import shared_dir

#: Edges of one node beyond which its edges are dealt over several buckets or tasks.
HUB_ROWS = 200_000


def bucket_count(spark: SparkSession, buckets: int | None) -> int:
    """At least the shuffle partitions: of fewer buckets the planner makes no use."""
    return max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_bucketed(df: DataFrame, path: str, columns: list[str], buckets: int) -> None:
    """Parquet in ``path``, a file a bucket of the columns' hash; what was there goes."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    remove(spark, path)
    try:
        df.repartition(buckets, *columns).write.option("path", path).format("parquet").bucketBy(buckets, *columns).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the name only: files in a path of their own stay


def read_bucketed(spark: SparkSession, path: str, schema: str, columns: list[str], buckets: int) -> DataFrame:
    """What ``write_bucketed`` wrote; joins and groups by the columns need not move it."""
    name = f"bucketed_{uuid.uuid4().hex}"
    try:
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(columns)}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def bucketed(df: DataFrame, label: str, columns: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` written to the shared folder in buckets and read back."""
    spark = df.sparkSession
    path, n = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", bucket_count(spark, buckets)
    write_bucketed(df, path, columns, n)
    return read_bucketed(spark, path, ddl(df), columns, n)


def find_hubs(edges: DataFrame, hub_rows: int = HUB_ROWS, ends: tuple[str, ...] = ("src", "dst")) -> dict[str, dict[int, int]]:
    """By end, the nodes with more than ``hub_rows`` edges and the number of parts to deal their edges into.

    At most 10,000 nodes: of larger tables only those with more than a 5,000th of the edges.
    """
    each = edges.select(F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("idx")) for e in ends])).alias("x")).select("x.*")
    limit = max(hub_rows, edges.count() // 5_000)
    found = each.groupBy("end", "idx").agg(F.count("*").alias("n")).where(F.col("idx").isNotNull() & (F.col("n") > limit)).collect()  # bounded as said above
    return {e: {r["idx"]: -(-r["n"] // limit) for r in found if r["end"] == e} for e in ends}


def dealt(edges: DataFrame, end: str, hubs: dict[int, int]) -> DataFrame:
    """Edges with ``__part``: 0, or for a hub's edges one of its parts by the hash of their other end.  Without hubs, as they are."""
    if not hubs:
        return edges
    parts = edges.sparkSession.createDataFrame(list(hubs.items()), f"{end} long, __parts int")
    other = "src" if end == "dst" else "dst"
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other, "rel"), F.col("__parts")).cast("int"))
    return edges.join(F.broadcast(parts), end, "left").withColumn("__part", part).drop("__parts")


def copies(vectors: DataFrame, end: str, name: str, hubs: dict[int, int]) -> DataFrame:
    """(end, __part, name): vectors (idx, emb), those of hubs once a part; without hubs there are no parts."""
    table = vectors.select(F.col("idx").alias(end), F.col("emb").alias(name))
    if not hubs:
        return table
    parts = vectors.sparkSession.createDataFrame(list(hubs.items()), f"{end} long, __parts int")
    return table.join(F.broadcast(parts), end, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")


def join_keys(end: str, hubs: dict[int, int]) -> list[str]:
    return [end, "__part"] if hubs else [end]


@dataclass(frozen=True)
class EdgeStore:
    """Edges (rel, src, dst, ...) in buckets of one end; a hub's edges lie in as many buckets as it has parts."""

    edges: DataFrame
    end: str
    hubs: dict[int, int]

    def with_vectors(self, vectors: DataFrame, name: str) -> DataFrame:
        """Edges with the vector (``vectors``: idx, emb) of the end that they lie by.  Only vectors move."""
        return self.edges.join(copies(vectors, self.end, name, self.hubs), join_keys(self.end, self.hubs)).drop("__part")


def edge_store(edges: DataFrame, end: str, hub_rows: int = HUB_ROWS, buckets: int | None = None) -> EdgeStore:
    """Lay edges out by ``end`` once, for any number of layers.

    Edges without that end are left out: no vector meets them.
    """
    edges = edges.where(F.col(end).isNotNull())
    hubs = find_hubs(edges, hub_rows, (end,))[end]
    return EdgeStore(bucketed(dealt(edges, end, hubs), "edges", join_keys(end, hubs), buckets), end, hubs)
