"""Exact top-k inner products by best-first search of M-trees.

Greatest inner products are least distances once every vector v gets one more component
sqrt(R^2 - |v|^2), R being the greatest norm, and every query a zero there.  In that metric
space an M-tree routes by balls: a node keeps its children's routing vectors, covering radii
and distances to its own routing vector; a leaf keeps its entries' distances.  With the
distance of the query to the node known, those stored distances rule children and entries
out by the triangle inequality before any vector is touched.

At scale the table is dealt by the nearest of a bounded set of routing vectors, which are the
roots' children; a part beyond ``tree_rows`` rows is dealt on by id, so copies cannot pile up.
Trees are built once, written as rows of pages (one a node), and searched by blocks of queries;
a block goes only to the roots whose balls its queries can still reach.  Several trees and several
blocks meet in one task, so vectors move once a tile and not once a pair of block and tree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import materialise
from tributary.llm.vectors import Best, bounded_sample, doubles, numbered, one_by_id, padded, ranked, shared_out, tile_counts, tiled


@dataclass(frozen=True)
class MTreeParams:
    """``roots`` bounds the routing vectors of the top level.  Searches start from bounds that seeds give: a sample
    of ``roots`` rows, or of a sixteenth of the table if that is more, up to ``seed_rows``."""

    k: int = 10
    scale: int = 1024
    query_divisor: int = 100
    roots: int = 64
    fanout: int = 16
    page: int = 192
    tree_rows: int = 16_000
    block: int = 256
    seed_rows: int = 2000


@dataclass
class Page:
    """A node: routing vectors, radii and parent distances of its children, or a leaf's entries."""

    children: np.ndarray  # numbers of their pages; none: a leaf
    routing: np.ndarray  # vectors of the children or entries, last component the added one
    radii: np.ndarray
    parent: np.ndarray  # distances of routing vectors to this node's own routing vector
    ids: np.ndarray

    def row(self) -> dict:
        return {"children": self.children.tolist(), "ids": self.ids.tolist(), "routing": self.routing.tobytes(), "radii": self.radii.tobytes(), "parent": self.parent.tobytes()}

    @classmethod
    def of(cls, row: dict, width: int) -> Page:
        vectors, radii, parent = (np.frombuffer(row[c]) for c in ("routing", "radii", "parent"))
        return cls(np.array(row["children"], np.int64), vectors.reshape(-1, width), radii, parent, np.array(row["ids"], np.int64))


PAGES = "array<struct<children: array<int>, ids: array<bigint>, routing: binary, radii: binary, parent: binary>>"


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


def build(ids: np.ndarray, points: np.ndarray, own: np.ndarray, params: MTreeParams, pages: list[Page] | None = None) -> list[Page]:
    """Bulk-load the pages of a tree over points whose routing vector is ``own``; the root is page 0."""
    pages = [] if pages is None else pages
    if len(ids) <= params.page:
        pages.append(Page(np.empty(0, np.int64), points, np.zeros(len(ids)), _distances(points, own), ids))
        return pages
    rng = np.random.default_rng(len(ids))
    chosen = points[rng.choice(len(ids), params.fanout, replace=False)]
    near = ((points**2).sum(1)[:, None] - 2 * points @ chosen.T + (chosen**2).sum(1)).argmin(1)
    if np.bincount(near).max() > 0.9 * len(ids):  # copies, or nearly: deal them out evenly
        order = np.argsort(_distances(points, own), kind="stable")
        near[order] = np.arange(len(ids)) * params.fanout // len(ids)
        chosen = np.array([points[near == c][0] for c in range(params.fanout)])
    parts = [c for c in range(params.fanout) if (near == c).any()]
    routing = chosen[parts]
    radii = np.array([_distances(points[near == c], chosen[c]).max() for c in parts])
    node = Page(np.empty(len(parts), np.int64), routing, radii, _distances(routing, own), np.empty(0, np.int64))
    pages.append(node)
    for k, c in enumerate(parts):
        node.children[k] = len(pages)
        build(ids[near == c], points[near == c], chosen[c], params, pages)
    return pages


#: Below these bounds of |q| |v| inner products stay exact in doubles and in 64-bit integers.
_WHOLE, _SMALL = 2.0**52, 2.0**62


def integer_products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products [query, vector]; those beyond 64 bits become the end of that range."""
    size = np.sqrt((queries**2).sum(1).max(initial=0) * (vectors**2).sum(1).max(initial=0))
    if size < _WHOLE:  # no sum of any terms is rounded
        return (queries @ vectors.T).astype(np.int64)
    if size < _SMALL and np.abs(queries).max(initial=0) < _SMALL and np.abs(vectors).max(initial=0) < _SMALL:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    left, right = ([[int(x) for x in v] for v in m.tolist()] for m in (queries, vectors))
    clip = lambda x: min(max(x, -(1 << 63) + 1), (1 << 63) - 1)
    return np.array([[clip(sum(x * y for x, y in zip(q, v, strict=True))) for v in right] for q in left], np.int64)


def search(pages: list[Page], own: np.ndarray, own_radius: float, queries: np.ndarray, reach2: np.ndarray, slack: float, best: Best) -> int:
    """Best-first search for the queries of ``best``; returns how many distances were computed.

    A page is read once for all queries that may need it, pages in the order of their least bound.
    ``reach2`` is |q|^2 + R^2, so squared distance = reach2 - 2 * score.  A page is skipped for a query
    only if its bound lies beyond the query's k-th score by more than rounding.
    """

    def limits(rows: np.ndarray) -> np.ndarray:
        least = best.scores[rows, -1]
        far = np.sqrt(np.maximum(reach2[rows] - 2.0 * least.astype(np.float64), 0)) + slack
        return np.where(least == best.least, np.inf, far)

    start = _distances(queries, own)
    low = np.maximum(start - own_radius, 0)
    heap, serial, computed = [(float(low.min()), 0, 0, np.arange(len(queries)), start, low)], 0, len(queries)
    while heap:
        _, _, number, rows, distance, low = heapq.heappop(heap)
        far, node = limits(rows), pages[number]
        still = low <= far
        rows, distance, far = rows[still], distance[still], far[still]
        # what parent distances alone rule out
        live = np.abs(distance[:, None] - node.parent) - node.radii <= far[:, None]
        some, columns = np.flatnonzero(live.any(1)), np.flatnonzero(live.any(0))
        if not len(some):
            continue
        rows, live, far = rows[some], live[np.ix_(some, columns)], far[some]
        computed += len(rows) * len(columns)
        if not len(node.children):
            best.add(rows, integer_products(node.routing[columns, :-1], queries[rows, :-1]), node.ids[columns])
            continue
        d = np.stack([_distances(queries[rows], node.routing[c]) for c in columns], 1)
        low = np.maximum(d - node.radii[columns], 0)
        for k, c in enumerate(columns):
            wanted = live[:, k] & (low[:, k] <= far)
            if wanted.any():
                serial += 1
                heapq.heappush(heap, (float(low[wanted, k].min()), serial, int(node.children[c]), rows[wanted], d[wanted, k], low[wanted, k]))
    return computed


def top_inner_products(vectors: DataFrame, params: MTreeParams = MTreeParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer inner products of every query.

    Components become floor(scale * x); queries are the ids divisible by ``query_divisor``, candidates
    every other id.  Ties go to the lesser id; with fewer candidates all are returned.  Null vectors
    and those with null or non-finite components take no part, nor do those with a component that
    ``scale`` makes infinite or a norm beyond 1e150; a shorter vector counts as ending in zeros; repeated
    ids count once (the least vector).  Scores beyond 64 bits are given as the end of that range and tie
    there.  Extra columns are ignored; an empty table gives no row.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norm2 = F.expr(f"aggregate(v, 0D, (s, x) -> s + (abs(x) * {params.scale} + 1) * (abs(x) * {params.scale} + 1))")
    whole = materialise(one_by_id(vectors).withColumn("norm2", norm2).where("norm2 < 1e300"), "vectors")
    asks = F.col("vec_id") % params.query_divisor == 0
    facts = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max("norm2").alias("r2"), F.count_if(asks).alias("queries")).first()
    if not facts["queries"]:
        return empty
    width, r2 = facts["width"], facts["r2"]
    whole = whole.select("vec_id", "v")

    def points_of(x: np.ndarray) -> np.ndarray:
        p = np.zeros((len(x), width + 1))
        p[:, :-1] = np.floor(params.scale * x)
        p[:, -1] = np.sqrt(np.maximum(r2 - (p[:, :-1] ** 2).sum(1), 0))
        return p

    sample = bounded_sample(whole, facts["n"], min(params.seed_rows, max(params.roots, facts["n"] // 16)))  # seeds bounds and roots
    seeds, seed_ids = points_of(padded(sample["v"].combine_chunks(), width, np.float64)), sample["vec_id"].to_numpy()
    roots = seeds[: params.roots]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = points_of(padded(batch.column(1), width, np.float64))
            near = ((roots**2).sum(1) - 2 * p @ roots.T).argmin(1)
            far = np.sqrt(((p - roots[near]) ** 2).sum(1))
            yield batch.append_column("root", pa.array(near.astype(np.int32))).append_column("far", pa.array(far))

    dealt = materialise(whole.mapInArrow(deal, "vec_id long, v array<double>, root int, far double"), "dealt")
    counted = dealt.groupBy("root").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.count_if(asks).alias("asking"))
    by_root = {r["root"]: r for r in counted.collect()}  # at most ``roots`` rows
    radius, many, first, asking, parts = np.zeros(len(roots)), np.zeros(len(roots), int), np.zeros(len(roots), int), np.zeros(len(roots), int), 0
    for k, r in sorted(by_root.items()):
        radius[k], many[k], first[k], asking[k] = r["radius"], -(-r["n"] // params.tree_rows), parts, r["asking"]
        parts += int(many[k])
    places = F.create_map(*[F.lit(int(x)) for k in by_root for x in (k, many[k])])
    firsts = F.create_map(*[F.lit(int(x)) for k in by_root for x in (k, first[k])])
    part = firsts[F.col("root")] + F.pmod(F.xxhash64("vec_id"), places[F.col("root")]).cast("int")

    def load(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, root = points_of(doubles(rows["v"], width)), int(rows["root"].iloc[0])
        pages = build(rows["vec_id"].to_numpy(), p, roots[root], params)
        return pd.DataFrame({"part": [key[0]], "root": [root], "radius": [rows["far"].max()], "pages": [[x.row() for x in pages]]})

    trees = materialise(dealt.withColumn("part", part).repartition(parts, "part").groupBy("part").applyInPandas(load, f"part int, root int, radius double, pages {PAGES}"), "trees")
    slack = 1e-6 * max(np.sqrt(r2), 1)
    block, blocks_of, blocks = shared_out(asking, params.block)  # queries near each other share a block

    def start(ids: np.ndarray, queries: np.ndarray) -> Best:
        """Bounds from the seeds: their k-th score less one, no result."""
        seeded = Best(ids, params.k, np.int64)
        seeded.add(np.arange(len(ids)), integer_products(seeds[:, :-1], queries[:, :-1]), seed_ids)
        seeded.scores[:] = np.where(seeded.scores[:, -1:] == seeded.least, seeded.least, seeded.scores[:, -1:] - 1)
        seeded.ids[:] = np.iinfo(np.int64).max
        return seeded

    def reach(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """A block of queries, their first bounds and the parts of the roots that any of them can reach."""
        q = points_of(doubles(rows["v"], width))
        q[:, -1] = 0
        least = start(rows["vec_id"].to_numpy(), q).scores[:, -1]
        reach2 = (q**2).sum(1) + r2
        far = np.where(least == np.iinfo(np.int64).min, np.inf, np.sqrt(np.maximum(reach2 - 2.0 * least, 0)) + slack)
        met = [k for k in by_root if (_distances(q, roots[k]) - radius[k] <= far).any()]
        parts = [int(first[k] + j) for k in met for j in range(many[k])]
        return pd.DataFrame({"block": [int(key[0])], "parts": [parts], "ids": [rows["vec_id"].tolist()], "queries": [q.tobytes()], "least": [least.tolist()]})

    asked = numbered(dealt.where(asks), "root", block, blocks_of, "block").repartition(blocks, "block")
    reached = materialise(asked.groupBy("block").applyInPandas(reach, "block int, parts array<int>, ids array<long>, queries binary, least array<long>"), "reached")

    def find(tile: pa.Table, asking: pa.Table) -> pa.Table:
        trees = [(r["root"], r["radius"], [Page.of(x, width + 1) for x in r["pages"]]) for r in tile.select(["root", "radius", "pages"]).to_pylist()]
        found = []
        for row in asking.select(["ids", "queries", "least"]).to_pylist() if trees else []:
            q = np.frombuffer(row["queries"]).reshape(-1, width + 1)
            reach2, centre = (q**2).sum(1) + r2, q.mean(0)
            found.append(Best(np.array(row["ids"]), params.k, np.int64))
            found[-1].scores[:] = np.array(row["least"])[:, None]
            for root, ball, pages in sorted(trees, key=lambda t: np.sqrt(((roots[t[0]] - centre) ** 2).sum()) - t[1]):
                search(pages, roots[root], ball, q, reach2, slack, found[-1])
        return Best.table(found, np.int64)

    tasks = 4 * spark.sparkContext.defaultParallelism
    tree_bytes = 8 * (width + 3) * min(params.tree_rows, int(max(r["n"] for r in by_root.values())))
    counts = tile_counts(parts, blocks, tree_bytes, 8 * (width + 1) * params.block, tasks)
    return ranked(tiled(trees, reached, counts, parts, blocks, find, "query_id long, vec_id long, score long"), params.k)
