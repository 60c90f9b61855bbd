"""Feature propagation over edge tables: gather by join, weigh, reduce by group, repeat.

Vectors are arrays of a known ``width``; reductions are one built-in aggregate a dimension, so
they combine before the shuffle.  Layers are written to the shared folder: lineage stays short.
Matrix products and softmax states are computed a batch of vectors at a time (``blocks``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tributary.functions.arrays import add, dot, layer_norm, matrix, relu, scale, total, zeros
from tributary.operators.blocks import Weights, column, combine, rounded, softmax_states, softmax_sums, turn
from tributary.operators.prefix import written
from tributary.operators.scan import Running, running
from tributary.operators.store import HUB_ROWS, EdgeStore, copies, dealt, edge_store, find_hubs, join_keys

#: Places of histories whose vectors meet in one call, and that one matrix product spans.
BLOCK, SPAN = 1 << 14, 256


def _reduced(how, vector: str, width: int, weight: Column | None = None) -> Column:
    part = lambda i: F.element_at(vector, i + 1)
    return F.array(*[how(part(i) if weight is None else part(i) * weight) for i in range(width)])


def directed(edges: DataFrame | EdgeStore, direction: str) -> DataFrame | EdgeStore:
    """``in``: messages go from src to dst; ``out``: from dst to src.  A store has the direction it was laid out in."""
    if direction == "in" or isinstance(edges, EdgeStore):
        return edges
    return edges.select(*[c for c in edges.columns if c not in ("src", "dst")], F.col("dst").alias("src"), F.col("src").alias("dst"))


def propagate_mean(nodes: DataFrame, edges: DataFrame | EdgeStore, width: int, layers: int = 2, normalise: bool = True, weights: Weights | None = None, own: np.ndarray | None = None, direction: str = "in") -> DataFrame:
    """(idx, emb): own vector plus, for each relation, the mean of the sources' vectors; then norm and ReLU.

    ``nodes`` (idx, emb), ``edges`` (rel, src, dst).  Nodes without edges towards them keep their own part.
    A relation's mean goes through its matrix in ``weights``, the own vector through ``own``; none: as they are.
    Several layers lay the edges out by source once; then only vectors and sums move.
    """
    edges = _laid_out(directed(edges, direction), layers)
    for layer in range(layers):
        gathered = _from_sources(edges, nodes)
        sums = gathered.groupBy("dst", "rel").agg(_reduced(F.sum, "emb", width).alias("sum"), F.count("*").alias("n"))
        means = turn(sums.select("dst", "rel", F.transform("sum", lambda v: v / F.col("n")).alias("mean")), "mean", weights)
        message = means.groupBy("dst").agg(_reduced(F.sum, "mean", width).alias("message"))
        updated = turn(nodes, "emb", own).join(message.withColumnRenamed("dst", "idx"), "idx", "left").withColumn("emb", add(F.col("emb"), F.coalesce("message", zeros(width)))).drop("message")
        if normalise:
            updated = updated.withColumn("emb", relu(layer_norm(F.col("emb"))))
        nodes = written(updated, "layer") if layer < layers - 1 else updated
    return nodes.select("idx", "emb")


@dataclass(frozen=True)
class Gates:
    """Matrices and biases of a gated recurrent update, rows by vector component: message m, own vector h.

    update = s(m Wz + h Uz + bz), reset = s(m Wr + h Ur + br), candidate = tanh(m Wh + (reset h) Uh + bh) with s the
    logistic function; the new vector is (1 - update) h + update candidate.
    """

    wz: np.ndarray
    uz: np.ndarray
    wr: np.ndarray
    ur: np.ndarray
    wh: np.ndarray
    uh: np.ndarray
    bz: np.ndarray | float = 0.0
    br: np.ndarray | float = 0.0
    bh: np.ndarray | float = 0.0

    def applied(self, h: np.ndarray, m: np.ndarray) -> np.ndarray:
        logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -700, 700)))
        z, r = logistic(m @ self.wz + h @ self.uz + self.bz), logistic(m @ self.wr + h @ self.ur + self.br)
        return (1 - z) * h + z * np.tanh(m @ self.wh + (r * h) @ self.uh + self.bh)


def propagate_sum(nodes: DataFrame, edges: DataFrame | EdgeStore, width: int, steps: int = 1, gate: float | Gates = 0.5, weights: np.ndarray | None = None, direction: str = "in") -> DataFrame:
    """(idx, emb): gated update of the own vector by the sum of sources along directed edges.

    The sum goes through the matrix ``weights``, if given.  A number as ``gate`` makes it
    (1 - gate) * own + gate * tanh(own + sum); ``Gates`` give each node an update and a reset gate of its own.
    Nodes without edges towards them have a sum of zeros.
    """
    edges = _laid_out(directed(edges, direction), steps)
    for step in range(steps):
        message = _from_sources(edges, nodes).groupBy("dst").agg(_reduced(F.sum, "emb", width).alias("message"))
        message = turn(message, "message", weights)
        joined = nodes.join(message.withColumnRenamed("dst", "idx"), "idx", "left").select("idx", "emb", F.coalesce("message", zeros(width)).alias("message"))
        if isinstance(gate, Gates):
            updated = combine(joined, "emb", "message", gate.applied)
        else:
            bent = F.transform(add(F.col("emb"), F.col("message")), F.tanh)
            updated = joined.select("idx", F.zip_with("emb", bent, lambda h, m: h * (1 - gate) + m * gate).alias("emb"))
        nodes = written(updated, "step") if step < steps - 1 else updated
    return nodes.select("idx", "emb")


def _laid_out(edges: DataFrame | EdgeStore, layers: int) -> DataFrame | EdgeStore:
    if layers < 2 or isinstance(edges, EdgeStore):
        return edges
    return edge_store(edges.select(*[c for c in edges.columns if c in ("rel", "src", "dst")]), "src")


def _from_sources(edges: DataFrame | EdgeStore, nodes: DataFrame) -> DataFrame:
    """Edges with the vector of their source."""
    if isinstance(edges, EdgeStore):
        return edges.with_vectors(nodes.select("idx", "emb"), "emb")
    return edges.join(nodes.withColumnRenamed("idx", "src"), "src")


def _with_end(edges: DataFrame, vectors: DataFrame, end: str, name: str, hubs: dict[int, int]) -> DataFrame:
    """Edges with the vector of one end; a hub's edges are dealt over its parts, which each hold its vector."""
    return dealt(edges, end, hubs).join(copies(vectors, end, name, hubs), join_keys(end, hubs)).drop("__part")


def _attention(nodes: DataFrame, edges: DataFrame | EdgeStore, width: int, to: str, max_scope: str, scaled: bool, at: Weights | None = None, far: Weights | None = None, value: Weights | None = None, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(idx, message): softmax of dot products over the edges that meet in ``to``, weighing the other end.

    By relation, ``at`` and ``far`` turn the vectors of the two ends before the dot product, ``value`` what is summed.
    Where both vectors of an edge have met, its task merges it into a state by node and relation (maximum, rescaled
    sum, rescaled vector); only states move on, and states of a node merge in any order.
    """
    other = "src" if to == "dst" else "dst"
    vectors = nodes.select("idx", "emb")
    if isinstance(edges, EdgeStore):
        if edges.end != other:
            raise ValueError(f"attention gathers from {other}: the edges must lie by that end, not by {edges.end}")
        hubs, far_side = find_hubs(edges.edges, hub_rows, (to,)), edges.with_vectors(vectors, "v")
    else:
        edges = written(edges.select("rel", "src", "dst"), "edges")
        hubs = find_hubs(edges, hub_rows)
        far_side = _with_end(edges, vectors, other, "v", hubs[other])
    both = _with_end(far_side.select("rel", "src", "dst", "v"), vectors, to, "q", hubs[to])
    identity = np.eye(width)
    products = {r: np.asarray((at or {}).get(r, identity)) @ np.asarray((far or {}).get(r, identity)).T for r in {**(at or {}), **(far or {})}}
    states = softmax_states(both.withColumnRenamed(to, "idx"), products, float(np.sqrt(width)) if scaled else 1.0)
    sums = turn(softmax_sums(states, width, max_scope), "summed", value)
    sums = sums.groupBy("idx").agg(_reduced(F.sum, "summed", width).alias("summed"), F.sum("all").alias("all"))
    return sums.select("idx", F.transform("summed", lambda v: v / F.col("all")).alias("message"))


def propagate_attention_in(nodes: DataFrame, edges: DataFrame | EdgeStore, width: int, max_scope: str = "all", query: Weights | None = None, key: Weights | None = None, value: Weights | None = None, direction: str = "in", hub_rows: int = HUB_ROWS) -> DataFrame:
    """(idx, emb): own vector plus attention over incoming edges, scores scaled by the root of the width.

    ``max_scope`` "type" takes the maximum before exp by relation while the denominator stays shared,
    which weighs relations against each other; "all" is the exact softmax.  ``query`` turns the node itself,
    ``key`` and ``value`` its sources, by relation; none: as they are.  Several layers over one ``edge_store`` of
    the sources move its edges with their sources' vectors only, never to meet those.
    """
    message = _attention(nodes, directed(edges, direction), width, "dst", max_scope, True, query, key, value, hub_rows)
    return nodes.join(message, "idx", "left").select("idx", add(F.col("emb"), F.coalesce("message", zeros(width))).alias("emb"))


def propagate_attention_out(nodes: DataFrame, edges: DataFrame | EdgeStore, width: int, normalise: bool = True, weights: Weights | None = None, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(idx, emb): own vector plus attention over outgoing edges, gathering targets into sources; then norm.

    A score is the source times its relation's matrix in ``weights``, dot the target.
    """
    message = _attention(nodes, edges, width, "src", "all", False, weights, hub_rows=hub_rows)
    out = nodes.join(message, "idx", "left").select("idx", add(F.col("emb"), F.coalesce("message", zeros(width))).alias("emb"))
    return out.withColumn("emb", layer_norm(F.col("emb"))) if normalise else out


def propagate_covisit(videos: DataFrame, edges: DataFrame, width: int, query: np.ndarray | None = None, key: np.ndarray | None = None, value: np.ndarray | None = None) -> DataFrame:
    """Incoming attention over video-video edges taken as one relation, each pair of videos once."""
    one = {k: None if v is None else {"covisit": v} for k, v in (("query", query), ("key", key), ("value", value))}
    return propagate_attention_in(videos, edges.select(F.lit("covisit").alias("rel"), "src", "dst").distinct(), width, **one)


def session_readout(nodes: DataFrame, pairs: DataFrame, sessions: DataFrame, width: int, weights: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(session_id, att, last): attention of a session's distinct items against its last one.

    An item's score is the sum of tanh(last + item); with ``weights`` (A, B, c) it is c . tanh(last A + item B).
    Sessions without pairs get zeros.
    """
    a, b, c = weights or (None, None, None)
    items = pairs.select("session_id", F.explode(F.array("src", "dst")).alias("idx")).distinct().join(turn(nodes.select("idx", "emb"), "emb", b, "__k"), "idx")
    last = pairs.groupBy("session_id").agg(F.max_by("dst", "seq").alias("idx")).join(turn(nodes.select("idx", F.col("emb").alias("last")), "last", a, "__q"), "idx").drop("idx")
    bent = F.zip_with("__q", "__k", lambda x, y: F.tanh(x + y))
    sum_tanh = total(bent) if c is None else dot(bent, F.array(*[F.lit(float(x)) for x in c]))
    scored = items.join(last, "session_id").withColumn("score", sum_tanh)
    weighed = scored.withColumn("w", F.exp(F.col("score") - F.max("score").over(Window.partitionBy("session_id"))))
    pooled = weighed.groupBy("session_id").agg(_reduced(F.sum, "emb", width, F.col("w")).alias("summed"), F.sum("w").alias("all"), F.first("last").alias("last"))
    att = F.transform("summed", lambda v: v / F.col("all"))
    return sessions.select("session_id").distinct().join(pooled.select("session_id", att.alias("att"), "last"), "session_id", "left").select("session_id", F.coalesce("att", zeros(width)).alias("att"), F.coalesce("last", zeros(width)).alias("last"))


def recency_blend(readout: DataFrame, gate: float | tuple[list[float], float] | None) -> DataFrame:
    """(session_id, emb): gate * att + (1 - gate) * last; a pair (weights over [att, last], bias) gives a
    gate by row, None the attention alone."""
    if gate is None:
        return readout.select("session_id", F.col("att").alias("emb"))
    if isinstance(gate, tuple):
        weights = F.array(*[F.lit(float(w)) for w in gate[0]])
        g = 1 / (1 + F.exp(-(dot(F.concat("att", "last"), weights) + gate[1])))
    else:
        g = F.lit(float(gate))
    return readout.select("session_id", add(scale(F.col("att"), g), scale(F.col("last"), 1 - g)).alias("emb"))


def seeded_matrix(rows: int, columns: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 1 / np.sqrt(max(rows, 1)), (rows, columns))


def project_nodes(nodes: DataFrame, weights: dict[str, np.ndarray], bias: dict[str, np.ndarray] | None = None, lookups: dict[str, dict[int, np.ndarray]] | None = None) -> DataFrame:
    """(node_type, idx, emb): ReLU of features times the type's matrix plus its bias; missing features count as zeros.

    ``lookups`` names features (by place, from 0) of a type that are codes: each code stands for its row of
    the feature's table, codes beyond it for its last row, missing ones for its first.  A matrix has a
    row for each plain feature, then one for each column of each table, in the order of places.
    """
    out = None
    for kind, values in weights.items():
        tables = (lookups or {}).get(kind, {})
        part = nodes.where(F.col("node_type") == kind)
        at = lambda i: F.coalesce(F.try_element_at("features", F.lit(i + 1)), F.lit(0.0))
        n_plain = len(values) - sum(np.asarray(t).shape[1] for t in tables.values())
        plain = [i for i in range(n_plain + len(tables)) if i not in tables]
        coded = [F.element_at(matrix(t), (F.greatest(F.least(at(i).cast("int"), F.lit(len(t) - 1)), F.lit(0)) + 1)) for i, t in sorted(tables.items())]
        x = F.concat(F.array(*[F.nanvl(at(i), F.lit(0.0)) for i in plain]), *coded)
        shift = F.array(*[F.lit(float(v)) for v in np.broadcast_to((bias or {}).get(kind, 0.0), np.asarray(values).shape[1])])
        rows = turn(part.select("node_type", "idx", x.alias("emb")), "emb", np.asarray(values)).select("node_type", "idx", relu(add(F.col("emb"), shift)).alias("emb"))
        out = rows if out is None else out.unionByName(rows)
    return out


def gather_pairs(pairs: DataFrame, vectors: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Join vectors (idx, emb) to pairs: name -> (vectors, index column of the pairs)."""
    for name, (table, index) in vectors.items():
        pairs = pairs.join(table.select(F.col("idx").alias(index), F.col("emb").alias(name)), index)
    return pairs


def align_pairs(pairs: DataFrame, query: str, key: str, values: list[str], width: int, heads: int, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Add pair_vector: values weighed head by head, softmax of the heads' scaled dot products, concatenated.

    ``weights`` turns the vectors of the columns that it names first; the columns themselves stay.
    """
    used = {c: f"__{c}" for c in dict.fromkeys([query, key, *values])}
    for c, new in used.items():
        pairs = turn(pairs, c, (weights or {}).get(c), new)
    query, key, values = used[query], used[key], [used[v] for v in values]
    size = width // heads
    head = lambda c, h: F.slice(c, h * size + 1, size)
    scores = F.array(*[dot(head(query, h), head(key, h)) / F.lit(float(np.sqrt(size))) for h in range(heads)])
    out = pairs.withColumn("__scores", scores).withColumn("__top", F.array_max("__scores")).withColumn("__e", F.transform("__scores", lambda s: F.exp(s - F.col("__top"))))
    out = out.withColumn("__all", F.aggregate("__e", F.lit(0.0), lambda s, v: s + v))
    weighed = [scale(head(v, h), F.element_at("__e", h + 1) / F.col("__all")) for v in values for h in range(heads)]
    return out.withColumn("pair_vector", F.concat(*weighed)).drop("__scores", "__top", "__e", "__all", *used.values())


def concat_pairs(pairs: DataFrame, parts: list[str]) -> DataFrame:
    return pairs.withColumn("pair_vector", F.concat(*parts))


def path_counts(log: DataFrame, authors: DataFrame, tags: DataFrame, time: str = "time_ms", key: str = "row_key") -> DataFrame:
    """(row_key, same_author, same_category): the user's earlier clicks that share the row's author, or a category.

    ``authors`` (video_id, author_id), ``tags`` (video_id, tag).  A click counts once for each shared
    category.  Earlier means before in (time, key).  Clicks are counted by one scan in the order of user, author
    (category) and time, so neither a user nor one of its authors is one task.
    """
    clicked = F.coalesce(F.col("is_click").cast("long"), F.lit(0))

    base = log.select(key, "user_id", "video_id", time, clicked.alias("__clicked"))
    shared = authors.where("author_id is not null").select("video_id", F.lit(0).alias("__kind"), F.col("author_id").cast("long").alias("__by"))
    shared = shared.unionByName(tags.distinct().select("video_id", F.lit(1).alias("__kind"), F.col("tag").cast("long").alias("__by")))
    seen = running(base.join(shared, "video_id").drop("video_id"), Running(("user_id", "__kind", "__by"), (time, key), sums={"__clicked": "__seen"}))
    of = lambda kind, name: F.sum(F.when(F.col("__kind") == kind, F.col("__seen") - F.col("__clicked")).otherwise(0)).alias(name)
    counts = seen.groupBy(key).agg(of(0, "same_author"), of(1, "same_category"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return base.select(key).join(counts, key, "left").select(key, zero("same_author"), zero("same_category"))


def history_pool(rows: DataFrame, vectors: DataFrame, key: str, hist: str, target: str, width: int) -> DataFrame:
    """(key, pooled): history vectors weighed by their dot product with the target's, not normalised.

    A row for each of ``rows``, zeros where nothing has a vector.  Blocks of whole lists are numbered and written once.
    """
    listed = rows.select(F.col(key).alias("key"), F.col(target).alias("item"), F.col(hist).alias("hist")).withColumn("hist", F.coalesce("hist", F.array().cast(rows.schema[hist].dataType)))
    listed = listed.withColumn("size", F.size("hist"))
    schema = StructType([*listed.schema.fields, StructField("block", LongType()), StructField("at", IntegerType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, places, row = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            upto = places + np.cumsum(batch.column("size").to_numpy() + 1)
            at = row + np.arange(batch.num_rows, dtype="i4")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((part << 32) + upto // BLOCK), pa.array(at)], schema.names)
            places, row = int(upto[-1]) if len(upto) else places, row + batch.num_rows

    blocks = written(listed.mapInArrow(number, schema), "lists")
    return pooled_blocks(blocks, vectors, width).select(F.col("key").alias(key), "pooled")


def history_pool_of_log(log: DataFrame, vectors: DataFrame, width: int, most: int = 50, item: str = "video_id", user: str = "user_id", time: str = "time_ms", key: str = "row_key", digits: int | None = None) -> DataFrame:
    """``history_pool`` of each row's item and the user's up to ``most`` rows before; users' first rows are dropped.

    The lists are never built: rows lie in blocks in the order of user and time, and a block's rows tell them.
    ``digits``: round to so many.
    """
    rows = log.select(F.col(key).alias("key"), F.col(item).alias("item"), user, time)
    rows = running(rows, Running((user,), (time, "key"), back={"item": ("hist", most)}, blocks=("block", BLOCK)))
    rows = rows.select("key", "item", "hist", F.col("hist_size").alias("size"), "block", F.col("block_at").alias("at"))
    return pooled_blocks(rows, vectors, width, digits).where("size > 0").select(F.col("key").alias(key), "pooled")


def pooled_blocks(rows: DataFrame, vectors: DataFrame, width: int, digits: int | None = None) -> DataFrame:
    """(key, size, pooled) of ``rows`` (key, item, hist, size, block, at), which should be read from files.

    The places of a block are, in the order of ``at``, each row's ``hist`` and then its ``item``; a row's list is the
    ``size`` places before its item.  A block meets each vector that it names once, however many lists that is in.
    Null components count as 0, vectors of one idx are added up (as a join of components would).
    """
    named = rows.select(F.col("block").alias("met_in"), F.explode(F.concat(F.array("item"), "hist")).alias("idx")).where("idx is not null").distinct()
    met = named.join(vectors.where("emb is not null").select("idx", "emb"), "idx")
    schema = StructType([rows.schema["key"], rows.schema["size"], StructField("pooled", ArrayType(DoubleType()))])

    def pool(block: pa.Table, found: pa.Table) -> pa.Table:
        block = block.take(np.argsort(block["at"].to_numpy())).combine_chunks()
        known = found["idx"].unique().cast(block.schema.field("item").type) if found.num_rows else pa.array([], block.schema.field("item").type)
        code = lambda c: pc.fill_null(pc.index_in(c, known, skip_nulls=True), -1).to_numpy().astype("i8")
        table = np.zeros((len(known) + 1, width))  # the last row: items without a vector
        if found.num_rows:
            codes = code(found["idx"].cast(known.type))
            order = np.argsort(codes, kind="stable")
            values = pc.fill_null(found["emb"].combine_chunks().flatten().cast(pa.float64()), 0).to_numpy().reshape(-1, width)
            table[:-1] = np.add.reduceat(values[order], np.searchsorted(codes[order], np.arange(len(known))))
        hist, item, size = block["hist"].combine_chunks(), block["item"], block["size"].to_numpy()
        given = pc.list_value_length(hist).to_numpy()
        ends = np.cumsum(given) + np.arange(len(size))
        places = np.full(len(size) + int(given.sum()), -1)
        places[ends] = targets = code(item)
        own = np.ones(len(places), bool)
        own[ends] = False
        places[own] = code(hist.flatten())
        pooled = _windows(table, places, ends - size, ends, targets)
        return pa.table([block["key"], block["size"], column(pooled if digits is None else rounded(pooled, digits))], names=schema.names)

    return rows.groupBy("block").cogroup(met.groupBy("met_in")).applyInArrow(pool, schema)


def _windows(table: np.ndarray, places: np.ndarray, start: np.ndarray, end: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """For each row the vectors of places[start:end], weighed by their dot product with the target's, and added up.

    ``places`` and ``targets`` point into ``table``, whose last row (-1) stands for none.  Neither start nor end falls.
    """
    out = np.zeros((len(targets), table.shape[1]))
    finite = np.isfinite(table).all()
    first = 0
    while first < len(targets):
        last = max(first + 1, int(np.searchsorted(end, start[first] + SPAN, "right"))) if finite else first + 1
        low, high = start[first], end[last - 1]
        near, at = places[low:high], np.arange(low, high)
        if finite:
            vectors = table[near]
            weights = table[targets[first:last]] @ vectors.T
            weights[(at < start[first:last, None]) | (at >= end[first:last, None])] = 0
            out[first:last] = weights @ vectors
        elif targets[first] >= 0:  # 0 times infinity is no 0: only what is in the list
            vectors = table[near[near >= 0]]
            out[first] = (vectors @ table[targets[first]]) @ vectors
        first = last
    return out
