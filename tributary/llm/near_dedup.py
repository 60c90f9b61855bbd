"""MinHash near-duplicate detection: one-permutation hashing with optimal densification.

Plan:
1. Every whole text becomes its set of distinct word shingles (64-bit hashes), an exact
   class (md5 of the set: copies share it) and band keys of a one-permutation sketch.
2. A class is one node, however many rows it has.  Nodes of a bucket are linked to two
   hubs only, its least node and its least node hash: stars, as many edges as members.
3. Each distinct edge is confirmed on the full sets; confirmed links give components.
4. What stars cannot see is looked up exactly: members of buckets that still hold several
   components are paired across components by their rarest shingles, and confirmed too.
   A shingle with many members is looked at in pairs of bounded blocks.
5. Classes that one doc_id has are one component; its least doc_id names a component.

Sketch: the hashes are dealt into equal ranges, one bin each, and a bin keeps its least
hash.  An empty bin borrows from the first filled bin in a fixed random order of its own,
so all borrowing is independent between bins and equal between documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import Memo, materialise, release, small_batches, words_of
from tributary.llm.components import connected_components


@dataclass(frozen=True)
class DedupParams:
    """Links: 100 * intersection >= ``percent`` * union, over shingles of ``words`` words.

    ``bands`` bands of ``rows`` rows; a pair at the threshold stays unseen with probability
    (1 - (percent/100)^rows)^bands: 3e-6 for 85 % and 8 rows, 5e-6 for 80 % and 6 rows.  ``crowd``,
    ``block`` and ``hot_rows`` place work only: shingles with more members go in blocks, classes with
    more rows are named without a shuffle of those rows.
    """

    words: int = 3
    percent: int = 85
    bands: int = 40
    rows: int = 8
    crowd: int = 256
    block: int = 512
    hot_rows: int = 10_000


#: The near-duplicates of the pipeline: five words, similarity of 0.8 or more.
FIVE_WORDS = DedupParams(words=5, percent=80, rows=6)

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (two rounds of xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def shingle_set(text: bytes | None, words: int, memo: Memo) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words: the whole sequence as one; none: empty."""
    found = words_of(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = _mix(out ^ h[k : len(h) - n + 1 + k]) * _ODD[2]
    return np.unique(out)


@cache
def _orders(bins: int) -> np.ndarray:
    """For each bin the random order in which it looks for a filled one."""
    rng = np.random.default_rng(20170817)
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)


def band_keys(shingles: np.ndarray, params: DedupParams) -> np.ndarray:
    """Band keys (64-bit) of the densified sketch; empty for an empty set."""
    if not len(shingles):
        return np.empty(0, np.uint64)
    bins = params.bands * params.rows
    h = np.sort(_mix(shingles ^ _ODD[3]))
    at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    sketch, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    sketch[at[first]], full[at[first]] = h[first], True
    if len(first) < bins:
        empty = np.flatnonzero(~full)
        orders = _orders(bins)
        width = 16
        source = np.zeros(bins, np.int32)
        while len(empty):
            hit = full[orders[empty, :width]]
            ok = hit.any(1) if width < bins else np.ones(len(empty), bool)
            source[empty[ok]] = orders[empty[ok], hit[ok].argmax(1)]
            empty, width = empty[~ok], min(width * 8, bins)
        missing = np.flatnonzero(~full)
        sketch[missing] = sketch[source[missing]]
    key = np.zeros(params.bands, np.uint64)
    for k, column in enumerate(sketch.reshape(params.bands, params.rows).T):
        key = _mix(key ^ column) * _ODD[4] + np.uint64(k)
    return _mix(key ^ np.arange(params.bands, dtype=np.uint64))


def sketches(documents: DataFrame, params: DedupParams) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, class (16 bytes; null for an empty set), bands (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            sizes, classes, bands = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(text, params.words, memo)
                sizes.append(len(s))
                classes.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                bands.append(band_keys(s, params).view(np.int64))
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, bands)]).astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), lists], ["doc_id", "t", "n_shingles", "class", "bands"])

    return small_batches(documents).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text").mapInArrow(run, "doc_id long, t long, n_shingles long, class binary, bands array<long>")


def moved_texts(documents: DataFrame, wanted: DataFrame, filter_bytes: int = 1 << 25) -> DataFrame:
    """(node, z): the compressed text of each wanted (node, doc_id, t), one row a node.

    A Bloom filter goes to the scan first, so that few texts but the wanted are shuffled.  It has 16 bits
    or more a wanted row (about 2 % of the others pass) up to ``filter_bytes``; with more rows than
    that can tell apart it lets more through, never fewer.
    """
    words = 1 << min(max(17, (wanted.count() // 4).bit_length()), (filter_bytes // 8).bit_length() - 1)  # of 64 bits
    place = lambda salt: F.pmod(F.xxhash64("doc_id", "t", F.lit(salt)), F.lit(words * 64))
    bits = wanted.select(F.explode(F.array(place(1), place(2))).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))
    found = bits.toArrow()
    flags = np.zeros(words, np.int64)
    flags[found["word"].to_numpy()] = found["mask"].to_numpy()
    packed = flags.view(np.uint8)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            one, two = (batch.column(i).to_numpy() for i in (3, 4))
            kept = ((packed[one >> 3] >> (one & 7)) & (packed[two >> 3] >> (two & 7)) & 1).astype(bool)
            part = batch.filter(pa.array(kept))
            texts = [z.compress(t or b"") for t in part.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["doc_id", "t", "z"])

    texts = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text").where("doc_id is not null")
    marked = texts.select("doc_id", "t", "text", place(1).alias("p1"), place(2).alias("p2"))
    return marked.mapInArrow(squeeze, "doc_id long, t long, z binary").join(wanted.select("node", "doc_id", "t"), ["doc_id", "t"]).select("node", "z").dropDuplicates(["node"])


def confirmed(edges: DataFrame, texts: DataFrame, params: DedupParams) -> DataFrame:
    """The edges (a, b) whose full shingle sets are similar enough.

    Edges come sorted by ``a`` after the last join, so a hub's set is built once for a run of
    edges; a bounded number of other sets is remembered too.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, z = word_hashes(), zstandard.ZstdDecompressor()
        sets = Memo(lambda x: shingle_set(z.decompress(x), params.words, memo), 500)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = sets[x], sets[y]
                lesser, greater = sorted((len(s), len(t)))
                if 100 * lesser < params.percent * greater:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= params.percent * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return edges.join(texts.withColumnsRenamed({"node": "b", "z": "zb"}), "b").join(texts.withColumnsRenamed({"node": "a", "z": "za"}), "a").select("a", "b", "za", "zb").mapInArrow(verify, "a long, b long")


def prefix_pairs(nodes: DataFrame, texts: DataFrame, params: DedupParams) -> DataFrame:
    """Every pair (a, b) of nodes (node, c) with different c that can be similar enough, by prefixes.

    Similar sets share one of the rarest n - ceil(percent * n) + 1 shingles of either, rarity being
    counted over all the nodes; and from the first shared one on, enough must be left of both for
    the overlap that the threshold asks.  What one node alone has fills its prefix without meeting
    anything, and what a common passage gives stands last: pairs stay few where buckets are crowded.
    Shingles that one component alone has in its prefixes are left out; one with more than ``crowd``
    members is dealt into blocks by size, and each two blocks of close sizes meet in a task of their own.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, z = word_hashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            found = [shingle_set(z.decompress(t), params.words, memo).view(np.int64) for t in batch.column(2).to_pylist()]
            flat = pa.array(np.concatenate(found)) if found else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in found], pa.int64()), lists], ["node", "c", "n", "s"])

    has = nodes.join(texts, "node").select("node", "c", "z").mapInArrow(sets, "node long, c long, n long, s array<long>")
    whole = materialise(has, "sets")
    has = whole.select("node", "c", "n", F.explode("s").alias("s"))
    common = has.groupBy("s").agg(F.count("*").alias("df"))
    rare_first = Window.partitionBy("node").orderBy("df", "s")
    least = F.floor((F.col("n") * params.percent + 99) / 100)
    prefix = has.join(common, "s").withColumn("place", F.row_number().over(rare_first)).where((F.col("place") <= F.col("n") - least + 1) & (F.col("df") > 1))
    prefix = materialise(prefix.select("s", "node", "c", "n", "place"), "prefix")
    release(whole)
    members = prefix.groupBy("s").agg(F.count("*").alias("members"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("s", "members")
    members = materialise(members, "members")
    # shingles with a thousandth of all rows are at most a thousand: their rows need no shuffle
    frequent = max(params.crowd, (members.agg(F.sum("members")).first()[0] or 0) // 1000)
    hot = F.broadcast(members.where(F.col("members") > frequent))
    usual = prefix.join(hot.select("s"), "s", "left_anti").join(members.where(F.col("members") <= frequent), "s")
    prefix = prefix.join(hot, "s").unionByName(usual)

    def meet(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
        """Pairs of different components with equal keys that sizes and places do not rule out."""
        x, y = (df.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in ("node", "c", "n", "place")]) for df, side in ((rows, "x"), (others, "y")))
        sized = (F.col("n_x") * 100 >= F.col("n_y") * params.percent) & (F.col("n_y") * 100 >= F.col("n_x") * params.percent)
        left = 1 + F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
        enough = left * (100 + params.percent) >= (F.col("n_x") + F.col("n_y")) * params.percent
        return x.join(y, keys).where((F.col("c_x") != F.col("c_y")) & sized & enough).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()

    few = prefix.where(F.col("members") <= params.crowd)
    # sizes in classes a threshold's ratio wide: only members of one class or of two neighbouring ones can be similar
    size = F.floor(F.ln("n") / float(np.log(100 / params.percent))).cast("int") if params.percent < 100 else F.col("n").cast("int")
    many = prefix.where(F.col("members") > params.crowd).withColumn("blocks", F.ceil(F.col("members") / params.block).cast("int"))
    many = many.withColumns({"size": size, "own": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "other": F.explode(F.expr("sequence(0, blocks - 1)"))})
    each = many.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
    first = each.withColumns({"i": F.col("own"), "j": F.col("other")}).where("step = 1 or i <= j")
    second = each.withColumns({"i": F.col("other"), "j": F.col("own"), "size": F.col("size") - F.col("step")}).where("step = 1 or i <= j")
    return meet(few, few, ["s"]).unionByName(meet(first, second, ["s", "step", "size", "i", "j"])).distinct()


def near_duplicates(documents: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Null or empty texts and texts without words have no shingles and are linked with nothing.
    Repeated rows are copies like others; rows with one doc_id and several texts are linked by
    each row's own text, and their links are the doc_id's.  A null doc_id takes part in nothing:
    component_id null, kept.  Ties cannot matter: components and least ids are unique.  Very long
    texts are whole sets like others.  Extra columns are ignored; an empty table gives no row.
    """
    signed = materialise(sketches(documents, params), "sketches")
    real = signed.where("class is not null and doc_id is not null")
    classes = real.groupBy("class").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "class", "first.*", "n", "bands"), "classes")
    member = nodes.select("node", F.explode("bands").alias("key"))
    buckets = member.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("last"), F.min_by("node", F.xxhash64("node")).alias("other")).where("least < last")
    shared = materialise(member.join(buckets.select("key", "least", "other"), "key"), "buckets")
    stars = materialise(shared.select("node", F.explode(F.array("least", "other")).alias("hub")).where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    texts = materialise(moved_texts(documents, nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "t")), "texts")
    links = materialise(confirmed(stars, texts, params), "links")
    release(stars)
    found = connected_components(links)

    # what the stars left uncompared: members of different components in one bucket
    placed = shared.join(found.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    crowded = materialise(placed.join(mixed, "key").select("node", "c").distinct(), "crowded")
    pairs = materialise(prefix_pairs(crowded, texts, params), "pairs")
    more = confirmed(pairs, texts, params)
    named = _named_twice(real)
    if named is not None:
        a, b = (nodes.select(F.col("class").alias(f"class_{x}"), F.col("node").alias(x)) for x in "ab")
        more = more.unionByName(named.join(a, "class_a").join(b, "class_b").select("a", "b"))
    more = materialise(more, "links")
    release(shared, texts, crowded, pairs)
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))
    release(links, more)
    return _told(signed, nodes, found, params)


def _named_twice(real: DataFrame) -> DataFrame | None:
    """(class_a, class_b): classes of one doc_id, each with the least of them; one row however many ids share the two.

    None where every id has one text.  Rows of ids with one text go before anything is joined, and copies of a text before their class is.
    """
    twice = real.groupBy("doc_id").agg(F.min("class").alias("class_a"), F.max("class").alias("last")).where("class_a < last").select("doc_id", "class_a")
    twice = materialise(twice, "twice")
    if twice.isEmpty():
        return None
    return real.select("doc_id", "class").distinct().join(twice, "doc_id").where("class != class_a").select("class_a", F.col("class").alias("class_b")).distinct()


def _told(signed: DataFrame, nodes: DataFrame, found: DataFrame, params: DedupParams) -> DataFrame:
    """Every row with the least doc_id of its class's component.

    Rows without a class need no answer.  Classes with many rows are few (their number is bounded by
    the rows over ``hot_rows``, and that grows with the table): they are broadcast, and no task gets all
    rows of one class.
    """
    whole = nodes.select("class", "n", "doc_id", "node").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialise(whole.join(least, "component").select("class", "n", "component_id"), "named")
    hot_rows = max(params.hot_rows, (named.agg(F.sum("n")).first()[0] or 0) // params.hot_rows)
    hot = F.broadcast(named.where(F.col("n") > hot_rows).select("class", "component_id"))  # at most hot_rows rows
    own = signed.select("doc_id", "n_shingles", "class")
    real = own.where("class is not null and doc_id is not null")
    alone = own.where("class is null or doc_id is null").withColumn("component_id", F.col("doc_id"))
    many = real.join(hot, "class")
    rest = real.join(hot.select("class"), "class", "left_anti").join(named.where(F.col("n") <= hot_rows).select("class", "component_id"), "class")
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")]
    return alone.select(*columns).unionByName(many.select(*columns)).unionByName(rest.select(*columns))


def keep_one(documents: DataFrame, params: DedupParams = FIVE_WORDS) -> DataFrame:
    """Rows of ``documents`` (all columns) without all but the least id of each component.

    Of rows with one doc_id the least by text, then by the other columns in their order, stays; rows
    without a doc_id stay all.
    """
    gone = near_duplicates(documents, params).where("not kept").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in documents.columns]
    left = documents.join(gone, "doc_id", "left_anti").select(*columns)
    again = materialise(documents.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[F.col(f"`{c}`") for c in rest])).alias("row"))
    one = one.select("doc_id", *[F.col("row").getField(c).alias(c) for c in ("text", *rest)]).select(*columns)
    return left.join(again, "doc_id", "left_anti").select(*columns).unionByName(one)
