"""Merkle manifest of a table: a tree of leaves for each source, one tree over the sources.

Witnesses grow as leaves are appended.  A leaf is appended to the open run of its level and
holds a reference to that run: the siblings before it at once, each later one as it comes.  A
full run closes, is appended to the open run one level up, and from then on extends the
witness of everything below it.  Tasks do this for aligned blocks of 256 nodes; the root of a
block is a further append, one row, to the blocks above, until a tree has one node.  What a
block's root was told about its siblings then goes down again, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import id_remainder, materialise, release, small_batches

#: Children of a node, fixed.
FAN = 16
#: Nodes of a block: two levels of runs.
BLOCK = FAN * FAN
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MEMBER = "rank long, digest binary, other binary, id long"
_BLOCKS = f"tree string, block long, n long, members array<struct<{_MEMBER}>>, root binary"


@dataclass
class Run:
    """Hex digests of up to 16 siblings, and its own place in the run above once it is closed."""

    nodes: list[bytes]
    above: Run | None = None
    place: int = 0

    def closed(self) -> bytes:
        return sha256(b"".join(self.nodes)).hexdigest().encode()


class Appender:
    """A tree of ``levels`` levels that is filled from the left."""

    def __init__(self, levels: int):
        self.open = [Run([]) for _ in range(levels)]
        self.root = b""

    def append(self, digest: bytes, level: int = 0) -> tuple[Run | None, int]:
        """Place of a node: its run, which later siblings extend, and its number there."""
        if level == len(self.open):
            self.root = digest
            return None, 0
        run = self.open[level]
        run.nodes.append(digest)
        place = len(run.nodes) - 1
        if len(run.nodes) == FAN:
            self._close(level)
        return run, place

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], Run([])
        run.above, run.place = self.append(run.closed(), level + 1)

    def finish(self) -> bytes:
        """Close what is open, from below; the root."""
        for level, run in enumerate(self.open):
            if run.nodes:
                self._close(level)
        return self.root


def witness(run: Run | None, place: int) -> list[tuple[bytes, bytes]]:
    """Siblings to the left and to the right of a node, level by level."""
    out = []
    while run is not None:
        out.append((b"".join(run.nodes[:place]), b"".join(run.nodes[place + 1 :])))
        run, place = run.above, run.place
    return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its witness lead to."""
    for left, right in path:
        digest = sha256(left + digest + right).hexdigest().encode()
    return digest


def packed(path: list[tuple[bytes, bytes]]) -> bytes:
    """A witness as bytes: for each level the numbers of siblings on both sides, then their digests."""
    return b"".join(bytes((len(a) // 64, len(b) // 64)) + bytes.fromhex((a + b).decode()) for a, b in path)


def unpacked(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(data):
        left, right = data[at], data[at + 1]
        text = data[at + 2 : (at := at + 2 + 32 * (left + right))].hex().encode()
        out.append((text[: 64 * left], text[64 * left :]))
    return out


def _levels(n: int) -> int:
    """Levels that a block adds to a tree that still has ``n`` nodes."""
    return 0 if n == 1 else 1 if n <= FAN else 2


def _leaf(text: Column) -> Column:
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    values = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")]
    return F.unhex(F.sha2(F.concat(*map(field, [*values, text])).cast("binary"), 256))


def leaves(documents: DataFrame, tampered: Column) -> DataFrame:
    """(tree, id, digest, other): a row's leaf, and where ``tampered`` the leaf of its text with A-Z in lower case.

    A tree is a source: empty for null, else the source behind a sign, which keeps the order of bytes.
    """
    text = F.col("text")
    return documents.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("tree"),
        F.col("doc_id").cast("long").alias("id"), _leaf(text).alias("digest"), F.when(tampered, _leaf(F.translate(text, UPPER, LOWER))).alias("other"),
    )


def _ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Written rows, and the same with rank (from 0 within the tree) and n (the tree's rows).

    Rows lie sorted in range partitions, however large a tree is: a rank is the place in the file, moved by
    one number a tree and partition.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = materialise(dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "leaves")
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    runs = dealt.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    runs = runs.select("tree", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    ranked = dealt.join(runs, ["tree", "part"]).withColumn("rank", F.col("place") + F.col("shift"))
    return dealt, ranked.drop("part", "place", "shift")


def _sealed(nodes: DataFrame) -> DataFrame:
    """Aligned blocks of nodes (tree, rank, n, digest, other, id) with their roots."""
    member = F.struct(*[F.col(c.split()[0]) for c in _MEMBER.split(", ")])
    blocks = nodes.groupBy("tree", F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(member)).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for n, members in zip(batch.column("n").to_pylist(), _digests(batch), strict=True):
                tree = Appender(_levels(n))
                for digest in members:
                    tree.append(digest)
                roots.append(bytes.fromhex(tree.finish().decode()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "root"])

    return small_batches(blocks).mapInArrow(run, _BLOCKS)


def _digests(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """Hex digests of each block's members."""
    lists = batch.column("members")
    digests, ends = lists.flatten().field("digest").to_pylist(), lists.offsets.to_pylist()
    for a, b in zip(ends, ends[1:], strict=False):
        yield [d.hex().encode() for d in digests[a - ends[0] : b - ends[0]]]


def _grown(nodes: DataFrame) -> list[DataFrame]:
    """Written blocks of each stage: the roots of blocks are the next one's nodes, where a tree has several."""
    stages = []
    while not stages or not nodes.isEmpty():
        stages.append(materialise(_sealed(nodes), "blocks"))
        more = stages[-1].where(F.col("n") > BLOCK)
        nodes = more.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("other"), F.lit(None).cast("long").alias("id"))
    return stages


def _roots(stages: list[DataFrame]) -> DataFrame:
    """(tree, digest): roots of all trees."""
    return reduce(DataFrame.unionByName, [s.where(F.col("n") <= BLOCK).select("tree", F.col("root").alias("digest")) for s in stages])


def _told(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first stage's blocks with subroot and ``above``, the witness of their roots.

    ``tops`` (tree, subroot, above) says what is above each tree.
    """
    told = None
    for blocks in reversed(stages):
        whole = blocks.where(F.col("n") <= BLOCK).select("tree", "block").join(tops, "tree")
        told = whole if told is None else whole.unionByName(_members(told))
        told = blocks.join(told, ["tree", "block"])
    return told


def _rebuilt(batch: pa.RecordBatch) -> Iterator[list[list[tuple[bytes, bytes]]]]:
    """Witnesses of each block's members within the block."""
    for n, members in zip(batch.column("n").to_pylist(), _digests(batch), strict=True):
        tree = Appender(_levels(n))
        places = [tree.append(d) for d in members]
        tree.finish()
        yield [witness(*p) for p in places]


def _members(told: DataFrame) -> DataFrame:
    """(tree, block, subroot, above) of the members of blocks, which are the blocks of the stage below."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("subroot", pa.binary()), ("above", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("tree", "block", "subroot", "above")], _rebuilt(batch), strict=True)
            for tree, block, subroot, above, paths in rows:
                k = len(paths)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * k), pa.array(range(block * BLOCK, block * BLOCK + k), pa.int64()), pa.array([subroot] * k, pa.binary()), pa.array([packed(p) + above for p in paths], pa.binary())], schema=schema)

    return told.mapInArrow(run, "tree string, block long, subroot binary, above binary")


def _proved(told: DataFrame, root: bytes) -> DataFrame:
    """One row a leaf: hashed siblings, and the root that its leaf, or else its tampered leaf, leads to."""
    names = ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"]
    schema = pa.schema([(n, pa.int64() if n == "doc_id" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = (batch.column(c).to_pylist() for c in ("members", "subroot", "above"))
            for rows, subroot, above, paths in zip(*members, _rebuilt(batch), strict=True):
                upper, out = unpacked(above), []
                for row, path in zip(rows, paths, strict=True):
                    path += upper
                    leaf = row["digest"].hex()
                    proof = sha256(b"".join(x for pair in path for x in pair)).hexdigest()
                    out.append((row["id"], leaf, subroot.hex(), proof, fold((row["other"].hex() if row["other"] else leaf).encode(), path).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    proved = told.mapInArrow(run, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    whole = F.lit(root.hex())
    return proved.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))


def manifest(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row a row of ``documents``.

    A leaf is the hash of doc_id, source, lang, n_chars and text.  ``tampered`` marks the rows whose text is taken
    in lower case (A-Z) for folded_root; none by default.  Null fields have a mark of their own; null
    sources form one tree, before all others; null ids come first in theirs.  Rows that share an id follow
    the order of their leaves; equal rows are leaves of their own, each with its own proof.  One leaf is
    its source's subroot, one source's subroot the root; the proof of a leaf alone is the hash of nothing.
    Extra columns are ignored; an empty table gives no row.
    """
    spark, nothing = documents.sparkSession, {"other": F.lit(None).cast("binary"), "id": F.lit(None).cast("long")}
    hashed = materialise(leaves(documents, F.lit(False) if tampered is None else tampered), "hashed")  # texts are read once, not again for ranges
    dealt, ranked = _ranked(hashed, ["id", "digest", "other"])
    stages = _grown(ranked)
    release(hashed, dealt)
    _, top = _ranked(_roots(stages).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest").withColumns(nothing), ["name"])
    top_stages = _grown(top.drop("name"))
    root = next((bytes(r["digest"]) for r in _roots(top_stages).collect()), b"")  # one row, none of an empty table
    over = spark.range(1).select(F.lit("").alias("tree"), F.lit(root).alias("subroot"), F.lit(b"").alias("above"))
    members = _members(_told(top_stages, over)).select(F.col("block").alias("rank"), "above")
    tops = members.join(top.select("rank", F.col("name").alias("tree"), F.col("digest").alias("subroot")), "rank").drop("rank")
    return _proved(_told(stages, tops), root)


def tampered_fifth() -> Column:
    """Rows whose id's crc32 is divisible by 5; a null id is none of them."""
    return F.col("doc_id").isNotNull() & (id_remainder("doc_id", 5) == 0)
