"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

Encoding is the costly part and words repeat, so every distinct pre-token is encoded once:
1. Documents are read once, in chunks.  A chunk's pre-tokens, exploded with their positions,
   become numbers of its distinct words; both are written, bucketed by chunk (``positions``).
2. A chunk's distinct words go to the buckets of their hashes.  A bucket meets the same word from
   many chunks, encodes it once, and answers every chunk with the ids of its words.
3. Chunks join their answers, which alone move, and put their documents together again position
   by position.  Decoding looks the ids up in the token-byte table of the rank file, broadcast: the
   vocabulary bounds it.
A frequent word costs one entry a chunk, so no word is hot.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.chunks import Index, pieces, squeezed, widened
from tributary.llm.common import materialise_bucketed, small_batches
from tributary.llm.tokens import rank_encoding, rank_table


@dataclass(frozen=True)
class BpeParams:
    vocabulary: str = field(default_factory=lambda: public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pattern: str = public_tokenizers.PATTERN
    chunk_bytes: int = 8_000_000
    bucket_bytes: int = 8_000_000
    least_bucket: int = 250_000


@cache
def splitter(pattern: str) -> regex.Pattern:
    """The pre-token pattern; white space, letters and numbers are Unicode's."""
    return regex.compile(pattern)


#: public_tokenizers.PATTERN in the classes of the standard module, which is twice as fast.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@cache
def _unlike() -> re.Pattern:
    """A character whose class differs between the two modules, or that lies beyond Latin letters."""
    latin = [chr(c) for c in range(0x250)]
    kinds = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
    odd = {c for c in latin for a, b in kinds if bool(regex.match(a, c)) != bool(re.match(b, c))}
    return re.compile("[" + "".join(map(re.escape, sorted(odd))) + "]|[^\x00-\u024f]")


def pre_tokens(text: str, pattern: str) -> list[str]:
    """Matches of the pattern in a text."""
    if pattern == public_tokenizers.PATTERN and not _unlike().search(text):
        return _PLAIN.findall(text)
    return splitter(pattern).findall(text)


def asked(keys: list, texts: list[bytes], pattern: str, buckets: int) -> dict:
    """A chunk's documents as positions, and its distinct words by bucket.

    Words are numbered from the most frequent on, so that positions are small numbers; a bucket has
    its words in that order.
    """
    index = Index()
    found = []
    for text in texts:
        words = pre_tokens(text.decode(), pattern)
        found.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
    position = np.concatenate(found)
    order = np.argsort(-np.bincount(position, minlength=len(index)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    raw = [w.encode() for w in index]
    raw = [raw[i] for i in order.tolist()]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
    by = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[by], return_index=True)
    z = zstandard.ZstdCompressor(level=3)
    words = [[raw[i] for i in part.tolist()] for part in (np.split(by, starts[1:]) if len(by) else [])]
    return {
        "ids": [k or 0 for k in keys], "nulls": [k is None for k in keys], "sizes": squeezed(np.fromiter(map(len, found), np.int64, len(found))), "positions": squeezed(rank[position]), "bucket_of": squeezed(bucket),
        "buckets": names.tolist(), "words": [z.compress(b"".join(w)) for w in words], "lengths": [squeezed(np.fromiter(map(len, w), np.int64, len(w))) for w in words],
    }


ASKED = "chunk long, ids array<long>, nulls array<boolean>, sizes binary, positions binary, bucket_of binary, buckets array<int>, words array<binary>, lengths array<binary>"


def answered(words: bytes, lengths: bytes, known: dict[bytes, list[int]], encode) -> tuple[bytes, bytes]:
    """How many ids each word has, and all ids in turn; a word met before is not encoded again."""
    body, ends = zstandard.ZstdDecompressor().decompress(words), np.cumsum(widened(lengths).astype(np.int64)).tolist()
    sizes, ids, start = [], [], 0
    for end in ends:
        word = body[start:end]
        if (found := known.get(word)) is None:
            found = known[word] = encode(word.decode())
        sizes.append(len(found))
        ids += found
        start = end
    return squeezed(np.array(sizes)), squeezed(np.array(ids))


@dataclass(frozen=True)
class Assembled:
    """A chunk's documents put together again: ids by word, and the words of every document."""

    flat: np.ndarray  # ids of all words in turn
    starts: list[int]  # where each word's ids begin in them
    positions: np.ndarray
    ends: list[int]  # of each document in the positions

    @classmethod
    def of(cls, row: dict) -> Assembled:
        told = sorted(row["told"] or [], key=lambda x: x["bucket"])
        sizes = np.concatenate([np.empty(0, np.int64), *(widened(x["counts"]).astype(np.int64) for x in told)])
        flat = np.concatenate([np.empty(0, np.int64), *(widened(x["answers"]).astype(np.int64) for x in told)])
        by = np.argsort(widened(row["bucket_of"]), kind="stable")  # answers lie by bucket, positions by frequency
        begin = np.cumsum(sizes) - sizes
        own, first = np.empty_like(sizes), np.empty_like(sizes)
        own[by], first[by] = sizes, begin
        moved = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(len(flat))
        return cls(flat[moved], [0, *np.cumsum(own).tolist()], widened(row["positions"]), np.cumsum(widened(row["sizes"]).astype(np.int64)).tolist())

    def by_word(self, pieces_of: list, join) -> list:
        """join(pieces of a word's ids), word by word."""
        of = list(map(pieces_of.__getitem__, self.flat.tolist()))
        return [join(of[a:b]) for a, b in pairwise(self.starts)]

    def documents(self, by_word: list, join) -> Iterator:
        """join(what its words have), document by document."""
        start = 0
        for end in self.ends:
            yield join(map(by_word.__getitem__, self.positions[start:end].tolist()))
            start = end


def encode_documents(documents: DataFrame, params: BpeParams | None = None, output: str = "ids") -> DataFrame:
    """One row per input row, in no order: doc_id with what ``output`` names.

    ``ids``: ids (array<int>) and decoded (binary, the ids joined with the token-byte table).
    ``digests``: n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256.
    Null text is empty text: no ids.  Null and repeated ids keep their rows.  No special token is
    recognised.  What the pattern skips has no ids and is not decoded.  Very long texts take a chunk of
    their own.  Extra columns are ignored; an empty table gives no row.
    """
    params = params or BpeParams()
    spark = documents.sparkSession
    source = small_batches(documents).select(F.col("doc_id").cast("long"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = max(1, min(spark.sparkContext.defaultParallelism, -(-size // params.least_bucket)))
    buckets, n_chunks = (max(-(-size // b), least) for b in (params.bucket_bytes, params.chunk_bytes))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("nulls", pa.list_(pa.bool_())), *((n, pa.binary()) for n in ("sizes", "positions", "bucket_of")), ("buckets", pa.list_(pa.int32())), ("words", pa.list_(pa.binary())), ("lengths", pa.list_(pa.binary()))])
        for k, keys, texts in pieces(batches, params.chunk_bytes):
            yield pa.RecordBatch.from_pylist([{"chunk": (task << 32) + k} | asked(keys, texts, params.pattern, buckets)], schema)

    whole = materialise_bucketed(source.mapInArrow(ask, ASKED), "positions", "chunk", n_chunks)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, held = rank_encoding(params.vocabulary).encode_ordinary, {}, None
        for batch in batches:
            out = []
            for bucket, chunk, words, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != held:  # rows come sorted by bucket
                    held, known = bucket, {}
                out.append((chunk, bucket, *answered(words, lengths, known, encode)))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["chunk", "bucket", "counts", "answers"])

    each = whole.select("chunk", F.explode(F.arrays_zip(F.col("buckets").alias("bucket"), "words", "lengths")).alias("x")).select("x.bucket", "chunk", "x.words", "x.lengths")
    answers = each.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "chunk long, bucket int, counts binary, answers binary")
    told = answers.repartition(n_chunks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "answers")).alias("told"))  # a chunk's words bound it
    table = spark.sparkContext.broadcast(token_table(params.vocabulary))  # as large as the vocabulary

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = table.value
        token_text = [str(i) for i in range(len(token_bytes))]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                done = Assembled.of(row)
                keys = pa.array([None if n else i for i, n in zip(row["ids"], row["nulls"], strict=True)], pa.int64())
                decoded = done.documents(done.by_word(token_bytes, b"".join), b"".join)
                if output == "ids":
                    ids = done.documents(done.by_word(range(len(token_bytes)), list), lambda x: list(chain.from_iterable(x)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(list(ids), pa.list_(pa.int32())), pa.array(list(decoded), pa.binary())], ["doc_id", "ids", "decoded"])
                    continue
                lines = list(done.documents(done.by_word(token_text, " ".join), " ".join))
                counts = [x.count(" ") + 1 if x else 0 for x in lines]
                shas = [hashlib.sha256(x.encode()).hexdigest() for x in lines], [hashlib.sha256(x).hexdigest() for x in decoded]
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), *map(pa.array, shas)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    joined = whole.select("chunk", "ids", "nulls", "sizes", "positions", "bucket_of").hint("merge").join(told, "chunk", "left")
    return joined.mapInArrow(assemble, SCHEMAS[output])


SCHEMAS = {"ids": "doc_id long, ids array<int>, decoded binary", "digests": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"}


def token_table(path: str) -> list[bytes]:
    """The token-byte table: bytes by id."""
    ranks = rank_table(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out
