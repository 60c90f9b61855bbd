"""Chunks of documents: the unit that asks buckets about its distinct words and gets answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


class Index(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def squeezed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Integers, compressed by planes of bytes."""
    v = np.ascontiguousarray(values, kind)
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes())


def widened(blob: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def rising(values: np.ndarray) -> bytes:
    """Sorted unsigned integers, as their differences."""
    return squeezed(np.diff(values.astype(np.uint64), prepend=np.uint64(0)), "<u8")


def risen(blob: bytes) -> np.ndarray:
    return np.cumsum(widened(blob, "<u8"), dtype=np.uint64)


def pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list, list[bytes]]]:
    """(number, keys, texts) of consecutive rows (key, text) with about ``limit`` bytes of text."""
    number, keys, texts, size = 0, [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text or b"")
            size += len(texts[-1]) + 16
            if size >= limit:
                yield number, keys, texts
                number, keys, texts, size = number + 1, [], [], 0
    if keys:
        yield number, keys, texts


def packed(parts: list[bytes]) -> bytes:
    """Byte strings in one: how many, their sizes, then all of them."""
    sizes = np.fromiter(map(len, parts), np.uint32, len(parts))
    return np.uint32(len(parts)).tobytes() + sizes.tobytes() + b"".join(parts)


def unpacked(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(blob, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends.tolist()]
    return [blob[a:b] for a, b in zip(starts, starts[1:], strict=False)]
