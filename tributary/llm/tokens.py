"""Byte-level BPE tables from public tokenizer files, and encoders over them."""

from __future__ import annotations

import base64
import json
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken


def _byte_of_char() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE files: printable Latin-1 stays, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def json_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file; its merges rank as its ids do.

    Added tokens (special strings) are recognised in texts, as the file's own library does.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    to_byte = _byte_of_char()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@cache
def rank_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file."""
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_table(path), special_tokens={})


@cache
def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def ids_of(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text, special strings included, as little-endian unsigned 32-bit."""
    if not text:
        return np.empty(0, "<u4")
    return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
