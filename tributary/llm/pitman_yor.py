"""Hierarchical Pitman-Yor language model, sampled by Gibbs over distributed restaurants.

Customers are training tokens.  A token sits in the restaurant of its context, the word before
it; every distinct word before has a restaurant of its own.  All of these share one parent, the
unigram restaurant, whose customers are the tables of its children and whose base is even over
the known words, with a share for all unknown ones together.

Seatings are kept as numbers of tables by (context, word), drawn from their exact conditional
through generalised Stirling numbers.  Given the parent's probabilities context restaurants are
independent, so each is swept where it lies; tables by word are then added up over all contexts,
the parent is seated anew, the strength of the contexts is drawn, and sweeps go on under both.
Predictive probabilities are averaged over the last sweeps.  A context that lies in several buckets is swept
like others: its buckets add up its tables after every sweep.  Every draw comes from the hashes of
its words and the number of the sweep, so no score depends on buckets, chunks or parallelism.

Where the work is:
1. A chunk of documents deals its tokens over buckets of contexts, in one pass over the input.
   A context with much of the corpus is dealt over several buckets by its following word.
2. A bucket counts its pairs once (``restaurants``, a table bucketed by bucket, so that later
   joins with it move the other side only).
3. Buckets ask the parts that own words for counts and for the parent's seating, before the first
   sweep and after the last one under the first seating.
4. Pairs of shared contexts with several customers are written apart (``shared``), and each sweep of them
   is a pass over that table; a sum a context comes back.
5. Buckets add up the scores of each document's tokens; a chunk's sums meet its ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.chunks import Index, packed, pieces, risen, rising, squeezed, unpacked, widened
from tributary.llm.common import materialise, materialise_bucketed, release, small_batches

#: The end of a text; also what stands before its first word.  No word can equal it.
END = b"\n"

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class PitmanYorParams:
    """``unknown`` is the share of the base that unknown words have together; discounts are estimated from
    counts of counts.  ``strength`` is that of the contexts during the burn-in; with ``sample_strength`` it is then
    drawn given the seating, from the values of ``strengths``, all as likely before.  ``burn_in`` sweeps are under the first seating of the parent,
    ``averaged`` ones under the second.  ``contexts`` above 0 folds the words before into so many
    restaurants.  A bucket holds about ``bucket_bytes`` of text, a chunk ``chunk_bytes``."""

    contexts: int = 0
    strength: float = 1.0
    sample_strength: bool = True
    root_strength: float = 1.0
    unknown: float = 0.5
    burn_in: int = 2
    averaged: int = 3
    exact: int = 256
    seed: int = 5
    chunk_bytes: int = 16_000_000
    bucket_bytes: int = 8_000_000
    least_bucket: int = 250_000
    fold: int = 10


def tokenised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct words, the word of every token, the tokens of every text."""
    index = Index({END: 0})
    get, found = index.__getitem__, []
    for text in texts:
        words = text.lower().split()
        words.append(END)
        found.append(np.fromiter(map(get, words), np.int32, len(words)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return hashes[order], place[np.concatenate(found)], np.fromiter(map(len, found), np.int64, len(found))


def buckets_of(context: np.ndarray, word: np.ndarray, buckets: int, hot: dict[int, int]) -> np.ndarray:
    """The bucket of every pair of hashes: that of its context, and of its word too where the context is hot."""
    parts = np.ones(len(context), np.uint64)
    if hot:
        names = np.sort(np.fromiter(hot, np.uint64, len(hot)))
        many = np.array([hot[int(x)] for x in names], np.uint64)
        at = np.minimum(np.searchsorted(names, context), len(names) - 1)
        parts = np.where(names[at] == context, many[at], parts)
    mixed = (context + word % parts * np.uint64(0xC2B2AE3D27D4EB4F)) * _ODD
    return ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


@cache
def _log_stirling(most: int, discount: float) -> np.ndarray:
    """log S(c, t) of generalised Stirling numbers: S(c+1, t) = S(c, t-1) + (c - discount t) S(c, t)."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[1, 1] = 0
    t = np.arange(most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore"):
            stay = table[c] + np.log(np.maximum(c - discount * t, 1e-300))
        table[c + 1, 1:] = np.logaddexp(stay[1:], table[c, :-1])
    return table


@cache
def _log_stirling_grid(least: int, steps: int, most_tables: int, discount: float) -> np.ndarray:
    """log S(c, t) up to ``most_tables`` for c = least 2^(k/4), k = 0 to ``steps``."""
    wanted = np.rint(least * 2.0 ** (np.arange(steps + 1) / 4)).astype(int).tolist()
    t, row, out = np.arange(most_tables + 1), np.full(most_tables + 1, -np.inf), []
    row[1] = 0
    for c in range(1, wanted[-1] + 1):  # ``row`` is that of c
        if c == wanted[len(out)]:
            out.append(row)
        stay = row + np.log(np.maximum(c - discount * t, 1e-300))
        row = np.append(-np.inf, np.logaddexp(stay[1:], row[:-1]))
    return np.array(out)


def large_tables(customers: np.ndarray, log_open: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of tables of many customers, where tables are many too.

    The weights S(c, t) a^t are those of a compound Poisson count of tables given that their sizes add up
    to c: sizes have the generating function f(z) = 1 - (1-z)^d and z solves a z (1-z)^(d-1) = c.
    """
    a = np.exp(log_open)
    low, high = np.zeros(len(a)), np.ones(len(a))  # bisect 1 - z on a log scale
    for _ in range(60):
        middle = (low + high) / 2
        rest = np.exp(-40 * middle)
        many = a * (1 - rest) * rest ** (discount - 1) > customers
        low, high = np.where(many, low, middle), np.where(many, middle, high)
    rest = np.exp(-40 * (low + high) / 2)
    z, f = 1 - rest, -np.expm1(discount * np.log(rest))
    first = z * discount * rest ** (discount - 1)
    second = first + z * z * discount * (1 - discount) * rest ** (discount - 2)
    mean = a / discount * f
    return mean, mean * np.maximum(1 - first * first / (f * second), 0)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers, finalised (rounds of xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(31))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def keys_of(context: np.ndarray | np.uint64, word: np.ndarray, sweep: int, seed: int) -> np.ndarray:
    """A key for each pair of hashes in a sweep: what all its draws come from."""
    with np.errstate(over="ignore"):
        start = np.uint64(seed) * np.uint64(0x165667B19E3779F9) + np.uint64(sweep + 1) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(mixed(word ^ start) + context * _ODD)


def uniform(keys: np.ndarray, number: int) -> np.ndarray:
    """The ``number``-th draw of each key, within (0, 1)."""
    return ((mixed(keys ^ np.uint64((number * 0xA0761D6478BD642F) % (1 << 64))) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _drawn(logs: np.ndarray, log_open: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Numbers t from 1 with weights exp(logs[t - 1] + log_open t), by draws from (0, 1)."""
    t = np.arange(1, len(logs) + 1)
    weight = logs + log_open[:, None] * t
    weight = np.exp(weight - weight.max(1, keepdims=True)).cumsum(1)
    return 1 + (weight < draw[:, None] * weight[:, -1:]).sum(1)


def draw_tables(customers: np.ndarray, log_open: np.ndarray, discount: float, params: PitmanYorParams, keys: np.ndarray | np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with ``customers``, each new table weighing exp(log_open), by a key each.

    Exact up to ``exact`` customers.  Beyond: where tables are few, by the exact weights of one of the two
    nearest sizes of a grid that ends at 64 times ``exact``; where they are many, a rounded normal with the
    mean and variance of ``large_tables``.
    """
    if isinstance(keys, np.random.Generator):
        keys = keys.integers(0, 1 << 64, len(customers), dtype=np.uint64)
    tables = np.minimum(customers, 1).astype(np.int64)
    logs = _log_stirling(params.exact, discount)
    order = np.argsort(customers, kind="stable")
    sizes, starts = np.unique(customers[order], return_index=True)
    for c, lo, hi in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        if 2 <= c <= params.exact:
            step = max(1, 2_000_000 // c)
            for s in range(lo, hi, step):
                rows = order[s : min(s + step, hi)]
                tables[rows] = _drawn(logs[c, 1 : c + 1], log_open[rows], uniform(keys[rows], 1))
    many = np.flatnonzero(customers > params.exact)
    if not len(many):
        return tables
    mean, variance = large_tables(customers[many].astype(float), log_open[many], discount)
    few = mean < params.exact / 4
    steps = 24
    place = np.minimum(np.log2(customers[many[few]] / params.exact) * 4, steps)
    place = np.floor(place + uniform(keys[many[few]], 2)).astype(int).clip(0, steps)
    for k in np.unique(place).tolist():
        rows = many[few][place == k]
        grid = _log_stirling_grid(params.exact, steps, 2 * params.exact, discount)
        for s in range(0, len(rows), 4000):
            part = rows[s : s + 4000]
            tables[part] = np.minimum(_drawn(grid[k, 1:], log_open[part], uniform(keys[part], 1)), customers[part])
    rows, mean, variance = many[~few], mean[~few], variance[~few]
    normal = np.sqrt(-2 * np.log(uniform(keys[rows], 1))) * np.cos(2 * np.pi * uniform(keys[rows], 2))
    tables[rows] = np.clip(np.rint(mean + np.sqrt(variance) * normal), 1, customers[rows])
    return tables


def strengths(discount: float) -> np.ndarray:
    """Strengths that the contexts may have: tenths of the discount below 0, and fourths of a power of ten above."""
    return np.concatenate([-discount * np.arange(0.9, 0.05, -0.1), 10.0 ** np.arange(-3, 3.1, 0.25)])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function, by Stirling's series from x + 8 on."""
    less = sum(np.log(x + k) for k in range(8))
    x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 - (1 / 30 - 1 / (105 * x * x)) / (x * x)) / (12 * x) - less


def strength_evidence(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """log probability of seatings by strength, but for what does not depend on it, for all of ``strengths``.

    A restaurant with c customers at t tables has (s + d)(s + 2d)...(s + (t-1)d) / ((s + 1)...(s + c-1)).
    """
    sat = customers > 0
    both, many = np.unique(np.stack([customers[sat], tables[sat]]).astype(np.int64), axis=1, return_counts=True)
    c, t = both[0].astype(float), both[1].astype(float)
    rising = lambda x, n: _log_gamma(x + n) - _log_gamma(np.float64(x))
    return np.array([(many * (rising(s / discount + 1, t - 1) - rising(s + 1, c - 1))).sum() for s in strengths(discount)])


def drawn_strength(evidence: np.ndarray, discount: float, seed: int) -> float:
    weight = np.exp(evidence - evidence.max()).cumsum()
    return float(strengths(discount)[int((weight < np.random.default_rng(seed).random() * weight[-1]).sum())])


@dataclass(frozen=True)
class Root:
    """Sums over the parent restaurant, and over the training."""

    customers: float
    tables: float
    words: int
    tokens: int
    discount: float
    root_discount: float
    strength: float = 1.0  # of the contexts

    def opening(self, params: PitmanYorParams) -> float:
        """The weight of a new table in the parent."""
        return params.root_strength + self.root_discount * self.tables

    def probability(self, customers: np.ndarray, tables: np.ndarray, known: np.ndarray, params: PitmanYorParams) -> np.ndarray:
        base = np.where(known, (1 - params.unknown) / max(self.words, 1), params.unknown)
        return (np.maximum(customers - self.root_discount * tables, 0) + self.opening(params) * base) / (params.root_strength + self.customers)


def swept(count: np.ndarray, taken: np.ndarray, parent: np.ndarray, context: np.ndarray, word: np.ndarray, number: int, root: Root, params: PitmanYorParams) -> np.ndarray:
    """Tables of pairs in sweep ``number``: by customers, tables of the context, the parent's probability, and hashes."""
    log_open = np.log((root.strength + root.discount * taken) * parent)
    return draw_tables(count, log_open, root.discount, params, keys_of(context, word, number, params.seed))


@dataclass
class Bucket:
    """Pairs of a bucket: word, context and training count; ``hot``: the contexts that other buckets share."""

    word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    contexts: int
    hot: np.ndarray  # places of the shared contexts
    hot_customers: np.ndarray  # in all buckets
    word_hash: np.ndarray
    context_hash: np.ndarray

    def customers(self) -> np.ndarray:
        out = np.bincount(self.context, self.count, self.contexts)
        out[self.hot] = self.hot_customers
        return out

    def taken(self, tables: np.ndarray, hot_tables: np.ndarray) -> np.ndarray:
        """Tables of each context, those of shared ones as told."""
        out = np.bincount(self.context, tables, self.contexts)
        out[self.hot] = hot_tables
        return out

    def sweep(self, tables: np.ndarray, parent: np.ndarray, hot_tables: np.ndarray, number: int, root: Root, params: PitmanYorParams) -> np.ndarray:
        """Seat every pair with more than one customer anew; ``hot_tables``: of shared contexts, after the last sweep."""
        rows = np.flatnonzero(self.count > 1)
        context, word = self.context[rows], self.word[rows]
        out = tables.copy()
        out[rows] = swept(self.count[rows], self.taken(tables, hot_tables)[context], parent[word], self.context_hash[context], self.word_hash[word], number, root, params)
        return out

    def burnt_in(self, parent: np.ndarray, hot_tables: list[np.ndarray], root: Root, params: PitmanYorParams) -> np.ndarray:
        """Tables after the sweeps under the first seating of the parent; first: one table a pair.

        ``hot_tables``: of the shared contexts, before each sweep.
        """
        tables = np.minimum(self.count, 1)
        for number in range(params.burn_in):
            tables = self.sweep(tables, parent, hot_tables[number], number, root, params)
        return tables

    def predictive(self, tables: np.ndarray, parent: np.ndarray, hot_tables: np.ndarray, root: Root) -> np.ndarray:
        """Probability of each pair's word after its context: seated customers, then the parent's share."""
        seats = (root.strength + self.customers())[self.context]
        own = np.maximum(self.count - root.discount * tables, 0)
        return (own + (root.strength + root.discount * self.taken(tables, hot_tables))[self.context] * parent[self.word]) / seats


def share(once: int, twice: int) -> float:
    """A discount from how many counts are one and two."""
    return float(np.clip(once / max(once + 2 * twice, 1), 0.05, 0.95))


def dealt(name: int, keys: list, texts: list[bytes], buckets: int, hot: dict[int, int], params: PitmanYorParams) -> Iterator[tuple]:
    """Rows of ASKED of a chunk: its documents, and its tokens by bucket."""
    hashes, word, sizes = tokenised(texts)
    held = np.fromiter((zlib.crc32(b"" if k is None else str(k).encode()) % params.fold == 0 for k in keys), np.uint64, len(keys))
    about = packed([squeezed(np.array([k or 0 for k in keys], np.int64), "<i8"), squeezed(np.array([k is None for k in keys], np.uint8), "<u1"), squeezed(sizes * 2 + held.astype(np.int64), "<u8")])
    yield (name % buckets, name, *[None] * 5, about)
    before = np.empty_like(word)  # the end stands before the first word, and is the last
    before[0], before[1:] = word[sizes[0] - 1], word[:-1]
    names = hashes % np.uint64(params.contexts) if params.contexts else hashes
    place = buckets_of(names[before], hashes[word], buckets, hot)
    order = np.argsort(place.astype(np.uint16) if buckets < 1 << 16 else place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(buckets + 1))
    document = np.repeat(np.arange(len(sizes)), sizes)
    for b in np.flatnonzero(np.diff(edges)).tolist():
        rows = order[edges[b] : edges[b + 1]]
        words, word_at = np.unique(word[rows], return_inverse=True)
        contexts, context_at = np.unique(names[before[rows]], return_inverse=True)
        each = np.bincount(document[rows], minlength=len(sizes)).astype(np.uint64) * np.uint64(2) + held
        yield (b, name, rising(hashes[words]), rising(contexts), squeezed(word_at), squeezed(context_at), squeezed(each), None)


ASKED = "bucket int, chunk long, words binary, contexts binary, word_at binary, context_at binary, each binary, about binary"
STATE = "bucket int, n_words long, n_contexts long, contexts binary, pairs binary, counts binary, once long, twice long, hot_at array<long>, hot array<long>, hot_customers array<long>, hot_types array<long>, parts array<int>, words array<binary>, word_counts array<binary>, word_types array<binary>, chunks array<long>, each array<binary>, pairs_of array<binary>, abouts array<struct<chunk: bigint, about: binary>>"


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> np.uint64(12)) % np.uint64(parts)).astype(np.int64)


def gathered(group: pd.DataFrame, parts: int, hot: dict[int, int]) -> dict:
    """The STATE of a bucket: its words by owning part, its counted pairs, and the pair of every token."""
    about, group = group[group["about"].notna()], group[group["about"].isna()]
    by_chunk = [risen(x) for x in group["words"]]
    words, word_place = np.unique(np.concatenate([np.empty(0, np.uint64), *by_chunk]), return_inverse=True)
    part = part_of(words, parts)
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words, part = words[order], part[order]
    met = [risen(x) for x in group["contexts"]]
    contexts, context_place = np.unique(np.concatenate([np.empty(0, np.uint64), *met]), return_inverse=True)
    keys, held, w0, c0 = [], [], 0, 0
    for row, w, c in zip(group.itertuples(), by_chunk, met, strict=True):
        local = rank[word_place[w0 : w0 + len(w)]][widened(row.word_at)]
        keys.append(context_place[c0 : c0 + len(c)][widened(row.context_at)] * len(words) + local)
        each = widened(row.each).astype(np.int64)
        held.append(np.repeat(each & 1, each >> 1).astype(bool))
        w0, c0 = w0 + len(w), c0 + len(c)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    pairs, at = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_inverse=True)
    count = np.bincount(at, ~np.concatenate([np.empty(0, bool), *held]), len(pairs)).astype(np.int64)
    context, word = np.divmod(pairs, max(len(words), 1))
    of_word, types = np.bincount(word, count, len(words)), np.bincount(word, np.minimum(count, 1), len(words))
    shared = np.flatnonzero(np.isin(contexts, np.fromiter(hot, np.uint64, len(hot))))
    names, starts = np.unique(part, return_index=True)
    cut = lambda x: np.split(x, starts[1:]) if len(starts) else []
    return {
        "n_words": len(words), "n_contexts": len(contexts), "contexts": rising(contexts), "pairs": rising(pairs), "counts": squeezed(count), "once": int((count == 1).sum()), "twice": int((count == 2).sum()),
        "hot_at": shared.tolist(), "hot": contexts[shared].view(np.int64).tolist(),
        "hot_customers": np.bincount(context, count, len(contexts))[shared].astype(int).tolist(), "hot_types": np.bincount(context, np.minimum(count, 1), len(contexts))[shared].astype(int).tolist(),
        "parts": names.tolist(), "words": [rising(x) for x in cut(words)], "word_counts": [squeezed(x) for x in cut(of_word)], "word_types": [squeezed(x) for x in cut(types)],
        "chunks": group["chunk"].tolist(), "each": group["each"].tolist(), "pairs_of": [squeezed(x) for x in np.split(at, cuts)] if keys else [],
        "abouts": [{"chunk": int(c), "about": a} for c, a in zip(about["chunk"], about["about"], strict=True)],
    }


TOLD = "bucket int, part int, at binary, counts binary, types binary, sums array<long>"
SEATED = "bucket int, part int, customers binary, tables binary, sums array<long>"


def counted_words(group: pd.DataFrame) -> pd.DataFrame:
    """What the words of a part have in all buckets, told to each bucket with their place in the part."""
    by_bucket = [risen(x) for x in group["words"]]
    words, at = np.unique(np.concatenate(by_bucket), return_inverse=True)
    count, types = (np.bincount(at, np.concatenate([widened(x) for x in group[c]]), len(words)).astype(np.int64) for c in ("counts", "types"))
    cuts = np.cumsum([len(x) for x in by_bucket])[:-1]
    sums = [(count > 0).sum(), count.sum(), types.sum(), (types == 1).sum(), (types == 2).sum(), (count == 1).sum()]
    rows = [(b, p, rising(x), squeezed(count[x]), squeezed(types[x]), None) for b, p, x in zip(group["bucket"], group["part"], np.split(at, cuts), strict=True)]
    return pd.DataFrame([*rows, (-1, group["part"].iloc[0], None, None, None, [int(x) for x in sums])], columns=["bucket", "part", "at", "counts", "types", "sums"])


def seated_words(group: pd.DataFrame, root: Root, params: PitmanYorParams) -> pd.DataFrame:
    """Seat the parent's customers of a part: the tables that each word has over all contexts."""
    by_bucket = [risen(x).astype(np.int64) for x in group["at"]]
    at = np.concatenate(by_bucket)
    salts = np.zeros(at.max() + 1, np.uint64)
    salts[at] = np.concatenate([widened(x) for x in group["salts"]])
    customers = np.bincount(at, np.concatenate([widened(x) for x in group["tables"]])).astype(np.int64)
    base = root.opening(params) * (1 - params.unknown) / max(root.words, 1)
    tables = draw_tables(customers, np.full(len(customers), np.log(base)), root.root_discount, params, keys_of(np.uint64(1), salts, -1, params.seed))
    rows = [(b, p, squeezed(customers[x]), squeezed(tables[x]), None) for b, p, x in zip(group["bucket"], group["part"], by_bucket, strict=True)]
    return pd.DataFrame([*rows, (-1, group["part"].iloc[0], None, None, [int(customers.sum()), int(tables.sum())])], columns=["bucket", "part", "customers", "tables", "sums"])


@dataclass
class Opened:
    """A bucket's row of the state with what it was told."""

    pairs: Bucket
    counts: np.ndarray  # of its words in the whole training
    types: np.ndarray
    asks: np.ndarray  # words whose seating can move
    at: list[np.ndarray]  # places in their parts
    parts: list[int]

    @classmethod
    def of(cls, row: dict, hot: dict[int, int]) -> Opened:
        """``hot``: customers of the shared contexts."""
        told = sorted(row["told"] or [], key=lambda x: x["part"])
        keys = risen(row["pairs"]).astype(np.int64)
        context, word = np.divmod(keys, max(row["n_words"], 1))
        hashes = np.concatenate([np.empty(0, np.uint64), *map(risen, row["words"])])
        pairs = Bucket(word, context, widened(row["counts"]).astype(np.int64), row["n_contexts"], np.array(row["hot_at"], np.int64), valued(row["hot"], hot), hashes, risen(row["contexts"]))
        join = lambda k: np.concatenate([np.empty(0, np.int64), *(widened(x[k]).astype(np.int64) for x in told)])
        counts = join("counts")
        return cls(pairs, counts, join("types"), counts > 1, [risen(x["at"]).astype(np.int64) for x in told], [x["part"] for x in told])

    def first_parent(self, root: Root, params: PitmanYorParams) -> np.ndarray:
        """Under one table a word."""
        return root.probability(self.types, np.minimum(self.types, 1), self.counts > 0, params)

    def shared(self, row: dict) -> tuple:
        """A row of SHARED: the pairs of shared contexts whose tables can move, and how many others there are."""
        b = self.pairs
        of = np.full(b.contexts, -1)
        of[b.hot] = np.arange(len(b.hot))
        of = of[b.context]
        moves = (of >= 0) & (b.count > 1)
        words, at = np.unique(b.word[moves], return_inverse=True)
        still = np.bincount(of[(of >= 0) & (b.count == 1)], minlength=len(b.hot))
        asked = np.cumsum(self.asks)[words] - 1
        return (row["bucket"], row["hot"], still.tolist(), squeezed(of[moves]), squeezed(b.count[moves]), squeezed(at), squeezed(b.word_hash[words], "<u8"), squeezed(self.types[words]), rising(asked))


SHARED = "bucket int, hot array<long>, still array<long>, of binary, count binary, word binary, hashes binary, types binary, asked binary"


def valued(names: list[int], values: dict[int, int]) -> np.ndarray:
    return np.array([values[x] for x in names], np.int64)


def seats_of(row: dict, what: str) -> np.ndarray:
    """``what`` (customers or tables in the parent) of the asked words of a bucket."""
    return np.concatenate([np.empty(0, np.int64), *(widened(x[what]).astype(np.int64) for x in sorted(row["seated"] or [], key=lambda x: x["part"]))])


def swept_shared(row: dict, before: dict[int, int], number: int, root: Root, params: PitmanYorParams) -> np.ndarray:
    """Tables of the shared contexts of a row of SHARED after sweep ``number``, in this bucket."""
    of, count, at, hashes = widened(row["of"]).astype(np.int64), widened(row["count"]).astype(np.int64), widened(row["word"]), widened(row["hashes"], "<u8")
    if number < params.burn_in:
        customers = widened(row["types"]).astype(np.int64)
        tables = np.minimum(customers, 1)
    else:
        asked = risen(row["asked"]).astype(np.int64)
        customers, tables = (seats_of(row, what)[asked] for what in ("customers", "tables"))
    parent = root.probability(customers, tables, np.ones(len(hashes), bool), params)
    context = np.array(row["hot"], np.int64).view(np.uint64)
    moved = swept(count, valued(row["hot"], before)[of], parent[at], context[of], hashes[at], number, root, params)
    return np.bincount(of, moved, len(context)).astype(np.int64) + np.array(row["still"], np.int64)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
PARTIAL = "chunk long, documents binary, base binary, score binary, known binary, about binary"
#: Sums travel as integers of this many parts of one.
_PARTS_OF_ONE = 1e8


def assembled(group: pd.DataFrame, tokens: int) -> pd.DataFrame:
    """Scores of a chunk's documents from the sums of its buckets."""
    about = group["about"][group["about"].notna()].iloc[0]
    keys, nulls, sizes = (widened(x, kind) for x, kind in zip(unpacked(about), ("<i8", "<u1", "<u8"), strict=True))
    held, sizes = (sizes & np.uint64(1)).astype(bool), (sizes >> np.uint64(1)).astype(np.int64)
    base, score, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for row in group[group["about"].isna()].itertuples():
        at = risen(row.documents).astype(np.int64)
        base[at] -= widened(row.base, "<u8").astype(np.int64)
        score[at] -= widened(row.score, "<u8").astype(np.int64)
        known[at] += widened(row.known).astype(np.int64)
    ids = pd.array(keys, "Int64")
    ids[nulls.astype(bool)] = pd.NA
    return pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": sizes, "n_known": known, "train_tokens": tokens, "base_score": base / _PARTS_OF_ONE, "score": score / _PARTS_OF_ONE, "perplexity": 10 ** (-score / _PARTS_OF_ONE / sizes)})


def hot_contexts(source: DataFrame, rows: int, buckets: int, params: PitmanYorParams) -> dict[int, int]:
    """Hashes of words with more than an eighth of a bucket's tokens, and over how many buckets to deal them.

    Looked up in a thousandth of the rows, 4000 at least.  There are at most 8 such words a bucket.
    Their tables are added up over their buckets after every sweep, so no score depends on which they are.
    """
    step = max(1, rows // max(4000, rows // 1000))
    part = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in pieces(batches, params.chunk_bytes):
            hashes, word, _ = tokenised(texts)
            names = hashes % np.uint64(params.contexts) if params.contexts else hashes
            n = np.bincount(word, minlength=len(names))
            some = np.flatnonzero(n * 64 * buckets >= len(word))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(names[some], np.uint64(0)).view(np.int64)), pa.array(np.append(n[some], 0)), pa.array(np.append(np.zeros(len(some), np.int64), len(word)))], ["word", "n", "all"])

    found = part.mapInArrow(count, "word long, n long, all long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    found = materialise(found, "frequent")
    total = found.agg(F.sum("all")).first()[0] or 0
    most = found.where(F.col("n") * 8 * buckets > total).collect()
    release(found)
    return {r["word"] % (1 << 64): -(-4 * buckets * r["n"] // total) for r in most if buckets > 1}


def score_documents(documents: DataFrame, params: PitmanYorParams = PitmanYorParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity: one row per input row.

    Tokens are the words, A-Z in lower case, and one end a text; null text is empty and has its end
    alone.  Words are told apart by 64-bit hashes.  Rows whose id's crc32 modulo ``fold`` is 0 are held
    out of the training (null id: crc32 of empty text, so held out).  ``base_score`` sums
    log10((c + 0.1) / (N + 0.1 (V + 1))), ``score`` the model's log10 probabilities, ``perplexity`` is by
    token.  Scores of training texts are those of seated customers.  Repeated rows are as many texts;
    ties cannot matter; extra columns are ignored.  An empty table gives no row.  Very long texts take
    a chunk of their own.
    """
    spark = documents.sparkSession
    source = small_batches(documents).select(F.col("doc_id").cast("long"), "text")
    facts = source.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    size = (facts["bytes"] or 0) + 2 * facts["n"]
    if not facts["n"]:
        return spark.createDataFrame([], SCORES)
    buckets = max(-(-size // params.bucket_bytes), min(spark.sparkContext.defaultParallelism, -(-size // params.least_bucket)))
    parts = max(1, buckets // 2)
    hot = hot_contexts(source, facts["n"], buckets, params)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
        task = TaskContext.get().partitionId()
        for k, keys, texts in pieces(batches, params.chunk_bytes):
            rows = list(dealt((task << 32) + k, keys, texts, buckets, hot, params))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in ASKED.split(", ")])

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"bucket": int(group["bucket"].iloc[0])} | gathered(group, parts, hot)])

    asked = source.mapInArrow(ask, ASKED).repartition(buckets, "bucket")
    state = materialise_bucketed(asked.groupBy("bucket").applyInPandas(gather, STATE), "restaurants", "bucket", buckets)

    words = state.select("bucket", F.explode(F.arrays_zip(F.col("parts").alias("part"), "words", F.col("word_counts").alias("counts"), F.col("word_types").alias("types"))).alias("x")).select("bucket", "x.*")
    told = materialise(words.repartition(parts, "part").groupBy("part").applyInPandas(counted_words, TOLD), "told")
    x = told.where("bucket < 0").select(*[F.sum(F.col("sums")[k]).alias(str(k)) for k in range(6)]).first()
    pairs = state.agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).first()
    root = Root(float(x["2"] or 0), float(x["0"] or 0), int(x["0"] or 0), int(x["1"] or 0), share(pairs["once"], pairs["twice"]), share(x["3"] or 0, x["4"] or 0))
    zipped = state.select(F.explode(F.arrays_zip("hot", "hot_customers", "hot_types")).alias("x")).groupBy("x.hot").agg(F.sum("x.hot_customers").alias("c"), F.sum("x.hot_types").alias("t"))
    met = zipped.collect()  # as many as ``hot`` has
    shared = {r["hot"]: r["c"] for r in met}
    totals = [{r["hot"]: r["t"] for r in met}]  # tables of the shared contexts, before the first sweep and after each

    def by_bucket(replies: DataFrame, name: str, *columns: str) -> DataFrame:
        """One row a bucket, dealt as the state is."""
        return replies.where("bucket >= 0").repartition(buckets, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("part", *columns)).alias(name))

    small = ["bucket", "n_words", "n_contexts", "contexts", "words", "pairs", "counts", "hot_at", "hot"]
    first = by_bucket(told, "told", "at", "counts", "types")
    apart = None
    if shared:

        def part_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 6)
            for row in rows_of(batches):
                out = Opened.of(row, shared).shared(row)
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(out, kinds, strict=True)], [x.split()[0] for x in SHARED.split(", ")])

        apart = materialise_bucketed(state.where("size(hot) > 0").select(*small).join(first, "bucket").mapInArrow(part_off, SHARED), "shared", "bucket", buckets)

    def swept_once(rows: DataFrame, number: int, root: Root) -> dict[int, int]:
        """Tables of the shared contexts after sweep ``number``, over all buckets."""
        before = totals[-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                yield pa.RecordBatch.from_arrays([pa.array(row["hot"], pa.int64()), pa.array(swept_shared(row, before, number, root, params))], ["hot", "t"])

        return {r["hot"]: r["t"] for r in rows.mapInArrow(run, "hot long, t long").groupBy("hot").agg(F.sum("t").alias("t")).collect()}

    if apart is not None:
        for number in range(params.burn_in):
            totals.append(swept_once(apart, number, root))
    burning = totals if shared else [{}] * (params.burn_in + 1)

    def burn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            o = Opened.of(row, shared)
            tables = o.pairs.burnt_in(o.first_parent(root, params), [valued(row["hot"], x) for x in burning], root, params)
            of_word = np.bincount(o.pairs.word, tables, row["n_words"])
            out, lo = [], 0
            for part, at in zip(o.parts, o.at, strict=True):
                asks, here = o.asks[lo : lo + len(at)], slice(lo, lo + len(at))
                if asks.any():
                    out.append((row["bucket"], part, rising(at[asks]), squeezed(of_word[here][asks]), squeezed(o.pairs.word_hash[here][asks] & np.uint64(0xFFFFFFFF)), None))
                lo += len(at)
            own = np.ones(row["n_contexts"], bool)
            own[o.pairs.hot] = False
            customers, taken = (np.bincount(o.pairs.context, x, row["n_contexts"])[own] for x in (o.pairs.count, tables))
            out.append((row["bucket"], -1, None, None, None, strength_evidence(customers, taken, root.discount).tolist()))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "part", "at", "tables", "salts", "evidence"])

    burnt = materialise(state.select(*small).join(first, "bucket").mapInArrow(burn, "bucket int, part int, at binary, tables binary, salts binary, evidence array<double>"), "burnt")
    strength = params.strength
    if params.sample_strength:
        found = burnt.where("part < 0").select(*[F.sum(F.col("evidence")[k]).alias(str(k)) for k in range(len(strengths(root.discount)))]).first()
        evidence = np.array([x or 0.0 for x in found]) + strength_evidence(*(np.array([x[h] for h in shared], np.int64) for x in (shared, burning[-1])), root.discount)
        strength = drawn_strength(evidence, root.discount, params.seed)
    seated = materialise(burnt.where("part >= 0").repartition(parts, "part").groupBy("part").applyInPandas(lambda g: seated_words(g, root, params), SEATED), "seated")
    release(burnt)
    y = seated.where("bucket < 0").select(*[F.sum(F.col("sums")[k]).alias(str(k)) for k in range(2)]).first()
    once = int(x["5"] or 0)  # words with one customer have one table in one context, and one in the parent
    after = replace(root, customers=float((y["0"] or 0) + once), tables=float((y["1"] or 0) + once), strength=strength)
    second = by_bucket(seated, "seated", "customers", "tables")
    if apart is not None:
        met = materialise_bucketed(apart.join(second, "bucket"), "shared_seated", "bucket", buckets)
        release(apart)
        for sweep in range(params.averaged):
            totals.append(swept_once(met, params.burn_in + sweep, after))
        release(met)
    steps = totals if shared else [{}] * (params.burn_in + params.averaged + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            o = Opened.of(row, shared)
            hot_tables = [valued(row["hot"], x) for x in steps]
            tables = o.pairs.burnt_in(o.first_parent(root, params), hot_tables, root, params)
            customers, own = np.minimum(o.counts, 1), np.minimum(o.counts, 1)
            customers[o.asks], own[o.asks] = seats_of(row, "customers"), seats_of(row, "tables")
            parent = after.probability(customers, own, o.counts > 0, params)
            p = np.zeros(len(tables))
            for number in range(params.burn_in, params.burn_in + params.averaged):
                tables = o.pairs.sweep(tables, parent, hot_tables[number], number, after, params)
                p += o.pairs.predictive(tables, parent, hot_tables[number + 1], after)
            logs = -np.log10(p / params.averaged)
            base = -np.log10((o.counts + 0.1) / (after.tokens + 0.1 * (after.words + 1)))[o.pairs.word]
            known = (o.counts > 0)[o.pairs.word]
            out = [(a["chunk"], None, None, None, None, a["about"]) for a in row["abouts"]]
            for chunk, each, at in zip(row["chunks"], row["each"], row["pairs_of"], strict=True):
                n, at = (widened(each) >> 1).astype(np.int64), widened(at)
                some = np.flatnonzero(n)
                starts = np.cumsum(n[some]) - n[some]
                total = lambda v: np.add.reduceat(v[at], starts)  # noqa: B023, E731
                out.append((chunk, rising(some), squeezed(np.rint(total(base) * _PARTS_OF_ONE), "<u8"), squeezed(np.rint(total(logs) * _PARTS_OF_ONE), "<u8"), squeezed(total(known.astype(np.int64))), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.binary()] * 5), strict=True)], ["chunk", "documents", "base", "score", "known", "about"])

    whole = state.select(*small, "chunks", "each", "pairs_of", "abouts").join(first, "bucket", "left").join(second, "bucket", "left")
    sums = whole.mapInArrow(score, PARTIAL)
    return sums.groupBy("chunk").applyInPandas(lambda g: assembled(g, root.tokens), SCORES)
