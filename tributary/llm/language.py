"""Language identification by Bayesian fusion of evidence.

For each row the posterior over languages combines
* the likelihood of its whole text under a byte-trigram model by language, counted over all
  texts with a known language, tempered so that a long text does not drown the rest;
* the declared markup language and the address suffix, through confusion tables;
* a prior of its host, smoothed by its domain's, in turn smoothed by the global one.
Confusion tables and priors are grouped sums of the text posteriors; a row's own share is
taken out of its priors.  ``und`` is the language of texts that no model explains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import free_name, materialise, release, small_batches

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    """``max_trigrams``: a text's likelihood counts as that of at most so many average trigrams.
    ``contradiction``: a text is in another language than declared if its trigrams are on average e to that
    power likelier there; texts that mix the two stay below.

    ``dense_entries``, ``broadcast_hosts`` and ``hot_rows`` choose how things are held and joined; no result
    depends on them.
    """

    max_trigrams: float = 40.0
    hash_bits: int = 16
    host_weight: float = 5.0
    domain_weight: float = 20.0
    confusion_weight: float = 2.0
    unknown_prior: float = 0.01
    accept: float = 0.5
    contradiction: float = 2.0
    dense_entries: int = 1 << 26
    broadcast_hosts: int = 100_000
    hot_rows: int = 10_000


@dataclass(frozen=True)
class TextModel:
    """Trigram counts by language, as rows of buckets: those of bucket b are at first[b] : first[b + 1].

    Every bucket counts half a trigram more.  The last language is ``und``, even over all buckets.
    """

    languages: tuple[str, ...]
    first: np.ndarray
    language: np.ndarray
    count: np.ndarray
    params: LanguageParams

    @cached_property
    def totals(self) -> np.ndarray:
        """Of each language but the last, with the halves."""
        return np.bincount(self.language, self.count, len(self.languages) - 1) + (1 << self.params.hash_bits) / 2

    @cached_property
    def gains(self) -> np.ndarray:
        """What each count adds to the log probability of a bucket without any."""
        return np.log((self.count + 0.5) / 0.5)

    @cached_property
    def table(self) -> np.ndarray | None:
        """Log probabilities [bucket, language], where that many fit."""
        buckets, n = 1 << self.params.hash_bits, len(self.languages) - 1
        if buckets * (n + 1) > self.params.dense_entries:
            return None
        out = np.tile(np.append(np.log(0.5 / self.totals), -np.log(buckets)), (buckets, 1))
        out[np.repeat(np.arange(buckets), np.diff(self.first)), self.language] += self.gains
        return out.astype(np.float32)

    def log_likelihood(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[text, language]: sums over the trigrams of each text."""
        n = len(self.languages)
        out = np.zeros((len(sizes), n))
        starts, some = np.cumsum(sizes) - sizes, np.flatnonzero(sizes > 0)
        if not len(some):
            return out
        if self.table is not None:
            out[some] = np.add.reduceat(self.table[codes], starts[some], axis=0, dtype=np.float64)
            return out
        many = np.diff(self.first)[codes]
        at = np.repeat(self.first[codes] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        text = np.repeat(np.repeat(np.arange(len(sizes)), sizes), many)
        gained = np.bincount(text * n + self.language[at], self.gains[at], out.size).reshape(out.shape)
        return gained + sizes[:, None] * np.append(np.log(0.5 / self.totals), -self.params.hash_bits * np.log(2))

    def without(self, codes: np.ndarray, language: int) -> float:
        """Log likelihood of a text's trigrams under a language that has not counted this text."""
        some, own = np.unique(codes, return_counts=True)
        count = np.zeros(len(some))
        for k, b in enumerate(some.tolist()):
            part = slice(self.first[b], self.first[b + 1])
            at = np.flatnonzero(self.language[part] == language)
            count[k] = self.count[part][at[0]] if len(at) else 0
        return float((own * np.log((np.maximum(count - own, 0) + 0.5) / (self.totals[language] - len(codes)))).sum())


# letters and bytes beyond ASCII stay, A-Z in lower case; all else is a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _trigrams(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the folded words of the texts, and how many each text has."""
    folded = [b" ".join([b"", *(t or b"").translate(_FOLD).split(), b""]) for t in texts]
    joined = np.frombuffer(b"".join(folded) + b"  ", np.uint8).astype(np.uint32)
    code = (joined[:-2] * np.uint32(0x9E3779B1) ^ joined[1:-1] * np.uint32(0x85EBCA77) ^ joined[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - bits)
    sizes = np.fromiter(map(len, folded), np.int64, len(folded))
    keep = np.ones(len(code), bool)  # trigrams across two texts do not count, nor those of a text without words
    ends = np.cumsum(sizes)
    for back in (1, 2):
        keep[np.maximum(ends - back, 0)[sizes >= back]] = False
    counts = np.maximum(sizes - 2, 0)
    return code[keep[: len(code)]], counts


def train(texts: DataFrame, params: LanguageParams = LanguageParams()) -> TextModel:
    """Count trigrams of every row of (text, lang) with both; the counts are bounded by buckets times languages."""
    known = small_batches(texts).select("text", F.lower("lang").alias("lang")).where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            text, lang = batch.column(0).cast(pa.binary()).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for one in set(lang):
                at = np.flatnonzero(lang == one)
                for lo in range(0, len(at), 500):
                    codes, _ = _trigrams([text[i] for i in at[lo : lo + 500]], params.hash_bits)
                    total[one] = total.get(one, 0) + np.bincount(codes, minlength=1 << params.hash_bits)
        for one, v in total.items():
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(v[some])], ["lang", "bucket", "n"])

    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "trigrams")
    found = counts.toArrow()
    release(counts)
    names = found["lang"].combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    languages = names.dictionary.to_pylist()
    rank = np.argsort(np.argsort(np.array(languages, object))) if languages else np.empty(0, np.int64)
    language, bucket = rank[names.indices.to_numpy(zero_copy_only=False)] if languages else np.empty(0, np.int64), found["bucket"].to_numpy()
    order = np.lexsort((language, bucket))
    first = np.searchsorted(bucket[order], np.arange((1 << params.hash_bits) + 1))
    return TextModel((*sorted(languages), UNKNOWN), first, language[order].astype(np.int64), found["n"].to_numpy()[order].astype(float), params)


def text_log_likelihood(texts: list[bytes | None], model: TextModel, counted_as: list[str | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log likelihoods [text, language] and the number of trigrams by text.

    ``counted_as`` names the language under which the model has counted each text; where that text is more
    than a twentieth of its language, its own share is left out.
    """
    out, sizes = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    index = {x: i for i, x in enumerate(model.languages[:-1])}
    for lo in range(0, len(texts), 200):
        codes, n = _trigrams(texts[lo : lo + 200], model.params.hash_bits)
        out[lo : lo + 200] = model.log_likelihood(codes, n)
        for k, (name, end) in enumerate(zip(counted_as[lo : lo + 200], np.cumsum(n).tolist(), strict=True) if counted_as else ()):
            if n[k] and (at := index.get(name)) is not None and 20 * n[k] > model.totals[at] - (1 << model.params.hash_bits) / 2:
                out[lo + k, at] = model.without(codes[end - n[k] : end], at)
        sizes[lo : lo + 200] = n
    return out * (np.minimum(1, model.params.max_trigrams / np.maximum(sizes, 1)))[:, None], sizes


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def with_sums(rows: DataFrame, sums: DataFrame, what: str, params: LanguageParams) -> DataFrame:
    """``rows`` with ``sums`` (what, sums, rows) of their host or domain; null without one.

    Up to ``broadcast_hosts`` sums go along with the tasks.  With more, only those with very many rows do
    (their number is bounded by the rows over ``hot_rows``, which grows with the table), so that no task
    gets all rows of one.
    """
    n = sums.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    own = sums.drop("rows")
    if n["n"] <= params.broadcast_hosts:
        return rows.join(F.broadcast(own), what, "left")
    hot_rows = max(params.hot_rows, n["rows"] // params.hot_rows)
    hot = F.broadcast(sums.where(F.col("rows") > hot_rows).drop("rows"))
    some, columns = rows.where(F.col(what).isNotNull()), [*rows.columns, f"{what}_sum"]
    none = rows.where(F.col(what).isNull()).withColumn(f"{what}_sum", F.lit(None).cast("array<double>"))
    rest = some.join(hot.select(what), what, "left_anti").join(own, what)
    return none.select(columns).unionByName(some.join(hot, what).select(columns)).unionByName(rest.select(columns))


def identify(rows: DataFrame, model: TextModel, counted: bool = False) -> DataFrame:
    """Add ``language``, ``probability``, ``letters`` (whether the text has a likelihood) and ``apart`` (how much
    likelier its average trigram is there than in the declared language, as a logarithm) to rows of
    (key, text, declared, suffix, host, domain); drops text.

    declared, suffix, host and domain may be null: that evidence is then left out.  A text
    without letters has no likelihood; the other evidence decides, and with none it is ``und``.
    One row per input row.  ``counted``: the model has counted these texts under what they declare.
    """
    params, languages = model.params, model.languages
    n = len(languages)
    prior = np.array([(1 - params.unknown_prior) / max(n - 1, 1)] * (n - 1) + [params.unknown_prior])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            like, sizes = text_log_likelihood(batch.column(at).cast(pa.binary()).to_pylist(), model, batch.column("declared").to_pylist() if counted else None)
            post = _softmax(like + np.log(prior)) * (sizes > 0)[:, None]
            lists = [pa.ListArray.from_arrays(np.arange(0, (batch.num_rows + 1) * n, n, dtype=np.int32), pa.array(x.ravel())) for x in (like, post)]
            weight = pa.array(np.minimum(sizes, params.max_trigrams).astype(float))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), weight, *lists], [*(f for f in batch.schema.names if f != "text"), "weight", "like", "post"])

    kept = [c for c in ("key", "declared", "suffix", "host", "domain")]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    seen = materialise(rows.select("key", "declared", "suffix", "host", "domain", "text").mapInArrow(read, f"{schema}, weight double, like array<double>, post array<double>"), "evidence")
    sums = F.array(*[F.sum(F.element_at("post", i + 1)) for i in range(n)])

    known = list(languages[:-1])
    shares = {}
    for what in ("declared", "suffix"):
        value = F.when(F.col(what).isin(known), F.col(what)).otherwise("")
        table = {r["v"]: np.array(r["s"]) for r in seen.where(F.col(what).isNotNull()).groupBy(value.alias("v")).agg(sums.alias("s")).collect()}  # a row per language
        counts = np.array([table.get(v, np.zeros(n)) for v in [*known, ""]]).T.reshape(n, n)
        agree = np.full((n, n), 0.2 / n) + 0.8 * np.eye(n)  # before any count: mostly true
        shares[what] = np.log((counts + params.confusion_weight * agree) / (counts + params.confusion_weight * agree).sum(1, keepdims=True))
    total = seen.agg(sums.alias("s")).first()["s"]
    everywhere = np.array([x or 0.0 for x in total]) + prior * params.domain_weight
    everywhere /= everywhere.sum()
    joined = seen
    for what in ("host", "domain"):
        by = seen.where(F.col(what).isNotNull()).groupBy(what).agg(sums.alias(f"{what}_sum"), F.count("*").alias("rows"))
        joined = with_sums(joined, materialise(by, what), what, params)
    index = {x: i for i, x in enumerate([*known, ""])}

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            dense = lambda name: np.array([x if x is not None else [0.0] * n for x in c[name].to_pylist()]).reshape(-1, n)  # noqa: B023, E731
            like, post = dense("like"), dense("post")
            others = lambda name: np.maximum(dense(name) - post, 0) * np.array(c[name].is_valid())[:, None]  # noqa: B023, E731
            in_domain, in_host = others("domain_sum"), others("host_sum")
            p = (in_domain + params.domain_weight * everywhere) / (in_domain.sum(1, keepdims=True) + params.domain_weight)
            p = (in_host + params.host_weight * p) / (in_host.sum(1, keepdims=True) + params.host_weight)
            score = like + np.log(p)
            letters = like.any(axis=1)
            some = letters.copy()
            for what in ("declared", "suffix"):
                said = c[what].to_pylist()
                told = np.array([x is not None for x in said], bool)
                column = np.array([index.get(x, n - 1) if x is not None else 0 for x in said], np.int64)
                score += np.where(told[:, None], shares[what][:, column].T, 0)
                some |= told & (column < n - 1)
            final = _softmax(score)
            best = final.argmax(1)
            best[~some] = n - 1
            rows = np.arange(len(best))
            said = np.array([index.get(x, -1) if x else -1 for x in c["declared"].to_pylist()], np.int64)
            apart = np.where(said >= 0, like[rows, best] - like[rows, said], 0) / np.maximum(c["weight"].to_numpy(), 1)
            names = [languages[i] for i in best]
            yield pa.RecordBatch.from_arrays([c["key"], pa.array(names, pa.string()), pa.array(final[rows, best]), c["declared"], c["suffix"], c["host"], pa.array(letters), pa.array(apart)], ["key", "language", "probability", "declared", "suffix", "host", "letters", "apart"])

    key = rows.schema["key"].dataType.simpleString()
    return joined.mapInArrow(fuse, f"key {key}, language string, probability double, declared string, suffix string, host string, letters boolean, apart double")


_DROP = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>")
_LANG = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""")
_URL = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)[^/?#]*(?:/([^/?#]*))?")
_ENTITY = re.compile(r"&#?\w{1,8};")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(key, text, declared, suffix, host, domain) of pages (page_id, url, html).

    ``suffix`` is the language that the address names: a path that begins with a two-letter
    segment, else a two-letter ending of the host.  The domain is the host's last two labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                html, m = html or "", _URL.match(url or "")
                host = m[1].lower() if m else None
                first = (m[2] or "").lower() if m else ""
                ending = host.rpartition(".")[2] if host else ""
                suffix = next((x for x in (first, ending) if len(x) == 2 and x.isalpha()), None)
                declared = _LANG.search(html)
                rows.append((key, _ENTITY.sub(" ", _DROP.sub(" ", html)), declared[1].lower() if declared else None, suffix, host, ".".join(host.split(".")[-2:]) if host else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(columns)], ["key", "text", "declared", "suffix", "host", "domain"])

    return small_batches(pages).select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "key long, text string, declared string, suffix string, host string, domain string")


def identify_pages(pages: DataFrame, documents: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """page_id, language, probability, accepted, declared, suffix, host of every page.

    The text model is counted over all ``documents`` with text and language, however many languages
    those name.  Null html is an empty page; a null or odd url gives neither suffix nor host; repeated
    rows each get a row; whole pages are read, however long.  Extra columns are ignored; no pages give no
    row, and without documents the other evidence decides between no languages: ``und``.
    """
    found = identify(page_evidence(pages), train(documents, params))
    return found.select(F.col("key").alias("page_id"), "language", "probability", ((F.col("language") != UNKNOWN) & (F.col("probability") >= params.accept)).alias("accepted"), "declared", "suffix", "host")


def keep_identified(documents: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """Rows of ``documents`` (all columns) whose language is found by ``identify`` and is not clearly another than declared.

    The declared ``lang`` is the markup evidence and ``source`` the host; there is no address and no
    domain.  The text model has counted the same texts, so a text's own share is left out where it weighs.
    A text without letters is rejected whatever is declared.  Where no row declares a language none can be
    told apart, and every text with letters stays.  Decisions go by a key of what ``identify`` reads, so
    equal rows share theirs; only the keys of rejected rows move.  An empty table stays empty.
    """
    model = train(documents, params)
    mark = free_name(documents, "row_key")
    read = [F.col("text"), F.lower("lang"), F.col("source")]
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in ("text", "lang", "source")])
    key = F.concat_ws("-", F.xxhash64(nulls, *read).cast("string"), F.xxhash64(F.lit(1), nulls, *read).cast("string"))
    none = F.lit(None).cast("string")
    rows = small_batches(documents).select(key.alias("key"), "text", F.lower("lang").alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))
    found = identify(rows, model, counted=True)
    fails = ~F.col("letters")
    if len(model.languages) > 1:
        other = F.coalesce((F.col("declared") != F.col("language")) & (F.col("apart") >= params.contradiction), F.lit(False))
        fails |= (F.col("language") == UNKNOWN) | (F.col("probability") < params.accept) | other
    rejected = materialise(found.where(fails).select(F.col("key").alias(mark)).distinct(), "rejected")
    return documents.withColumn(mark, key).join(rejected, mark, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
