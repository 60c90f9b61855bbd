"""Toxicity by non-negative positive-unlabelled learning.

A classifier is trained from confirmed toxic documents and *unlabelled* text only:
with class prior p, the risk is p*E_P[l(f,+)] + max(0, E_U[l(f,-)] - p*E_P[l(f,-)]).
The second part estimates the risk on clean text; where it falls below zero the step
goes against its gradient, which keeps a flexible model from driving it negative.

Features are hashed words and word beginnings (insults bend and compound); the
informative ones are chosen from document frequencies, counted on Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Memo, free_name, id_remainder, materialise, release, small_batches, words_of


@dataclass(frozen=True)
class ToxicityParams:
    """``max_positive`` and ``max_unlabelled`` bound the rows that the fit looks at.

    ``min_evidence`` is a likelihood-ratio statistic: 20 keeps chance features of a small sample out.
    """

    max_positive: int = 8000
    max_unlabelled: int = 16000
    hash_bits: int = 20
    n_features: int = 768
    prefixes: tuple[int, ...] = (4, 5, 6)
    min_evidence: float = 20.0
    epochs: int = 300
    learning_rate: float = 0.05
    l2: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by hashed feature; an empty ``weights`` scores every text 0."""

    weights: dict[int, float]
    bias: float
    params: ToxicityParams


def feature_buckets(word: bytes, params: ToxicityParams) -> tuple[int, ...]:
    """Hash buckets of a word, trimmed of ASCII punctuation, and of its beginnings in characters."""
    text = word.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").decode("utf-8", "replace")
    if not text:
        return ()
    mask = (1 << params.hash_bits) - 1
    parts = [f"w{text}"] + [f"{n}{text[:n]}" for n in params.prefixes if len(text) > n]
    return tuple(zlib.crc32(p.encode()) & mask for p in parts)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _document_frequencies(rows: DataFrame, params: ToxicityParams) -> DataFrame:
    """(bucket, positives, unlabelled): documents of each kind that hold the bucket; at most 2^hash_bits rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << params.hash_bits), np.int64)
        memo = Memo(lambda w: feature_buckets(w, params))
        for batch in batches:
            for text, kind in zip(_texts(batch, "text"), batch.column(1).to_pylist(), strict=True):
                found = {b for w in set(words_of(text)) for b in memo[w]}
                seen[kind, np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(seen.any(0))
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[1, part]), pa.array(seen[0, part])], ["bucket", "p", "u"])

    counted = rows.select("text", "is_positive").mapInArrow(count, "bucket long, p long, u long")
    return counted.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def nnpu_parts(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk on positives, risk on clean text as estimated from both samples, and their gradients by (w, b)."""
    sp, su = 1 / (1 + np.exp(-(p @ w + b))), 1 / (1 + np.exp(-(u @ w + b)))
    loss = lambda s: float(np.mean(-np.log(np.maximum(s, 1e-12))))
    # derivatives of the logistic losses by the decision value
    g_pos, g_up, g_u = (sp - 1) * prior / len(p), sp * prior / len(p), su / len(u)
    clean = np.append(u.T @ g_u - p.T @ g_up, g_u.sum() - g_up.sum())
    return prior * loss(sp), loss(1 - su) - prior * loss(1 - sp), np.append(p.T @ g_pos, g_pos.sum()), clean


def nnpu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, params: ToxicityParams) -> tuple[np.ndarray, float]:
    """Linear logistic model by Adam on the non-negative risk; returns weights and bias."""
    rng = np.random.default_rng(params.seed)
    n, w, b = positive.shape[1], np.zeros(positive.shape[1], np.float64), 0.0
    b = float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    step = 0
    for _ in range(params.epochs):
        p = positive[rng.permutation(len(positive))[:2048]].astype(np.float32)
        u = unlabelled[rng.permutation(len(unlabelled))[:4096]].astype(np.float32)
        _, clean_risk, grad_positive, grad_clean = nnpu_parts(p, u, w, b, prior)
        grad = grad_positive + grad_clean if clean_risk >= 0 else -grad_clean
        grad[:-1] += params.l2 * w
        step += 1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = params.learning_rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, b


def fit(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Train on documents whose id's crc32 modulo 5 is not 0; labels of the others are never read.

    Positives are labelled 1; unlabelled texts are drawn from all training documents whatever
    their labels.  Both samples are the rows of least id hash, bounded by the parameters, so their
    ids may be broadcast.  The class prior is the share of 1 among all training labels, which is all
    that the labels 0 are used for.  Without a positive row, or with no feature above
    ``min_evidence``, the model scores 0 everywhere.  A label row counts in the prior as often as it is given; an id
    with labels 1 and 0 is a positive.  Repeated ids count once in the draw and with each of
    their texts in the fit; null ids take no part; ties in evidence go to the lesser bucket.
    """
    train = lambda df: df.where(F.col("doc_id").isNotNull() & (id_remainder("doc_id", 5) != 0))
    known = train(labels.select("doc_id", "toxic").where("toxic is not null"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("share")).first()["share"]
    if not share:
        return ToxicityModel({}, 0.0, params)
    prior = min(share, 0.95)

    def first(df: DataFrame, most: int) -> DataFrame:
        """The ids of least hash; a threshold that a few more than ``most`` pass goes before the sort."""
        ids, n = df.select("doc_id").distinct(), df.count()
        if n > 4 * most:
            ids = ids.where(F.xxhash64("doc_id") < F.lit(int(-(1 << 63) + (2 * most / n) * (1 << 64))))
        return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    chosen = first(known.where("toxic = 1"), params.max_positive).withColumn("is_positive", F.lit(1)).unionByName(first(train(documents), params.max_unlabelled).withColumn("is_positive", F.lit(0)))
    chosen = chosen.groupBy("doc_id").agg(F.collect_set("is_positive").alias("kinds"))
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.explode("kinds").alias("is_positive"))
    rows = small_batches(materialise(rows.repartition(documents.sparkSession.sparkContext.defaultParallelism), "sample"))  # three looks at the sample, one at the documents
    try:
        return _from_sample(rows, prior, params)
    finally:
        release(rows)


def _from_sample(rows: DataFrame, prior: float, params: ToxicityParams) -> ToxicityModel:
    """The model of sampled rows (text, is_positive)."""
    sizes = {r["is_positive"]: r["n"] for r in rows.groupBy("is_positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    rate_p, rate_u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    evidence = 2 * F.col("p") * F.log(rate_p / rate_u)  # a G statistic's part from the positives
    top = _document_frequencies(rows, params).where(evidence >= params.min_evidence).orderBy(evidence.desc(), "bucket").limit(params.n_features)
    buckets = sorted(r["bucket"] for r in top.select("bucket").collect())
    if not buckets:
        return ToxicityModel({}, 0.0, params)
    index = {b: i for i, b in enumerate(buckets)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda w: tuple(index[b] for b in feature_buckets(w, params) if b in index))
        for batch in batches:
            found = [sorted({i for w in set(words_of(t)) for i in memo[w]}) for t in _texts(batch, "text")]
            bits = np.zeros((len(found), len(buckets)), bool)
            bits[np.repeat(np.arange(len(found)), [len(x) for x in found]), [i for x in found for i in x]] = True
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())], ["is_positive", "found"])

    table = rows.mapInArrow(vectors, "is_positive int, found binary").toArrow()  # a bit a feature of each sampled row
    kind = table["is_positive"].to_numpy()
    packed = np.frombuffer(b"".join(table["found"].to_pylist()), np.uint8).reshape(len(kind), -1)
    dense = np.unpackbits(packed, axis=1, count=len(buckets)).astype(np.int8)
    order = np.lexsort((*[dense[:, i] for i in range(min(8, dense.shape[1]))], dense.sum(1, dtype=np.int32), kind))  # the same fit whatever the partitioning
    kind, dense = kind[order], dense[order]
    if not (kind == 1).any() or not (kind == 0).any():
        return ToxicityModel({}, 0.0, params)
    w, b = nnpu_fit(dense[kind == 1], dense[kind == 0], prior, params)
    return ToxicityModel({bucket: float(x) for bucket, x in zip(buckets, w, strict=True)}, b, params)


def score_texts(texts: list[bytes | None], model: ToxicityModel, memo: Memo | None = None) -> np.ndarray:
    """Score from 0 to 1 of each text; null and empty texts get the score of no feature."""
    memo = memo if memo is not None else word_memo(model)
    if not model.weights:
        return np.zeros(len(texts))
    values = np.empty(len(texts))
    for k, text in enumerate(texts):
        found: dict[int, float] = {}
        for word in set(words_of(text)):
            if hit := memo[word]:
                found.update(hit)
        values[k] = model.bias + sum(found[b] for b in sorted(found))
    return 1 / (1 + np.exp(-np.clip(values, -500, 500)))


def word_memo(model: ToxicityModel) -> Memo:
    return Memo(lambda w: {b: model.weights[b] for b in feature_buckets(w, model.params) if b in model.weights})


def toxicity_scores(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0), score, predicted (1 if score >= 0.5).

    One row per input row.  Null or empty text has no features and gets the base score; a null
    doc_id stays null and counts as crc32 of empty text.  Whole texts are read, however long.  Extra
    columns are ignored; an empty table gives no row.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(_texts(batch, "text"), model, memo))], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return small_batches(documents).select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double").select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """Rows of ``documents`` (all columns) that the model does not call toxic; one pass, no shuffle.

    Null and empty texts have the base score, below 0.5 unless most labels are 1.  An empty table stays empty.
    """
    mark = free_name(documents, "toxicity_score")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(model)
        for batch in batches:
            yield batch.append_column(mark, pa.array(score_texts(_texts(batch, "text"), model, memo)))

    schema = documents.select("*", F.lit(0.0).alias(mark)).schema
    return small_batches(documents).mapInArrow(keep, schema).where(F.col(mark) < 0.5).select(*[F.col(f"`{c}`") for c in documents.columns])
