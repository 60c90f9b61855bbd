"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a row of transformed statistics.  Class means and covariances come from
moments summed over all labelled training rows; covariances are shrunk towards the pooled
one and a sphere.  A score is the logistic of the difference of the two Mahalanobis
log-densities plus log prior, computed from the classes' Cholesky factors, made once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import id_remainder, materialise, small_batches

#: Names of the statistics, in the order of ``statistics``.
STATISTICS = ("log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "marks", "bars", "exclaims", "other_punct", "distinct_words", "repeated_lines", "line_words", "shouted", "top_word", "non_ascii", "symbol_ends")


_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS, _OTHER = b"#$%&*+<=>@\\^_`~", b"\"'()-/:;[]{}?"
_SYMBOL_END = re.compile(rb"[#$%&*+=@^~|!]\s")
_SHOUTED = re.compile(rb"\b[A-Z]{2,}")


@dataclass(frozen=True)
class QualityParams:
    """``to_pooled`` and ``to_sphere`` are the shrinkage weights of the class covariances."""

    to_pooled: float = 0.1
    to_sphere: float = 0.02
    threshold: float = 0.7


@dataclass(frozen=True)
class QualityModel:
    """Log prior, mean and inverse lower Cholesky factor by class; ``constant`` where one class is missing."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    constant: float | None
    params: QualityParams


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of a whole text (null: as empty): logs of sizes and roots of shares."""
    text = text or b""
    n = max(len(text), 1)
    words = text.split()
    k = max(len(words), 1)
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    root = lambda part, whole: (part / whole) ** 0.5
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p((len(text) - len(words)) / k), root(_count(text, _UPPER), n), root(_count(text, _DIGITS), n), root(_count(text, _SYMBOLS), n), root(_count(text, b".,"), n), root(text.count(b"|"), n), root(text.count(b"!"), n), root(_count(text, _OTHER), n),
        len(distinct) / k, root(len(lines) - len(set(lines)), len(lines) + 5), np.log1p(len(words) / max(len(lines), 1)), root(len(_SHOUTED.findall(text)), k), root(max(distinct.values(), default=0), k), root(len(text) - len(text.decode("utf-8", "replace")), n), root(len(_SYMBOL_END.findall(text)), k),
    ]


def _measured(documents: DataFrame) -> DataFrame:
    """doc_id and statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def fit(measured: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Fit from all rows labelled 0 or 1 whose id's crc32 modulo 4 is not 2; other labels are never read.

    Only sums of one row per class and task reach the driver.  With one class missing, every
    score is that of the other (0.5 without any label).
    """
    d = len(STATISTICS)
    known = labels.where(F.col("doc_id").isNotNull() & (id_remainder("doc_id", 4) != 2) & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long"), "quality")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (d + 1) ** 2))
        for batch in batches:
            y, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            x = np.c_[np.ones(len(y)), x.flatten().to_numpy().reshape(len(y), d)]
            for c in (0, 1):
                total[c] += (x[y == c].T @ x[y == c]).ravel()
        rows = [{"c": c, "i": i, "v": v} for c in (0, 1) for i, v in enumerate(total[c]) if v]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("c", pa.int32()), ("i", pa.int32()), ("v", pa.float64())]))

    sums = measured.join(known, "doc_id").select("quality", "x").mapInArrow(moments, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v"))
    m = np.zeros((2, (d + 1) ** 2))
    for r in sums.collect():  # at most 2 (d + 1)^2 rows
        m[r["c"], r["i"]] = r["v"]
    return from_moments(m.reshape(2, d + 1, d + 1), params)


def from_moments(m: np.ndarray, params: QualityParams) -> QualityModel:
    """Model from, by class, the sum of outer products of (1, x)."""
    d, n = m.shape[1] - 1, m[:, 0, 0]
    if not n.all():
        return QualityModel(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 0.5 if not n.any() else float(n[1] > 0), params)
    means = m[:, 0, 1:] / n[:, None]
    scatter = m[:, 1:, 1:] - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, offsets = [], []
    for c in (0, 1):
        own = scatter[c] / n[c]
        own = (1 - params.to_pooled) * own + params.to_pooled * pooled
        own = (1 - params.to_sphere) * own + params.to_sphere * scale
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(lower)).sum())
    return QualityModel(means, np.array(factors), np.array(offsets), None, params)


def log_odds(x: np.ndarray, model: QualityModel) -> np.ndarray:
    """Log density of class 1 less that of class 0, priors included."""
    d = [model.offsets[c] - 0.5 * (((x - model.means[c]) @ model.factors[c].T) ** 2).sum(1) for c in (0, 1)]
    return d[1] - d[0]


def quality_scores(documents: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 4 is 2), score, predicted (1 if score >= 0.7).

    One row per input row; null text is scored as empty text; a null doc_id stays null and
    counts as crc32 of empty text.  Scores use the text alone, whole however long.  A repeated id is
    learned from with each of its texts, a label row as often as it is given, so that a document labelled both
    0 and 1 speaks for both classes alike.  Extra columns are ignored; an empty table gives no row, and
    without labels of both kinds the score is one constant.
    """
    measured = materialise(_measured(documents), "statistics")
    model = fit(measured, labels, params)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model.constant is not None:
                p = np.full(n, model.constant)
            else:
                z = np.clip(log_odds(batch.column(1).flatten().to_numpy().reshape(n, -1), model), -500, 500)
                p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    scored = measured.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))
