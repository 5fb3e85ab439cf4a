"""A quality classifier: regularised quadratic discriminant analysis.

Each whole text gives a vector of document statistics, transformed so that
they spread evenly (logarithms of counts and shares). Each class has a mean
and a covariance, shrunk towards the pooled one and a multiple of the unit
matrix. Their Cholesky factors are inverted once, go to the workers with the
scoring function, and give each text's Mahalanobis distance as the length of a
product of that triangle and the text's distance from the mean. The score is the logistic of the difference of log-densities, with the
classes' shares as priors.

Training needs one pass: counts, sums and sums of products by class about a
fixed point near the middle of all statistics, from one block a partition,
added up by a grouped aggregation, so the driver gets a row for each class and
sum. All labelled rows count, there is no sample. Sums are added as decimals:
they do not depend on the order of tasks.

Null and empty texts get the statistics of an empty text and a score. Labels
other than 0 and 1, null labels, labels of unknown doc_ids, and doc_ids with
both labels do not count; equal labels of one doc_id count once. A null doc_id
is not held out and has no label. Repeated rows are scored (and learned from)
as often as they come. Very long texts are measured whole. Texts of equal
statistics tie. Other columns, whatever their names, are not read. Without labels of both classes every score is the share
of class 1, or 0.5. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.common import batches, byte_texts, materialize, pick
from mergeloom.llm.quality_rules import SPACES, repeated

NAMES = (
    "log_words", "mean_word", "spread_word", "log_symbols", "log_punctuation", "log_digits", "log_upper",
    "log_no_letter", "type_share", "repeat_share", "dup_line_share", "log_line_words", "log_top_word",
)
D = len(NAMES)
SYMBOLS, PUNCTUATION, DIGITS, UPPER = b"#*$%&|<>~^_=+@\\{}[]/", b".,;:!?'\"()-", b"0123456789", bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
CLASSES = (0, 1)
SHRINK, RIDGE = 0.1, 0.05
THRESHOLD = 0.7
#: A point near the middle of the statistics: sums about it lose few digits.
CENTER = np.array([5.0, 5.0, 1.0, -5.0, -4.0, -4.0, -4.0, -2.0, 1.0, 0.1, 0.1, 4.0, -3.0])


def _share(part: float, whole: float) -> float:
    """The logarithm of a share, level below a tenth of a percent."""
    return math.log(part / max(whole, 1) + 1e-3)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text; finite for every text."""
    words = text.split()
    n = len(words)
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    chars = float(sizes.sum())
    without = lambda drop: len(text) - len(text.translate(None, drop))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    known: dict[bytes, int] = {}
    for w in words:
        known[w] = known.get(w, 0) + 1
    return [
        math.log1p(n), min(float(sizes.mean()), 40.0), math.log1p(float(sizes.std())), _share(without(SYMBOLS), chars),
        _share(without(PUNCTUATION), chars), _share(without(DIGITS), chars), _share(without(UPPER), chars),
        _share(chars - without(LETTERS), chars), len(known) / max(n, 1) ** 0.85, math.sqrt(repeated(words) / max(n, 1)),
        math.sqrt((len(lines) - len(set(lines))) / max(len(lines), 1)), math.log1p(n / max(len(lines), 1)),
        _share(max(known.values(), default=0), n),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors, log-determinants and log-priors of the
    two classes; or a constant score."""

    means: np.ndarray | None
    factors: np.ndarray | None
    offsets: np.ndarray | None
    constant: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = (x - mean) @ factor.T
            logs.append(offset - 0.5 * (z * z).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """From the classes' counts, sums and sums of products about ``CENTER``."""
    if (counts < 2).any():
        return Discriminant(None, None, None, float(counts[1] / counts.sum()) if counts.sum() else 0.5)
    means = sums / counts[:, None]
    scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / counts.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    covariances = [(1 - shrink) * s / n + shrink * pooled + ridge * scale for s, n in zip(scatter, counts, strict=True)]
    factors = np.array([np.linalg.inv(np.linalg.cholesky(c)) for c in covariances])
    offsets = np.log(counts / counts.sum()) + np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
    return Discriminant(means + CENTER, factors, offsets)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of whole texts, one Arrow pass."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            x = np.array([statistics(t) for t in byte_texts(b.column(1))], np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, D, np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "x"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), D)


def fit(rows: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """From (label, x), label 0 or 1: sums by partition, then by class."""

    def run(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {c: np.zeros(1 + D + D * D) for c in CLASSES}
        for b in batch:
            labels, x = b.column(0).to_numpy(), _rows(b.column(1))
            for c in CLASSES:
                own = x[labels == c] - CENTER
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        k = 1 + D + D * D
        i = np.arange(k)
        for c, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, c, np.int32)), pa.array(i), pa.array(sums)], ["label", "i", "s"])

    added = rows.select("label", "x").mapInArrow(run, "label int, i long, s double").groupBy("label", "i").agg(F.sum(F.col("s").cast("decimal(38,12)")).cast("double").alias("s")).collect()
    sums = np.zeros((2, 1 + D + D * D))
    for r in added:
        sums[r.label, r.i] = r.s
    return discriminant(sums[:, 0], sums[:, 1 : 1 + D], sums[:, 1 + D :].reshape(2, D, D), shrink, ridge)


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of (doc_id, x)."""

    def run(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(_rows(b.column(1))))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted). Learns from labels (doc_id,
    quality) of rows that are not held out; scores every row."""
    rows = materialize(measured(docs), "statistics")
    known = pick(labels, doc_id="long", quality="int").where("quality in (0, 1) and doc_id is not null").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("label"), F.max("quality").alias("_other")).where("label = _other").drop("_other")
    model = fit(rows.where(~held_out()).join(known, "doc_id"))
    out = score(rows, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
