"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics (``FEATURES``). Class means and
covariances come from sums over all labelled rows outside the held-out fold; each
class covariance is shrunk towards the pooled one and towards a multiple of the
identity. A score is the posterior of class 1: the difference of the two Gaussian
log densities, each a squared Mahalanobis length through a Cholesky factor that is
computed once, plus the log prior ratio.

Null text is empty text and scored like one. Labels other than 0 and 1, null labels
and labels of unknown ids are left out; an id labelled twice counts twice. With one
class or none learnt, every score is that class's share (0.5 without labels). Rows
with a null or repeated id each get their score; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, configure, fold, id_text, string_bytes
from .shingles import word_hashes, word_spans

#: In this order; shares of bytes and of words are square-rooted, sizes logged.
FEATURES = (
    "log_bytes", "upper", "digit", "point", "mark", "other", "space", "beyond_ascii", "word_mean", "word_sd",
    "distinct_words", "marked_words", "upper_words", "line_mean", "words_per_point",
)
_KIND = np.full(256, 0, np.uint8)  # lower-case letters
_KIND[0x41:0x5B] = 1
_KIND[0x30:0x3A] = 2
_KIND[[ord(c) for c in ".,;:'-"]] = 3
_KIND[[ord(c) for c in "!?\"()"]] = 4
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'-!?\"()"]] = 5
_KIND[:0x21] = 6
_KIND[0x80:] = 7


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    n, size = len(off) - 1, np.diff(off).astype(np.float64)
    kind = _KIND[raw]
    safe = np.maximum(size, 1)
    share = np.empty((8, n))
    for k in range(1, 8):
        total = np.r_[0, np.cumsum(kind == k, dtype=np.int32)]
        share[k] = np.diff(total[off]) / safe
    lines = np.diff(np.r_[0, np.cumsum(raw == 10, dtype=np.int32)][off]) + 1
    stops = np.diff(np.r_[0, np.cumsum(raw == 46, dtype=np.int32)][off]) + 1
    start, end = spans = word_spans(raw, off)
    h, first = word_hashes(raw, off, True, spans)
    words = np.diff(first)
    some = np.maximum(words, 1)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(values, dtype=np.float64)][first])

    length = (end - start).astype(np.float64)
    mean = per_text(length) / some
    sd = np.sqrt(np.maximum(per_text(length**2) / some - mean**2, 0))
    last = kind[end - 1] if len(end) else kind[:0]
    head = kind[start] if len(start) else kind[:0]
    doc = np.repeat(np.arange(n), words)
    order = np.argsort(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    hs, ds = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    distinct = np.bincount(ds[new], minlength=n)
    out = [np.log1p(size), *np.sqrt(share[1:8]), np.log1p(mean), np.log1p(sd), distinct / some]
    out += [np.sqrt(per_text((last >= 4) & (last <= 5)) / some), np.sqrt(per_text((head == 1) & (last != 0)) / some), np.log1p(size / lines), np.log1p(words / stops)]
    return np.stack(out, 1)


def features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (array<double> in the order of FEATURES)."""
    configure(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(*string_bytes(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    return id_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Two Gaussians with inverse Cholesky factors, worked out once; ``share`` stands in
    when one is missing."""

    means: np.ndarray | None
    whiten: list[np.ndarray]
    offset: float
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        lengths = [(((x - m) @ c.T) ** 2).sum(1) for m, c in zip(self.means, self.whiten, strict=True)]
        z = 0.5 * (lengths[0] - lengths[1]) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(table: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", folds: int = 5, pooled: float = 0.1, identity: float = 0.02) -> Discriminant:
    """From ``features`` and labels of ids outside fold 0; sums of a few numbers a task."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    rows = table.join(known.where(fold(F.col("doc_id"), folds) != 0), "doc_id").select("y", "x")
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["y", "s"])

    total = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInArrow(sums, "y int, s array<double>").collect():  # two rows a task
        total[r.y] += r.s
    n = total[:, 0]
    if min(n) < 2:
        return Discriminant(None, [], 0.0, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = total[:, 1 : 1 + d] / n[:, None]
    cov = [(total[k, 1 + d :].reshape(d, d) - n[k] * np.outer(means[k], means[k])) / (n[k] - 1) for k in (0, 1)]
    both = (cov[0] * (n[0] - 1) + cov[1] * (n[1] - 1)) / (n.sum() - 2)
    scale = np.diag(np.maximum(np.diag(both), 1e-8))
    shrunk = [(1 - pooled - identity) * c + pooled * both + identity * scale for c in cov]
    factors = [np.linalg.cholesky(c) for c in shrunk]
    logs = [np.log(np.diag(c)).sum() for c in factors]
    return Discriminant(means, [np.linalg.inv(c) for c in factors], float(logs[0] - logs[1] + np.log(n[1] / n[0])), float(n[1] / n.sum()))


def score(table: DataFrame, model: Discriminant, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """Per row of ``features``: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    out = table.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(documents: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """Fits on ``labels`` and scores every document; the statistics are computed once."""
    table = Scratch(documents.sparkSession, "quality").save(features(documents), "features")
    return score(table, fit(table, labels, **more))
