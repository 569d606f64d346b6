"""Language identification: averaged hashed subword embeddings, linear softmax.

A text becomes the mean of the embeddings of its words' byte 3-grams and 4-grams
(words carry a border mark on both sides; texts are lower-cased, all but letters
are borders). Embeddings and the softmax are trained together by stochastic
gradient descent in numpy, on the driver, on a bounded sample: about
``per_language`` labelled texts of each language, chosen by a hash of their id and
text, and twice as many rows in all at most. A fifth of the sample sets the softmax
temperature (calibration) and the score below which a prediction is rejected: the one
that a stated share, ``false_rejections``, of its right predictions falls short of. Prediction folds embeddings and softmax into
one table of a few hundred kilobytes, which every task gets.

``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, or
where nothing could be learnt. ``rejected`` holds for those and for scores under the
calibrated limit. Texts are read whole; ids may be null or repeated; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, fold, id_text, released, string_bytes

BITS, WIDTH = 15, 16
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 256)


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed subwords of all texts in turn, first subword of each, has a letter."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    lettered = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
    raw, off = string_bytes(pc.utf8_lower(column))
    n = len(column)
    # One border byte after each text, and one before the first.
    text = np.full(len(raw) + n + 4, 0x20, np.uint8)
    keep = np.ones(len(raw) + n + 1, bool)
    keep[off + np.arange(n + 1)] = False
    text[: len(keep)][keep] = _LETTER[raw]
    wide = text.astype(np.uint32)
    blank = text == 0x20
    two = wide[:-1] << np.uint32(8) | wide[1:]
    three = two[:-2] << np.uint32(8) | wide[2:-1]
    four = three << np.uint32(8) | wide[3:]
    size = len(keep)  # subwords that may start here
    middle = ~blank[1 : size + 1]
    ok3 = middle & ~(blank[:size] & blank[2 : size + 2])
    ok4 = middle & ~blank[2 : size + 2]
    h = np.empty(2 * size, np.uint16)
    h[::2] = (three[:size] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    h[1::2] = (four[:size] * np.uint32(0x85EBCA77) ^ np.uint32(0x5BD1E995)) >> np.uint32(32 - BITS)
    ok = np.empty(2 * size, bool)
    ok[::2], ok[1::2] = ok3, ok4
    count = np.r_[0, np.cumsum(ok)]
    return h[ok], count[2 * (off + np.arange(n + 1))], lettered


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (2**BITS, languages): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    limit: float

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: none), score, rejected."""
        h, first, lettered = subwords(column)
        n, k = len(first) - 1, len(self.languages)
        best, score = np.full(n, -1), np.zeros(n)
        size = np.diff(first)
        use = np.flatnonzero(size > 0)
        if len(use) and k:
            sums = np.empty((len(use), k))
            for j in range(k):
                sums[:, j] = np.add.reduceat(self.table[:, j][h], first[:-1][use], dtype=np.float64)
            logits = (sums / size[use, None] + self.bias) / self.temperature
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best[use], score[use] = p.argmax(1), p.max(1)
        off = (best < 0) | ~lettered
        best[off], score[off] = -1, 0
        return best, score, off | (score < self.limit)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, first, _ = subwords(batch.column(0))
        rows = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            u, c = np.unique(h[a:b], return_counts=True)
            rows.append((u.astype("<u2").tobytes(), (c / max(b - a, 1)).astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "pick", "at", "share"])


def _clipped(step: np.ndarray) -> np.ndarray:
    """A step of length 1 at most, so that texts with few distinct subwords can't overshoot."""
    return step / max(1.0, float(np.linalg.norm(step)))


def _low_quantile(scores: np.ndarray, rate: float) -> float:
    """The score that a ``rate`` of them falls short of: the lower of the empirical
    quantile and a normal one of the log-odds, for samples too small to hold it."""
    if not len(scores):
        return 0.0
    odds = np.log(scores) - np.log(np.maximum(1 - scores, 1e-12))
    normal = odds.mean() + NormalDist().inv_cdf(rate) * odds.std()
    return float(min(np.quantile(scores, rate, method="lower"), 1 / (1 + np.exp(-normal))))


def train(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, per_language: int = 600, epochs: int = 8, seed: int = 7, false_rejections: float = 0.002
) -> LanguageModel:
    """Learns from rows outside fold 0; about ``per_language`` texts a language."""
    configure(documents.sparkSession)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    wanted = F.lit(0)
    for lang, n in counts.items():
        wanted = F.when(F.col("lang") == lang, F.lit(int((1 << 20) * min(1.0, per_language / n)))).otherwise(wanted)
    sample = rows.where(spot < wanted).select("text", "lang", F.pmod(F.xxhash64("text", "doc_id"), F.lit(5)).cast("int").alias("pick"))
    sample = sample.limit(2 * per_language * len(counts))  # one row repeated very often hashes alike
    got = sample.mapInArrow(released(_counts), "lang string, pick int, at binary, share binary").toArrow()
    order = np.argsort([zlib.crc32(a) for a in got["at"].to_pylist()], kind="stable")  # not by arrival
    langs = sorted(counts)
    label = np.array([langs.index(x) for x in got["lang"].to_pylist()])[order]
    held = (got["pick"].to_numpy() == 0)[order]
    at = [np.frombuffer(x, "<u2").astype(np.int64) for x in got["at"].to_pylist()]
    share = [np.frombuffer(x, "<f4") for x in got["share"].to_pylist()]
    at, share = [at[i] for i in order], [share[i] for i in order]
    rng = np.random.default_rng(seed)
    e = (rng.standard_normal((1 << BITS, WIDTH)) / WIDTH).astype(np.float32)
    w, b = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    fit = np.flatnonzero(~held & np.array([len(x) > 0 for x in at]))
    weight = 1.0 / np.maximum(np.bincount(label[fit], minlength=len(langs)), 1)
    weight = weight / (weight[label[fit]].mean() if len(fit) else 1)
    for epoch in range(epochs):
        rate = 1.0 * (1 - epoch / epochs)
        for lo in range(0, len(fit), 16):
            own = rng.permutation(fit)[:16] if lo == 0 and epoch == 0 else fit[(lo + np.arange(16)) % len(fit)]
            idx, val = np.concatenate([at[i] for i in own]), np.concatenate([share[i] for i in own])
            cuts = np.r_[0, np.cumsum([len(at[i]) for i in own])]
            x = np.add.reduceat(e[idx] * val[:, None], cuts[:-1])
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), label[own]] -= 1
            p *= weight[label[own], None] / len(own)
            back = p @ w.T
            w -= _clipped(rate * 20 * (x.T @ p))
            b -= rate * p.sum(0)
            np.add.at(e, idx, -_clipped(rate * 200 * val[:, None] * np.repeat(back, np.diff(cuts), 0)))
        rng.shuffle(fit)
    table = (e @ w).astype(np.float32)
    model = LanguageModel(langs, table, b.astype(np.float64), 1.0, 0.0)
    check = [i for i in np.flatnonzero(held) if len(at[i])]
    if check:
        z = np.stack([share[i].astype(np.float64) @ table[at[i]] for i in check]) + b
        best = (np.inf, 1.0)
        for t in 2.0 ** np.arange(-4, 5, 0.25):
            s = z / t
            best = min(best, (float(np.mean(np.logaddexp.reduce(s, 1) - s[np.arange(len(check)), label[check]])), t))
        model.temperature = best[1]
        s = z / model.temperature
        top = np.exp(s.max(1) - np.logaddexp.reduce(s, 1))
        right = top[s.argmax(1) == label[check]]
        model.limit = _low_quantile(right, false_rejections)
    return model


def identify(documents: DataFrame, model: LanguageModel, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected."""
    configure(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            best, score, rejected = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    out = id_text(documents, id_col, text_col).mapInArrow(released(run), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(documents: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose prediction is not rejected."""
    configure(documents.sparkSession)
    place = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~model.predict(batch.column(place))[2]))

    return documents.mapInArrow(released(run), documents.schema)
