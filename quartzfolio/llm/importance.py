"""Importance resampling toward a target by hashed word runs.

Features of a text are its runs of 1 to ``n`` consecutive words, joined by one space,
repeats counted; words are runs of letters, digits and characters beyond ASCII, A-Z
lowered. A feature's bucket is the crc32 of its bytes modulo the number of buckets. One
scan of a text keeps a ring of the running zlib states of the last ``n`` starts: each
word extends every state by a space and itself and opens a new one, and all states of
the ring are buckets of features. The sorted buckets of a row are kept as differences
in a table, so texts are read once.

Each bucket's gain is floor(1000 * ln) of its smoothed share in the target over that in
the documents. A row's weight is the sum of its gains, its score the weight plus a
Gumbel number (in thousandths) from a hash of its id: the rows with the highest scores
are a sample without replacement by exp(weight / 1000). Ranks come from a table dealt
by ranges of the score, with each range's count before it; so no task holds more than
a range, however the scores lie.

Bucket counts, gains and the number of rows to draw are all that the driver holds
(``buckets`` numbers). Null text has no words. A missing id hashes as an empty one.
Rows that share an id get each their own weight; of equal scores the smaller id comes
first, a missing id last, then the smaller weight. Empty tables give empty results; an
empty target has even shares.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, configure, id_text, partitions, released

#: Characters of words, A-Z lowered; all others are spaces.
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
FEATURES = "doc_id long, n_words long, n_features long, steps binary"


def buckets_of(words: list[bytes], n: int, buckets: int) -> list[int]:
    """Buckets of all runs of 1 to ``n`` words, by the word that ends them."""
    crc, out, ring = zlib.crc32, [], []
    add = out.extend
    for word in words:
        more = b" " + word
        ring = [crc(more, state) for state in ring[1 - n :]] if n > 1 else []
        ring.append(crc(word))
        add(ring)
    return [x % buckets for x in out]


def _scan(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, many, steps = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").translate(_KEEP).split()
                found = np.sort(np.array(buckets_of(words, n, buckets), np.int64))
                sizes.append(len(words))
                many.append(len(found))
                steps.append(np.diff(found, prepend=0).astype("<u4" if buckets > 1 << 16 else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(many, pa.int64()), pa.array(steps, pa.binary())], ["doc_id", "n_words", "n_features", "steps"])

    return run


def hashed_features(documents: DataFrame, n: int = 3, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_features, steps (differences of its sorted buckets)."""
    configure(documents.sparkSession)
    return id_text(documents, id_col, text_col).mapInArrow(released(_scan(n, buckets)), FEATURES)


def _unstep(data: bytes, buckets: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4" if buckets > 1 << 16 else "<u2"), dtype=np.int64)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket; a task hands on one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                np.add.at(total, _unstep(data, buckets), 1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("steps").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the source."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in pairs], np.int64)


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[_unstep(data, len(gain))].sum()) for data in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return run


def ranked(rows: DataFrame, order: list, scratch: Scratch) -> DataFrame:
    """``rows`` with ``place``, 1 for the first in ``order``: rows are dealt by ranges of
    the order and written, places count on from the ranges before."""
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("part", F.spark_partition_id())
    dealt = scratch.save(dealt, "ranges")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("inside", inside).join(before, "part").withColumn("place", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def resample(
    documents: DataFrame, target: DataFrame, n: int = 3, buckets: int = 10_000, percent: int = 5, min_words: int = 20, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_features, weight, score and rank: 1 for the highest score of the
    floor(percent * N / 100) rows drawn of the N with ``min_words`` words; null for all others."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "importance")
    features = scratch.save(hashed_features(documents, n, buckets, id_col, text_col), "features")
    wanted = hashed_features(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), n, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    weighed = features.mapInArrow(released(_weights(gain)), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise)
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc()]
    placed = ranked(scored.withColumn("may", F.col("n_words") >= min_words), order, scratch)
    drawn = features.where(F.col("n_words") >= min_words).count() * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
