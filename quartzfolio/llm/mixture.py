"""Mixing sources to target weights, in DataFrame functions only.

Sources in order (missing last) weigh ``weights``, repeating, and share ``share`` times
all words. No source gives more than ``epochs`` times its own words: its target stops
there and the excess goes to the others by weight, until none is above. That is one
level for all: a target is the smaller of the cap and the level times the weight, and
sources ordered by cap over weight give the level as a running maximum.

Within a source complete epochs come first; the rest is a sample of documents without
replacement by weight (Efraimidis and Spirakis, 2006): each row draws the exponential
key -ln(u) / quality, rows are sorted by their keys, and sizes are summed up to the
words still wanted; the row at the border gives what is left. u comes from a hash of
the id and the text, so reruns agree and any partitioning gives the same mix.

A source may hold most rows. Its rows are sorted in bands of the key's logarithm, whose
density is at most 1 / e whatever the qualities: with ``BAND_ROWS`` rows to a band the
bands grow in number with the rows, and sums before a band come from one row a band.

Null text has no words. Rows without an id take part; equal rows draw one key and stand
one after another. Empty tables give an empty result; sources without words have target
0 and give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of the largest band of a source's keys, about.
BAND_ROWS = 20_000
_WORD = r"[^\x20\x09-\x0D]+"


def letter_share(text: Column) -> Column:
    """A quality in [0.1, 1]: letters among the characters that aren't white space."""
    letters, seen = F.length(F.regexp_replace(text, r"\P{L}+", "")), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    return F.greatest(F.lit(0.1), F.when(seen > 0, letters / seen).otherwise(0.0))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """source, source_size, target: ``sizes`` has a row for each source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", epochs * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (F.sum("source_size").over(every) * F.lit(share) - past("cap")) / (F.sum("w").over(every) - past("w"))
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(
    documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 42, quality: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, quality, key, and taken: the
    words of it that the mix holds, repeats counted. ``quality`` is any positive column
    of ``documents``; the letters' share of the text if not given."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixture")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    drawn = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.sha2(text.cast("binary"), 256)).cast("binary"), 256)
    u = (F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"),
        (letter_share(text) if quality is None else quality.cast("double")).alias("quality"), u.alias("u"),
    )
    rows = scratch.save(rows.withColumn("key", -F.log("u") / F.col("quality")).drop("u"), "keys")
    steps = max(32, rows.count() // (3 * BAND_ROWS))
    rows = rows.withColumn("band", F.floor(F.log("key") * steps))
    bands = scratch.save(rows.groupBy("source", "band").agg(F.sum("size").alias("words")), "bands")
    wanted = F.floor(F.col("target") + 0.5)
    full = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0)
    aims = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    aims = aims.withColumn("full", full).withColumn("rest", wanted - F.col("full") * F.col("source_size"))
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("band")) - F.col("words")
    bands = bands.withColumn("ahead", ahead).alias("b").join(aims.alias("a"), F.col("a.source").eqNullSafe(F.col("b.source"))).drop(F.col("a.source"))
    met = rows.alias("r").join(bands.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.band") == F.col("b.band"))).drop(F.col("b.source"), F.col("b.band"))
    inside = Window.partitionBy("source", "band").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.col("ahead") + F.sum("size").over(inside) - F.col("size")
    part = F.least(F.greatest(F.col("rest") - gone, F.lit(0)), F.col("size"))
    out = met.withColumn("taken", (F.col("full") * F.col("size") + part).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "quality", "key", "taken")
