"""Benchmark decontamination by greedy string tiling.

Words are maximal runs of letters and digits, A-Z lowered. A text and an item that
share a run of ``seed_words`` words are a candidate pair; the longest non-overlapping
matches of the pair are then marked one after another, each found by Karp-Rabin
hashes of falling length (running Karp-Rabin greedy string tiling, Wise, 1993). The
covered share of the item's words decides, so a passage whose parts stand in another
order, or between other text, counts as fully as an unchanged one.

Seeds of items and of texts are tables that Spark joins; neither passes through the
driver. Where the benchmark's different seeds are few (``BROADCAST_SEEDS``, 8 bytes
each, counted first) every task gets them and hands on only the seeds of texts that an
item has too; beyond that all seeds of the texts take part in the join. A text hands a
seed on once, and pairs are made distinct before any text is read again, so a phrase
that very many texts and items share costs one row a text and item. Items with fewer
words than a seed are compared as one run of all their words. Null texts and items without words match
nothing. Rows with null or repeated ids each give their own rows; empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, configure, id_text, released, string_bytes
from .shingles import mix, word_hashes

BROADCAST_SEEDS = 4_000_000
_STEP = np.uint64(0xD6E8FEB86659FD93)
_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[0x30:0x3A] = np.arange(0x30, 0x3A)
_KEEP[0x41:0x5B] = np.arange(0x61, 0x7B)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 256)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in turn, and the first word of each."""
    raw, off = string_bytes(column)
    return word_hashes(_KEEP[raw], off)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` words, by doubling."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power = None, 0, h
    span, step = 1, _STEP
    while span <= size:  # binary digits of size, smallest first
        if size & span:
            part = power[have : have + n]
            out = part[:n].copy() if out is None else out * step + part
            have += span
        if 2 * span <= size:
            power = power[: len(power) - span] * step + power[span:]
            step = step * step + np.uint64(2)
        span *= 2
    return mix(out)


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (text start, item start, length): the longest match of unmarked
    words first, leftmost on ties, down to ``least`` words."""
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    size = min(len(text), len(item))
    while size >= least:
        runs_t, runs_i = _free(free_t, size), _free(free_i, size)
        found = False
        if len(runs_t) and len(runs_i):
            wt, wi = windows(text, size)[runs_t], windows(item, size)[runs_i]
            order = np.argsort(wi, kind="stable")
            at = np.searchsorted(wi[order], wt)
            hit = (at < len(wi)) & (wi[order][np.minimum(at, len(wi) - 1)] == wt)
            for k in np.flatnonzero(hit):
                a = int(runs_t[k])
                if not free_t[a : a + size].all():
                    continue
                for j in range(int(at[k]), len(wi)):
                    if wi[order[j]] != wt[k]:
                        break
                    b = int(runs_i[order[j]])
                    if free_i[b : b + size].all() and (text[a : a + size] == item[b : b + size]).all():
                        tiles.append((a, b, size))
                        free_t[a : a + size] = free_i[b : b + size] = False
                        found = True
                        break
        if found:
            continue  # a further match of this length may still be free
        size = _longest(text, item, free_t, free_i, least, size - 1)
    return sorted(tiles)


def _free(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` free words."""
    total = np.r_[0, np.cumsum(free)]
    return np.flatnonzero(total[size:] - total[:-size] == size) if size <= len(free) else np.zeros(0, np.int64)


def _longest(text, item, free_t, free_i, least: int, most: int) -> int:
    """Length of the longest common free run, at most ``most``; 0 under ``least``."""
    low, high = least - 1, most
    while low < high:
        size = (low + high + 1) // 2
        a, b = _free(free_t, size), _free(free_i, size)
        some = len(a) and len(b) and bool(np.isin(windows(text, size)[a], windows(item, size)[b]).any())
        low, high = (size, high) if some else (low, size - 1)
    return low if low >= least else 0


def _item_seeds(seed: int):
    """item, size, seed: the different seeds of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = words(batch.column(1))
            for item, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b > a:
                    found = np.unique(windows(h[a:b], min(b - a, seed)))
                    yield _seeds([item] * len(found), min(b - a, seed), found)

    return run


def _seeds(owner: list, size: int, found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.full(len(found), size, np.int32)), pa.array(found.view(np.int64))], ["item", "size", "seed"])


def _text_seeds(sizes: list[int], keys: dict[int, np.ndarray] | None):
    """doc_id, row, size, seed: the different seeds of every text, those in sorted
    ``keys`` only where these are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = words(batch.column(1))
            for size in sizes:
                w = windows(h, size)
                spot = np.arange(len(w))
                if keys is not None:
                    known = keys[size]
                    spot = np.flatnonzero(known[np.minimum(np.searchsorted(known, w), len(known) - 1)] == w)
                doc = np.searchsorted(first, spot, "right") - 1
                inside = spot + size <= first[doc + 1]
                pair = np.unique(np.stack([doc[inside].astype(np.uint64), w[spot[inside]]], 1), axis=0)
                owner = pa.array(pair[:, 0].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(2).take(owner), pa.array(np.full(len(pair), size, np.int32)), pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64))], ["doc_id", "row", "size", "seed"]
                )

    return run


def _tiles(coverage: float, least_words: int, schema: str):
    """Rows of one text and one item each, those of a text in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            rows = []
            for doc_id, text, row, item_id, item_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text != last:
                    last, known = text, words(pa.array([text]))[0]
                item = words(pa.array([item_text]))[0]
                tiles = tile(known, item, min(least_words, len(item)))
                covered = sum(n for *_, n in tiles)
                if covered >= coverage * len(item):
                    rows.append((doc_id, item_id, len(item), covered, len(tiles), covered / len(item), row))
            if rows:
                kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return run


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, coverage: float = 0.5, seed_words: int = 5, least_words: int = 3,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs whose tiles cover at least ``coverage`` of the item's words: doc_id,
    item_id, n_words (of the item), n_covered, n_tiles, coverage, row (the text's
    place among rows with its id: a hash of the text)."""
    spark = documents.sparkSession
    configure(spark)
    scratch = Scratch(spark, "leaks")
    docs = id_text(documents, id_col, text_col).withColumn("row", F.xxhash64("text")).where("text is not null")
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item_text"))
    items = scratch.save(items.where("item_text is not null"), "items")
    seeds = scratch.save(items.select("item", "item_text").mapInArrow(_item_seeds(seed_words), "item long, size int, seed long"), "seeds")
    distinct = scratch.save(seeds.select("size", "seed").distinct(), "distinct")
    counts = {r["size"]: r["count"] for r in distinct.groupBy("size").count().collect()}  # seed_words rows at most
    schema = "doc_id long, item_id long, n_words long, n_covered long, n_tiles long, coverage double, row long"
    if not counts:
        return spark.createDataFrame([], schema)
    keys = None
    if sum(counts.values()) <= BROADCAST_SEEDS:
        known = distinct.toArrow()
        size, seed = known["size"].to_numpy(), known["seed"].to_numpy().view(np.uint64)
        keys = {n: np.sort(seed[size == n]) for n in counts}
    hits = docs.select("doc_id", "text", "row").mapInArrow(released(_text_seeds(sorted(counts), keys)), "doc_id long, row long, size int, seed long")
    pairs = scratch.save(hits.join(seeds, ["size", "seed"]).select(F.col("doc_id").alias("own_id"), F.col("row").alias("own_row"), "item").distinct(), "pairs")
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row") == F.col("own_row"))
    met = docs.join(pairs, same).join(items, "item").select("doc_id", "text", "row", "item_id", "item_text")
    return met.mapInArrow(released(_tiles(coverage, least_words, schema)), schema)
