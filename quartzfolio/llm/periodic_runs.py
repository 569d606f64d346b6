"""Periodic runs of words by block matching, and texts with repeats collapsed.

A run is a stretch of words with a smallest period q, at least ``least`` words and two
periods long, which no neighbouring word extends with that period. Words are maximal
runs of bytes other than space, tab, line feed, vertical tab, form feed and return.

In a run of period d the words equal to the one d further on form a stretch of at least
max(d, least - d) words, which holds an aligned block of ``size`` words, size being the
largest power of two with 2 * size - 1 words in that stretch. So each distance has one
scale, and each scale an interval of distances. The aligned blocks of a scale are the
keys (sequences of word numbers) of an Aho-Corasick automaton, which reads the text
within reach of the blocks; an occurrence at a distance of the scale is a seed, and a
seed is extended word by word both ways until the words d apart differ. A block of
which some pair of words does not come again within reach can't be in a run and is no
key. A seed inside a run already known, at a multiple of its period, gives that run
again and is left out; so texts of one word repeated take no longer than others.

An automaton holds the blocks of at most ``CHUNK`` words (one block where that is
longer). A text is one unit of work: no other row takes part in its result.

Null text is empty text; texts without words have no runs and collapse to the empty
text. Null and repeated ids give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, id_text, released

#: Words whose blocks one automaton holds.
CHUNK = 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def scales(words: int, least: int) -> list[tuple[int, list[int]]]:
    """Block size and the distances it finds, up to half of ``words``, smallest block
    first; from max(least, 7) on, a scale's distances are an interval."""
    out: dict[int, list] = {}
    for d in range(1, min(words // 2, least) + 1):
        out.setdefault(1 << ((max(d, least - d) + 1) // 2).bit_length() - 1, []).append((d, d))
    d = least + 1
    while d <= words // 2:
        size = 1 << ((d + 1) // 2).bit_length() - 1
        out.setdefault(size, []).append((d, min(4 * size - 2, words // 2)))
        d = 4 * size - 1
    return sorted(out.items())


def _next_pair(w: np.ndarray) -> np.ndarray:
    """Words from each pair of neighbours to the next equal pair; all of them if none."""
    code = w[:-1] * (int(w.max()) + 1) + w[1:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    gap = np.full(len(code), len(w), np.int64)
    gap[order[:-1][same]] = np.diff(order)[same]
    return gap


def _blocks(gap: np.ndarray, words: int, size: int, nearest: int, reach: int) -> np.ndarray:
    """Aligned starts of blocks all of whose pairs come again within ``reach``."""
    starts = np.arange(0, max(0, words - size - nearest + 1), size)
    far = np.r_[0, np.cumsum(gap > reach)]
    return starts[far[starts + size - 1] == far[starts]]


def _occurrences(ids: list[int], starts: np.ndarray, size: int, spans: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distances and block starts of occurrences at the distances in ``spans``."""
    nearest, reach, step = spans[0][0], spans[-1][1], max(1, CHUNK // size)
    wide = len(ids) + 1
    for part in (starts[i : i + step] for i in range(0, len(starts), step)):
        keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        kinds = np.empty(len(part), np.int64)
        for i, b in enumerate(part.tolist()):
            key = tuple(ids[b : b + size])
            kinds[i] = keys.get(key, -1)
            if kinds[i] < 0:
                kinds[i] = i
                keys.add_word(key, i)
        keys.make_automaton()
        placed = np.sort(kinds * wide + part)
        edges = np.flatnonzero(part[1:] + nearest > part[:-1] + reach + size) + 1
        for stretch in np.split(part, edges):
            a, z = int(stretch[0]) + nearest, min(int(stretch[-1]) + reach + size, len(ids))
            met = np.fromiter(chain.from_iterable(keys.iter(tuple(ids[a:z]))), np.int64).reshape(-1, 2)
            at, kind = met[:, 0] + (a - size + 1), met[:, 1] * wide
            first, last = np.searchsorted(placed, kind + np.maximum(at - reach, 0)), np.searchsorted(placed, kind + np.maximum(at - nearest + 1, 0))
            many = np.maximum(last - first, 0)
            begin = placed[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())] % wide
            far = np.repeat(at, many) - begin
            good = np.zeros(len(far), bool)
            for low, high in spans:
                good |= (far >= low) & (far <= high)
            yield far[good], begin[good]


def _extend(w: np.ndarray, a: int, z: int, d: int) -> tuple[int, int]:
    """The widest stretch around [a, z) of words equal to those d further on."""
    step = 16
    while z + d < len(w):
        n = min(step, len(w) - d - z)
        differ = w[z : z + n] != w[z + d : z + d + n]
        if differ.any():
            z += int(differ.argmax())
            break
        z, step = z + n, 2 * step
    step = 16
    while a > 0:
        n = min(step, a)
        differ = (w[a - n : a] != w[a - n + d : a + d])[::-1]
        if differ.any():
            a -= int(differ.argmax())
            break
        a, step = a - n, 2 * step
    return a, z


def find_runs(ids: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of word numbers, by start and
    then period."""
    n = len(ids)
    if n < max(2, least):
        return []
    w = np.array(ids, np.int64)
    gap = _next_pair(w)
    if gap.min() > n // 2:
        return []
    found: dict[tuple[int, int], int] = {}
    end, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # of a known run over each word
    for size, spans in scales(n, least):
        reach = spans[-1][1]
        starts = _blocks(gap, n, size, spans[0][0], reach)
        if spans[0][0] > size:  # then all distances up to size are done, and a known run's period is its smallest
            starts = starts[(period[starts] > size) | (end[starts] < starts + reach + size)]
        for far, begin in _occurrences(ids, starts, size, spans):
            order = np.lexsort((begin, far))
            done = (0, 0)
            for d, b in zip(far[order].tolist(), begin[order].tolist(), strict=True):
                if (d == done[0] and b + size <= done[1]) or (end[b] >= b + d + size and d % period[b] == 0):
                    continue
                a, z = _extend(w, b, b + size, d)
                done = (d, z)
                if z - a + d >= max(least, 2 * d):
                    z += d
                    found[a, z] = min(d, found.get((a, z), d))
                    better = (end[a:z] < z) | ((end[a:z] == z) & (period[a:z] > d))
                    end[a:z][better], period[a:z][better] = z, d
    return sorted((a, z - a, d) for (a, z), d in found.items())


def keep_first_periods(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words but those that some run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _mapper(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()  # at ASCII white space, as bytes are
                numbers = dict.fromkeys(words)
                numbers.update(zip(numbers, count()))
                mine = find_runs(list(map(numbers.__getitem__, words)), least)
                sizes.append(len(words))
                runs.append(mine)
                texts.append(b" ".join(keep_first_periods(words, mine)))
            flat = np.array(list(chain.from_iterable(runs)), np.int64).reshape(-1, 3)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, rows), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    return run


def periodic_runs(documents: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period; word numbers from 0) and
    collapsed: the words outside the repeats of any run, joined by one space."""
    if least < 4:
        raise ValueError("a run has four words at least")
    configure(documents.sparkSession)
    return id_text(documents, id_col, text_col).mapInArrow(released(_mapper(least)), SCHEMA)


def plant(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: texts whose id's crc32 h is a multiple of 10 get a periodic end. With
    g = h / 10 and n words, each word i from a = g % n on becomes word a + (i - a) % p,
    p = 1 + (n - a) / (3 + g % 8), in whole numbers; the words are joined by one space.
    Other texts, and rows without an id, stay as they are."""
    docs = id_text(documents, id_col, text_col).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    chosen = docs.where("h % 10 = 0 and text is not null").withColumn("w", words).where("size(w) > 0").selectExpr("doc_id", "w", "size(w) as n", "h div 10 as g")
    chosen = chosen.selectExpr("doc_id", "w", "n", "cast(g % n as int) as a", "g").selectExpr("doc_id", "w", "n", "a", "cast(1 + (n - a) div (3 + g % 8) as int) as p")
    turned = chosen.selectExpr("doc_id", "array_join(transform(sequence(0, n - 1), i -> if(i < a, w[i], w[a + (i - a) % p])), ' ') as text")
    bare = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return docs.where(~(F.coalesce(F.col("h") % 10 == 0, F.lit(False)) & bare)).select("doc_id", "text").union(turned)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and digests per row."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
