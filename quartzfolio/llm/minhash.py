"""Near-duplicate classes of texts by HyperMinHash, banding and exact confirmation.

Every text's word shingles are hashed once into ``BUCKETS`` buckets. A bucket keeps
its smallest value as a leading-zero count and ``MANTISSA`` bits (HyperMinHash, Yu
and Weber, 2017). An empty bucket borrows from the filled bucket that comes first
in a fixed random order of its own, so short texts have full sketches too and
registers still agree with the Jaccard similarity's probability. ``BANDS`` bands of
four registers give candidates; at similarity 0.75 a pair shares none with
probability (1 - 0.75**4)**64 < 3e-11.

Texts with one shingle set are one class first, numbered apart from any doc_id, so
exact copies of any number are one row from there on. A band's group of classes gives each class with the group's
first one and with its near neighbours in the order of their sketches, never all
pairs. Pairs whose collision-corrected estimate is six standard errors short are
dropped, the rest are confirmed on full shingle sets, and connected. The members of
groups that still hold more than one component are compared once more, block against
block: an upper bound from folded bit sets comes first, a full comparison where it
leaves hope, and only links that join two components are rows. So no link that
joins components is lost, and a group whose texts are nearly, but not quite, alike
makes no pairs; it costs comparisons within the group, spread over its blocks.

Null text has no words: an empty set, linked with nothing. Rows without an id stand
alone and are kept. Rows that share an id and a text are copies; rows that share an
id but not a text belong to the classes of their own texts, and no link of any of
them is lost. One output row per input row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, configure, id_text, pack, partitions, released, sweep, unpack
from .components import connected_components
from .shingles import mix, shingle_sets

BUCKETS, MANTISSA, BANDS = 256, 10, 64
#: Neighbours in sketch order that a class is paired with besides the group's first.
NEIGHBOURS = 2
#: Ids of candidate texts that go to every executor at most (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Bits a set is folded to for a bound, and sets in a block.
WIDE, BLOCK = 4096, 1500


def _fill_order() -> np.ndarray:
    """[i, b]: how soon bucket i would borrow from bucket b."""
    b = np.arange(BUCKETS, dtype=np.uint64)
    return mix((b[:, None] << np.uint64(32)) + b[None, :] + np.uint64(1)).astype(np.uint64)


_ORDER = _fill_order()


def registers(values: np.ndarray) -> tuple[np.ndarray, int]:
    """HyperMinHash registers of sorted distinct hashes; how many buckets were filled."""
    bucket = (values >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    least = values[first] << np.uint64(8) | np.uint64(1)
    zeros = 63 - np.frexp((least >> np.uint64(11)).astype(np.float64))[1] - 10
    zeros = np.clip(zeros, 0, 50).astype(np.uint64)
    mantissa = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    filled = bucket[first]
    out = np.empty(BUCKETS, np.uint16)
    out[filled] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    if len(filled) < BUCKETS:
        empty = np.setdiff1d(np.arange(BUCKETS), filled, assume_unique=True)
        out[empty] = out[filled[np.argmin(_ORDER[np.ix_(empty, filled)], 1)]]
    return out, len(filled)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for rows of registers."""
    wide = np.ascontiguousarray(regs).view("<u8")
    return mix(wide + mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(7)))


#: Chance that two different minima have one register: in each leading-zero class
#: (probability 2**-k) both fall there and share the mantissa bits.
_COLLISION = sum(4.0**-k for k in range(1, 52)) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for chance collisions."""
    share = (a == b).mean(1)
    return np.clip((share - _COLLISION) / (1 - _COLLISION), 0, 1)


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column(1), size)
        regs = [registers(s)[0].tobytes() if len(s) else None for s in sets]
        sigs = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(regs, pa.binary())],
            ["doc_id", "row", "n_shingles", "sig", "regs"],
        )


def _candidates(groups: int):
    """Band keys of classes, dealt to ``groups`` partitions by key."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(ids), BUCKETS)
            keys = band_keys(regs)
            spot = regs[:, :2].astype(np.uint32)
            spot = spot[:, 0] << np.uint32(16) | spot[:, 1]  # similar sketches stand close to each other
            flat, row = keys.ravel(), np.repeat(np.arange(len(ids)), BANDS)
            to = (flat % np.uint64(groups)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[by], np.arange(groups + 1))
            found = [(int(g), pack(flat[by[a:b]], ids[row[by[a:b]]], spot[row[by[a:b]]])) for g, a, b in zip(range(groups), cuts[:-1], cuts[1:], strict=True) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["part", "payload"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(p) for batch in batches for p in batch.column(1).to_pylist()]
        if not parts:
            return
        key, ids, spot = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        new = np.r_[True, np.diff(key[order]) != 0]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(key)])
        held = np.repeat(size > 1, size)
        own = order[held]  # members of groups with two classes or more
        group = (np.cumsum(new) - 1)[held]
        own = own[np.lexsort((ids[own], spot[own], group))]
        own_ids = ids[own]
        a, b, g, kind = [], [], [], []
        start = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(group) else np.zeros(0, np.int64)
        if len(own):
            count = np.diff(np.r_[start, len(own)])
            lead = np.repeat(np.minimum.reduceat(own_ids, start), count)
            a.append(lead), b.append(own_ids)
            for step in range(1, NEIGHBOURS + 1):
                same = group[step:] == group[:-step]
                a.append(np.minimum(own_ids[step:], own_ids[:-step])[same]), b.append(np.maximum(own_ids[step:], own_ids[:-step])[same])
            x, y = np.concatenate(a), np.concatenate(b)
            u = np.unique(np.stack([x, y], 1)[x < y], axis=0) if len(x) else np.zeros((0, 2), np.int64)
            yield _members(u[:, 0], u[:, 1], np.zeros(len(u), np.int64), 0)
            big = np.repeat(count > 3, count)  # smaller groups have all their pairs above
            yield _members(own_ids[big], own_ids[big], key[own][big].view(np.int64), 1)

    return deal, pair


def _members(a, b, key, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(key)], ["kind", "a", "b", "key"])


def _bits(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each set as WIDE bits, and how many of its shingles share a bit with another."""
    out = np.zeros((len(items), WIDE), bool)
    for i, x in enumerate(items):
        out[i, (x >> np.uint64(20)) & np.uint64(WIDE - 1)] = True
    packed = np.packbits(out, axis=1).view(np.uint64)
    return packed, np.array([len(x) for x in items]) - np.bitwise_count(packed).sum(1, dtype=np.int64)


def _meet(percent: int):
    """Links between components among the rows of one pair of blocks after another.

    A common shingle sets a common bit, so common bits and the shingles that hide
    behind another's bit bound an intersection; pairs within the bound are compared
    in full, and a component that was joined already is not compared again.
    """

    def links(held: list) -> list[tuple[int, int]]:
        side, ids, comp = (np.array([r[k] for r in held]) for k in (0, 1, 2))
        items = [np.frombuffer(r[3], "<u8") for r in held]
        n = np.array([len(x) for x in items])
        bits, hidden = _bits(items)
        right = np.flatnonzero(side == 1) if (side == 1).any() else np.arange(len(ids))
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for i in np.flatnonzero(side == 0).tolist():
            most = np.bitwise_count(bits[right] & bits[i]).sum(1, dtype=np.int64) + np.minimum(hidden[right], hidden[i])
            most = np.minimum(most, np.minimum(n[right], n[i]))
            for j in right[((100 + percent) * most >= percent * (n[right] + n[i])) & (comp[right] != comp[i])].tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x == y:
                    continue
                both = np.concatenate([items[i], items[j]])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (n[i] + n[j] - shared):
                    parent[x] = y
                    out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, found = [], None, []
        for batch in batches:
            for g, i, j, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (g, i, j) != key:
                    found += links(held) if held else []
                    held, key = [], (g, i, j)
                held.append(row)
        found += links(held) if held else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], ["a", "b"])

    return run


def _hopeful(least: float):
    """Keeps pairs whose estimate is at most six standard errors short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, BUCKETS) for i in (2, 3))
            n = np.minimum(batch.column(4).to_numpy(), batch.column(5).to_numpy())
            margin = 6 * np.sqrt(least * (1 - least) / np.minimum(n, BUCKETS / 2))
            sizes = n >= least * np.maximum(batch.column(4).to_numpy(), batch.column(5).to_numpy())
            keep = pa.array((estimate(x, y) >= least - margin) & sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, left = [], None, None
            for p, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if p != last:
                    last, left = p, np.frombuffer(x.as_buffer(), "<u8")
                right = np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([left, right])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * shared >= percent * (len(left) + len(right) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keep], ["a", "b", "linked"])

    return run


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 75
) -> DataFrame:
    """Per row: doc_id, row (xxhash64 of the text), n_shingles, component_id (least
    id reachable), kept."""
    if not 75 <= percent <= 100:
        raise ValueError("the bands are laid out for similarities of 75 percent or more")
    spark = documents.sparkSession
    configure(spark)
    scratch, groups, least = Scratch(spark, "minhash"), partitions(spark), percent / 100
    docs = id_text(documents, id_col, text_col).withColumn("row", F.xxhash64("text"))
    deal, pair = _candidates(groups)

    schema = "doc_id long, row long, n_shingles long, sig binary, regs binary"
    sketch = scratch.save(docs.mapInArrow(released(lambda b: _sketch(b, shingle_words)), schema), "sketch")
    own = sketch.where("doc_id is not null and sig is not null")
    # One row a class: its number, its least row, and its sketch.
    first = own.groupBy("sig").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    first = first.select(F.monotonically_increasing_id().alias("id"), F.col("least.doc_id").alias("rep"), F.col("least.row").alias("row"), "n_shingles", "sig", "regs")
    classes = scratch.save(first, "classes")
    found = classes.select("id", "regs").mapInArrow(released(deal), "part int, payload binary").repartitionById(groups, "part")
    found = scratch.save(found.mapInArrow(released(pair), "kind int, a long, b long, key long"), "found")

    def build(batches):
        for batch in batches:
            values = [s.tobytes() for s in shingle_sets(batch.column(1), shingle_words)]
            keep = pa.array([hashlib.blake2b(v, digest_size=16).digest() == s for v, s in zip(values, batch.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(values, pa.binary()).filter(keep)], ["id", "items"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(id, items): the full shingle sets of these classes, from their least rows' texts."""
        wanted = scratch.save(classes.select("id", F.col("rep").alias("doc_id"), "row", "sig").join(wanted, "id", "left_semi"), "wanted")
        if wanted.count() <= BROADCAST_IDS:  # else a shuffle join, of all texts
            wanted = F.broadcast(wanted)
        texts = docs.join(wanted, ["doc_id", "row"]).select("id", "text", "sig")
        return scratch.save(texts.mapInArrow(released(build), "id long, items binary").dropDuplicates(["id"]), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of the pairs whose estimate leaves hope, on full sets."""
        side = classes.select("id", "regs", "n_shingles")
        left, right = (side.select(F.col("id").alias(k), F.col("regs").alias(f"r{k}"), F.col("n_shingles").alias(f"n{k}")) for k in "ab")
        hope = pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(released(_hopeful(least)), "a long, b long")
        hope = scratch.save(hope, "hope")
        sets = sets_of(hope.select(F.col("a").alias("id")).union(hope.select(F.col("b").alias("id"))).distinct())
        done = hope.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        done = scratch.save(done.select("a", "b", "x", "y").mapInArrow(released(_confirm(percent)), "a long, b long, linked boolean"), "done")
        scratch.drop(hope, sets)
        return done

    tried = confirm(found.where("kind = 0").select("a", "b").distinct())
    sweep(spark)
    parts = connected_components(tried.where("linked").select("a", "b"), scratch)

    # Groups that still hold several components: pairs across them, not tried yet.
    members = found.where("kind = 1").select("key", F.col("a").alias("id"))
    members = members.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    torn = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    torn = scratch.save(members.join(torn, "key"), "torn")
    # The members of such groups, and of groups that share members, meet in blocks.
    tied = connected_components(torn.withColumn("lead", F.min("id").over(Window.partitionBy("key"))).select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), scratch)
    members = torn.select("id", F.col("component").alias("comp")).distinct().join(tied.withColumnRenamed("component", "tie"), "id")
    count = members.groupBy("tie").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = scratch.save(members.join(count, "tie").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "members")
    rows = members.join(sets_of(members.select("id")), "id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("tie", "own", other, "id", "comp", "items")
    low = F.least("own", "other")  # each pair of blocks once: the lower block's rows on side 0
    rows = rows.select("tie", low.alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > low).cast("int").alias("side"), "id", "comp", "items")
    rows = rows.repartition(groups, "tie", "i", "j").sortWithinPartitions("tie", "i", "j")
    more = scratch.save(rows.mapInArrow(released(_meet(percent)), "a long, b long"), "more")
    every = tried.where("linked").select("a", "b").union(more)
    parts = connected_components(every, scratch)

    # A component's name is the least id among its classes'.
    named = classes.select("id", "sig", "rep").join(parts, "id", "left")
    names = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("name"))
    labels = named.join(names, "component", "left").select("sig", F.coalesce("name", "rep").alias("component_id"))
    out = sketch.select("doc_id", "row", "n_shingles", "sig").join(labels, "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
