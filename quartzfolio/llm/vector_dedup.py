"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class first, numbered apart from any id. A pass gives every class a key of ``KEY_BITS``
random-hyperplane signs, orders all classes by key and compares each with the next
``window`` ones; at a border between partitions the last and first ``window`` rows
meet in a second step. What travels is a unit vector in single precision: a pair is
taken where its product clears ``least`` by more than the rounding. Verified pairs of all passes are united to components; a
pass hands on only a spanning forest of what it found, never all pairs of a group.

The passes alone may miss links, the more the denser the vectors lie. So a sweep
compares all classes, tile against tile of ``TILE_VALUES`` numbers, and adds each
link between components that no pass found: the result is exact for any ``passes``,
``window`` and number of partitions. Products are taken in single precision; what is
within their rounding error of ``least`` is taken again in double precision. The
sweep's products grow with the square of the classes, its rows only with the square
of the tiles.

Links are then counted exactly within components: members are split into blocks of
``BLOCK`` vectors and each pair of blocks is one matrix product, so no group is in
one task and no pair is a row.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; so do vectors of different lengths with each other. Rows without an id
stand alone and are kept. Rows that share an id and a vector count as copies; rows
that share an id but not a vector each get their own vector's links and component.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, configure, pack, partitions, unpack
from .components import connected_components

KEY_BITS, BLOCK = 63, 512
#: Numbers in a tile of the sweep, its rows compared at once, right tiles of a chunk.
TILE_VALUES, STRIP, CHUNK = 1 << 18, 512, 16
_PAIR = "a long, b long"


def _planes(d: int, one_pass: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, one_pass, d]).standard_normal((d, KEY_BITS))


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(1):
            v = np.array(x.as_py() or [], dtype=np.float64) if x.is_valid else np.zeros(0)
            out.append((v + 0.0).tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])


def _unit(vectors: list[bytes], d: int | None = None) -> np.ndarray:
    """Unit vectors, one a piece, or of length ``d`` from pieces of any size."""
    v = np.frombuffer(b"".join(vectors), np.float64).reshape(-1, d or len(vectors[0]) // 8)
    v = v / np.abs(v).max(1, keepdims=True)  # neither overflow nor underflow in the lengths
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _forest(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of ``pairs`` (positions in ``ids``)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in pairs.tolist():
        x, y = find(i), find(j)
        if x != y:
            parent[x] = y
            out.append((int(ids[i]), int(ids[j])))
    return out


def _slack(d: int) -> float:
    """What a product in single precision may be off, twice over."""
    return (d + 4) * 2.0**-23


def _close(vectors: list[bytes], window: int, least: float, split: int | None = None) -> np.ndarray:
    """Positions of neighbours at most ``window`` apart that are surely alike; with
    ``split``, only those on different sides of it."""
    unit, found = np.frombuffer(b"".join(vectors), "<f4").reshape(len(vectors), -1), []
    least += _slack(unit.shape[1])
    for step in range(1, min(window, len(unit) - 1) + 1):
        lo, hi = (0, len(unit) - step) if split is None else (max(0, split - step), min(split, len(unit) - step))
        if hi > lo:
            hit = np.flatnonzero(np.einsum("ij,ij->i", unit[lo:hi], unit[lo + step : hi + step]) >= least) + lo
            found.append(np.stack([hit, hit + step], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one length in tiles, with their ids' components; floats where no bit is lost."""
    held: dict[int, list[tuple[bytes, int]]] = {}
    count, part = 0, TaskContext.get().partitionId()

    def tile(d: int) -> pa.RecordBatch:
        nonlocal count
        vec, label = zip(*held.pop(d), strict=True)
        values = np.frombuffer(b"".join(vec), np.float64)
        with np.errstate(over="ignore", under="ignore"):
            short = values.astype("<f4")
        values = short if (short == values).all() else values
        count += 1
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part << 32 | count], pa.int64()), pa.array([pack(np.array(label, "<i8"), values)], pa.binary())], ["d", "tile", "payload"])

    for batch in batches:
        for v, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            d = len(v) // 8
            held.setdefault(d, []).append((v, label))
            if len(held[d]) * d >= TILE_VALUES:
                yield tile(d)
    for d in list(held):
        yield tile(d)


def _joining(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join different labels of two tiles, each (labels, unit vectors)."""
    names, own = np.unique(np.r_[left[0], right[0]], return_inverse=True)
    a, b = own[: len(left[0])], own[len(left[0]) :]
    d = left[1].shape[1]
    slack = _slack(d)
    x, y = left[1].astype(np.float32), right[1].astype(np.float32).T
    root, out = np.arange(len(names)), []
    for lo in range(0, len(a), STRIP):
        near = x[lo : lo + STRIP] @ y
        hit = near >= least - slack
        if not hit.any():
            continue
        hit &= root[a[lo : lo + STRIP]][:, None] != root[b][None, :]
        i, j = np.nonzero(hit)
        sure = near[i, j] >= least + slack
        unsure, step = np.flatnonzero(~sure), max(1, (1 << 22) // d)
        for k in range(0, len(unsure), step):
            at = unsure[k : k + step]
            sure[at] = np.einsum("ij,ij->i", left[1][lo + i[at]], right[1][j[at]]) >= least
        pairs = np.unique(np.stack([root[a[lo + i[sure]]], root[b[j[sure]]]], 1), axis=0)
        links = _forest(np.arange(len(names)), pairs)
        for u, v in links:
            u, v = root[u], root[v]
            out.append((int(names[u]), int(names[v])))
            root[root == max(u, v)] = min(u, v)
    return out


def _missed(tiles: DataFrame, parts: int, least: float) -> DataFrame:
    """Links (a, b) between components, from all tiles of one length compared with each other."""
    size = tiles.groupBy("d").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    names = tiles.select(F.col("d").alias("e"), F.col("tile").alias("own"))
    chunked = tiles.join(F.broadcast(size), "d")
    left = chunked.select("tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "payload", "d").withColumnRenamed("tile", "own")
    # Either tile of a pair may come to the other one: a hash decides, so all get alike many.
    low, high = F.least("tile", "own"), F.greatest("tile", "own")
    goes_to = F.when(F.pmod(F.xxhash64(low, high), F.lit(2)) == 0, low).otherwise(high)
    met = chunked.join(F.broadcast(names), (F.col("d") == F.col("e")) & (F.col("tile") != F.col("own")) & (goes_to == F.col("own")))
    right = met.select("own", F.pmod(F.xxhash64("tile"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "payload", "d")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for chunk, side, payload, d in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                label, values = unpack(payload)
                tile = label, _unit([values.astype(np.float64).tobytes()], d)
                if not side:
                    own = tile
                    if chunk:
                        continue
                links = _joining(own, tile, least)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links]), pa.array([x[1] for x in links])], ["a", "b"])

    dealt = left.union(right).repartition(parts, "own", "chunk").sortWithinPartitions("own", "chunk", "side")
    return dealt.mapInArrow(sweep, _PAIR).distinct()


def near_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, passes: int = 40, window: int = 40, passes_at_once: int = 8, seed: int = 11
) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id, kept."""
    spark = embeddings.sparkSession
    configure(spark)
    scratch, parts = Scratch(spark, "vectors"), partitions(spark)
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = scratch.save(rows.mapInArrow(_valid, "vec_id long, vec binary"), "rows")
    known = rows.where("vec_id is not null and vec is not null")
    classes = known.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("id"), "rep", "n", "vec"), "classes")

    def keyed(first: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vec, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                size = np.array([len(v) // 8 for v in vec])
                for d in np.unique(size):
                    own = np.flatnonzero(size == d)
                    unit = _unit([vec[i] for i in own])
                    column = pa.array([x.tobytes() for x in unit.astype("<f4")], pa.binary())
                    for p in range(first, min(first + passes_at_once, passes)):
                        bits = (unit @ _planes(d, p, seed) > 0).astype(np.int64)
                        key = (bits << np.arange(KEY_BITS - 1, -1, -1)).sum(1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p * 100_000 + min(d, 99_999)), pa.int64()), pa.array(key), pa.array(ids[own]), column], ["pass", "key", "id", "vec"])

        return run

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside a partition, and its first and last rows for its borders."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        own = TaskContext.get().partitionId()
        lane, ids, vec = table["pass"].to_numpy(), table["id"].to_numpy(), table["vec"].to_pylist()
        cuts = np.flatnonzero(np.r_[True, np.diff(lane) != 0, True])
        links, edges = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            links += _forest(ids[a:b], _close(vec[a:b], window, least))
            if a == 0 and own:
                edges += [(own - 1, 1, i, int(lane[i]), int(ids[i]), vec[i]) for i in range(min(window, b))]
            if b == len(lane):
                edges += [(own, 0, i, int(lane[i]), int(ids[i]), vec[i]) for i in range(max(a, b - window), b)]
        out = [(-1, 0, 0, 0, a, b, None) for a, b in links] + [(border, side, i, p, x, 0, v) for border, side, i, p, x, v in edges]
        if out:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["border", "side", "spot", "pass", "a", "b", "vec"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        table = table.sort_by([("border", "ascending"), ("side", "ascending"), ("spot", "ascending")])
        border, side, lane, ids, vec = (table[c].to_numpy(zero_copy_only=False) if c != "vec" else table[c].to_pylist() for c in ("border", "side", "pass", "a", "vec"))
        cuts = np.flatnonzero(np.r_[True, np.diff(border) != 0, True])
        links = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            split = int((side[a:b] == 0).sum())
            if 0 < split < b - a and lane[a] == lane[b - 1]:
                links += _forest(ids[a:b], _close(vec[a:b], window, least, split))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links]), pa.array([x[1] for x in links])], ["a", "b"])

    links = []
    for first in range(0, passes, passes_at_once):
        lanes = classes.select("vec", "id").mapInArrow(keyed(first), "pass long, key long, id long, vec binary")
        ordered = lanes.repartitionByRange(parts, "pass", "key", "id").sortWithinPartitions("pass", "key", "id")
        found = scratch.save(ordered.mapInArrow(windows, "border int, side int, spot long, pass long, a long, b long, vec binary"), "found", "none")
        edges = found.where("border >= 0").repartition(parts, "border").mapInArrow(borders, _PAIR)
        links.append(scratch.save(found.where("border < 0").select("a", "b").union(edges).distinct(), "links"))
        scratch.drop(found)
    every = links[0]
    for x in links[1:]:
        every = every.union(x)
    components = scratch.save(connected_components(every.distinct(), scratch), "components")

    # All tiles meet: links between components that no window held.
    labelled = classes.join(components, "id", "left").select("vec", F.coalesce("component", "id").alias("label"))
    values = classes.agg(F.sum(F.length("vec") / 8)).collect()[0][0] or 0
    tiles = scratch.save(labelled.repartition(max(1, math.ceil(values / TILE_VALUES))).mapInArrow(_tiles, "d int, tile long, payload binary"), "tiles", "none")
    missed = scratch.save(_missed(tiles, parts, least), "missed")
    scratch.drop(tiles)
    if missed.limit(1).count():
        components = scratch.save(connected_components(every.union(missed).distinct(), scratch), "components")

    # Exact counts: every pair of blocks of a component is one matrix product.
    members = classes.join(components, "id")
    blocks = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = members.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = members.select("component", F.col("own").alias("i"), other.alias("j"), F.lit(0).alias("side"), "id", "n", "vec")
    right = members.select("component", other.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "id", "n", "vec")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: one group of (component, i, j) after another."""
        held, key = [], None

        def count():
            side, ids, n = (np.array([r[k] for r in held]) for k in (0, 1, 2))
            unit = _unit([r[3] for r in held])
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                return None
            close = unit[a] @ unit[b].T >= least
            close &= ids[a][:, None] != ids[b][None, :]
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(close.astype(np.int64) @ n[b])], ["id", "links"])

        for batch in batches:
            for c, i, j, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, i, j) != key:
                    if held and (out := count()) is not None:
                        yield out
                    held, key = [], (c, i, j)
                held.append(row)
        if held and (out := count()) is not None:
            yield out

    dealt = left.union(right).repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "side")
    counts = dealt.mapInArrow(products, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    # A component's name is the least id among its classes'.
    named = classes.join(components, "id", "left")
    names = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("name"))
    labels = named.join(names, "component", "left").join(counts, "id", "left")
    labels = labels.select(F.col("vec").alias("key"), F.coalesce("name", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("vec"))).join(labels, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
