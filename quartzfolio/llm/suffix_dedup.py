"""Exact repeated-passage removal through a collection BWT built column by column.

Every window of ``match_bytes`` bytes is routed by its content: the window's
minimiser (its smallest hashed ``anchor_bytes``-gram, the leftmost on ties)
depends on the window alone, so equal windows meet in one bucket. Runs of windows
with one minimiser travel together as a segment of fewer than
``2 * match_bytes`` bytes. Only segments whose anchor occurs in at least two
documents travel at all, each once per block of documents; a passage that a third
of the corpus holds is one row per block, never one per document.

In a bucket, :class:`CollectionBwt` builds the Burrows-Wheeler transform and the
longest-common-prefix array of the distinct segments by inserting one symbol per
segment in each round; both live in files that a round reads and writes in
sequence. Suffixes whose common prefix reaches ``match_bytes`` form one class, the
class's smallest document goes back to the blocks, and a byte is removed when a
window over it has an earlier document than its own.

Null text is empty text. Rows without an id keep all their bytes and are no source.
Repeated ids are not smaller than each other, so they never remove each other's
bytes. One output row per input row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, configure, id_text, pack, partitions, string_bytes, sweep, unpack

#: Bytes of text in a block and of windows hashed at once, and segments in one BWT:
#: they bound memory, not results.
BLOCK_BYTES, PIECE, BWT_SEGMENTS = 4 << 20, 1 << 17, 4_000
#: Different segments of one anchor beyond which their windows go into collections by
#: content, so that a phrase in very many contexts needs no more memory than others.
HOT_SEGMENTS = 32_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class CollectionBwt:
    """BWT and LCP of a collection, one symbol per text and round (Bauer, Cox and
    Rosone, 2013; common prefixes as Cox et al., 2016), kept in two files.

    ``columns`` is right-aligned: byte + 1, and 0 left of a text's first byte, so
    that 0 is the end mark. After ``build``, ``bwt`` and ``lcp`` read the files.
    """

    def __init__(self, columns: np.ndarray, lengths: np.ndarray, folder: str):
        self.columns, self.lengths, self.folder = columns, lengths, folder
        self.n_texts = len(lengths)

        self.files = [[open(f"{folder}/{name}.{i}", "w+b", 0) for i in (0, 1)] for name in ("bwt", "lcp")]  # noqa: SIM115
        self.size = 0

    def _put(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        """The next round's files, written in sequence beside the last round's."""
        for pair, data in zip(self.files, (bwt, lcp), strict=True):
            pair.reverse()
            pair[0].seek(0)
            pair[0].write(data)
        self.size = len(bwt)

    def _get(self, which: int) -> np.ndarray:
        self.files[which][0].seek(0)
        return np.fromfile(self.files[which][0], np.uint8, self.size)

    @property
    def bwt(self) -> np.ndarray:
        return self._get(0)

    @property
    def lcp(self) -> np.ndarray:
        return self._get(1)

    def close(self) -> None:
        for file in (f for pair in self.files for f in pair):
            file.close()

    def build(self) -> CollectionBwt:
        m, width = self.columns.shape
        # Texts by falling length: those still growing are always the first ones.
        self.by_length = np.argsort(-self.lengths.astype(np.int64), kind="stable")
        texts = np.ascontiguousarray(self.columns[self.by_length].T)
        lengths = self.lengths[self.by_length]
        at = np.arange(m)
        self._put(texts[width - 1], np.zeros(m, np.uint8))
        for j in range(1, int(lengths[0]) + 1 if m else 1):
            active = int(np.searchsorted(-lengths.astype(np.int64), -j, "right"))
            bwt, lcp = self.bwt, self.lcp
            n = len(bwt)
            order = np.argsort(bwt, kind="stable")
            rank = np.empty(n, np.int32)
            rank[order] = np.arange(n, dtype=np.int32)
            y = at[:active]
            r = rank[y]
            ended = int(np.count_nonzero(bwt == 0))
            symbol = bwt[y]
            before, after = order[r - 1], order[np.minimum(r + 1, n - 1)]
            has_before = (r > 0) & (bwt[before] == symbol)
            has_after = (r + 1 < n) & (bwt[after] == symbol)
            least = _range_min(lcp)
            new_lcp = np.zeros(active, np.uint8)
            new_lcp[has_before] = 1 + least(before[has_before] + 1, y[has_before])
            next_lcp = 1 + least(y[has_after] + 1, after[has_after])
            to = m + r.astype(np.int64) - ended
            old = np.ones(n + active, bool)
            old[to] = False
            new_bwt, merged = np.empty(n + active, np.uint8), np.empty(n + active, np.uint8)
            new_bwt[old], merged[old] = bwt, lcp
            new_bwt[to] = texts[width - 1 - j, :active] if j < width else 0
            merged[to] = new_lcp
            merged[to[has_after] + 1] = next_lcp
            self._put(new_bwt, merged)
            at = to
        return self

    def positions(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Walks the finished BWT: (suffix length, texts, places of their suffixes)."""
        bwt = self.bwt
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int32)
        rank[order] = np.arange(len(bwt), dtype=np.int32)
        ended = int(np.count_nonzero(bwt == 0))
        lengths = self.lengths[self.by_length]
        at = np.arange(self.n_texts)
        for j in range(1, int(lengths[0]) + 1 if len(lengths) else 1):
            active = int(np.searchsorted(-lengths.astype(np.int64), -j, "right"))
            at = self.n_texts + rank[at[:active]].astype(np.int64) - ended
            yield j, self.by_length[:active], at


def _range_min(values: np.ndarray):
    """Minimum over [lo, hi] for arrays of bounds, from doubling tables."""
    n = len(values)
    table = np.empty((n.bit_length(), n), np.uint8)
    table[0] = values
    for level in range(1, len(table)):
        span, size = 1 << (level - 1), n - (1 << level) + 1
        np.minimum(table[level - 1, :size], table[level - 1, span : span + size], out=table[level, :size])
    flat = table.reshape(-1)

    def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        size = hi - lo + 1
        level = np.frexp(size.astype(np.float32))[1].astype(np.int64) - 1
        level -= np.left_shift(1, level) > size  # a size rounded up to a power of two
        at = level * n
        return np.minimum(flat[at + lo], flat[at + hi + 1 - np.left_shift(1, level)])

    return least


def window_minima(segments: np.ndarray, lengths: np.ndarray, owner: np.ndarray, match: int) -> np.ndarray:
    """For each segment and window start, the least owner of that window's bytes.

    ``segments`` holds bytes, left-aligned and zero-padded. Windows beyond a
    segment's end keep the largest integer.
    """
    m, width = segments.shape
    spots = np.arange(width) - (width - lengths.astype(np.int64))[:, None]
    columns = np.where(spots >= 0, np.take_along_axis(segments, np.maximum(spots, 0), 1) + np.uint8(1), np.uint8(0))
    most = np.iinfo(np.int64).max
    out = np.full((m, max(width - match + 1, 0)), most, np.int64)
    with tempfile.TemporaryDirectory() as folder:
        built = CollectionBwt(columns, lengths, folder).build()
        starts = np.flatnonzero(built.lcp < match)
        group = np.zeros(len(built.bwt), np.int32)
        group[starts] = 1
        group = np.cumsum(group) - 1
        least = np.full(len(group), most, np.int64)
        walk = [(j, texts, at) for j, texts, at in built.positions() if j >= match]
        for _, texts, at in walk:
            least[at] = owner[texts]
        least = np.minimum.reduceat(least, starts)
        for j, texts, at in walk:
            out[texts, lengths[texts].astype(np.int64) - j] = least[group[at]]
        built.close()
    return out


def bounded_minima(segments: np.ndarray, lengths: np.ndarray, owner: np.ndarray, match: int) -> np.ndarray:
    """``window_minima`` for any number of segments: beyond ``HOT_SEGMENTS`` each window is
    a text of its own, and equal ones, whose hash is one, share a collection."""
    m, width = segments.shape
    if m <= HOT_SEGMENTS:
        return window_minima(segments, lengths, owner, match)
    columns = width - match + 1
    windows = lengths.astype(np.int64) - match + 1
    groups = -(-int(windows.sum()) // HOT_SEGMENTS)
    padded = np.concatenate([segments, np.zeros((m, -match % 8), np.uint8)], axis=1)

    def cut(seg: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        data = padded[seg[:, None], col[:, None] + np.arange(match + -match % 8)]
        data[:, match:] = 0
        return data[:, :match], _pair_hash(data, np.full(len(seg), match))

    group = np.full((m, columns), groups, np.uint32)
    for c in range(columns):
        for lo in range(0, m, PIECE):
            own = lo + np.flatnonzero(windows[lo : lo + PIECE] > c)
            if len(own):
                group[own, c] = cut(own, np.full(len(own), c))[1][0] % np.uint64(groups)
    order = np.argsort(group, axis=None, kind="stable")
    edges = np.searchsorted(group.ravel()[order], np.arange(groups + 1))
    out = np.full((m, columns), np.iinfo(np.int64).max, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        seg, col = np.divmod(order[a:b], columns)
        data, key = cut(seg, col)
        by = np.lexsort((key[1], key[0]))
        new = np.r_[True, (key[0][by][1:] != key[0][by][:-1]) | (key[1][by][1:] != key[1][by][:-1])] if len(by) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        if len(first):
            least = window_minima(data[by[first]], np.full(len(first), match), np.minimum.reduceat(owner[seg][by], first), match)[:, 0]
            out[seg[by], col[by]] = least[np.cumsum(new) - 1]
    return out


def runs_of(text: np.ndarray, off: np.ndarray, match: int, gram: int):
    """Runs of windows with one anchor: (document, first window, windows, hash)."""
    out: list[tuple[np.ndarray, ...]] = []
    n_all = len(text)
    long = np.flatnonzero(np.diff(off) >= match)
    for lo in range(0, n_all, PIECE):
        n = min(lo + PIECE, n_all - match + 1) - lo  # windows that start here
        if n <= 0:
            break
        valid = np.zeros(n + 1, np.int32)
        first, last = np.clip(off[long] - lo, 0, n), np.clip(off[long + 1] - match + 1 - lo, 0, n)
        np.add.at(valid, first, 1)
        np.add.at(valid, last, -1)
        where = np.flatnonzero(np.cumsum(valid[:n]))
        if not len(where):
            continue
        size = n + match - gram  # anchors that may start here
        piece = np.concatenate([text[lo : lo + n + match - 1], np.zeros(16, np.uint8)])
        words = np.ndarray((size + gram,), "<u8", piece.data, 0, (1,)).copy()
        h = words[:size] * _ODD[0]
        for i in range(8, gram - 7, 8):
            h += words[i : i + size] * _ODD[1 + i // 8 % 2]
        if gram % 8:
            h += words[gram - 8 : gram - 8 + size] * _ODD[3]
        h ^= h >> np.uint64(29)
        h *= _ODD[2]
        h ^= h >> np.uint64(32)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(size, dtype=np.uint64)
        span, wide = 1, match - gram + 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[:n], least[wide - span : wide - span + n])
        at = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)[where]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1)])
        count = np.diff(np.r_[new, len(where)])
        begin = where[new] + lo
        out.append((np.searchsorted(off, begin, "right") - 1, begin, count, h[at[new]]))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _distinct(h: np.ndarray, doc: np.ndarray):
    """Distinct hashes in order, and whether two documents of the block hold each."""
    order = np.argsort(h, kind="stable")
    sorted_h, sorted_doc = h[order], doc[order]
    first = np.flatnonzero(np.r_[True, sorted_h[1:] != sorted_h[:-1]]) if len(h) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(h)] - 1 if len(h) else first
    return sorted_h[first], sorted_doc[first] != sorted_doc[last]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, ids, lens, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

    def flush():
        data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        row = pack(np.concatenate(ids), np.concatenate(lens), data)
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([row], pa.binary())], ["block", "payload"])

    for batch in batches:
        raw, off = string_bytes(batch.column(1))
        doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(doc):
            to = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK_BYTES - size, "right")) - 1)
            ids.append(doc[at:to])
            lens.append(np.diff(off[at : to + 1]))
            texts.append(raw[off[at] : off[to]])
            size += int(off[to] - off[at])
            at = to
            if size >= BLOCK_BYTES or at < len(doc):
                yield flush()
                seq, ids, lens, texts, size = seq + 1, [], [], [], 0
    if ids:
        yield flush()


def _rows(found: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names)


def _load(payload: bytes):
    ids, lens, text = unpack(payload)
    return ids, np.r_[0, np.cumsum(lens)].astype(np.int64), text


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", match_bytes: int = 50, anchor_bytes: int = 20
) -> DataFrame:
    """Per row: id, bytes, bytes removed, removed runs, SHA-256 and text that is left.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of
    start and end byte pairs, flattened).
    """
    if not 8 <= anchor_bytes <= match_bytes or match_bytes > 120:
        raise ValueError("8 <= anchor_bytes <= match_bytes <= 120")
    spark = documents.sparkSession
    configure(spark)
    scratch, buckets = Scratch(spark, "suffix"), partitions(spark)
    docs = id_text(documents, id_col, text_col)
    blocks = scratch.save(docs.where("doc_id is not null").mapInArrow(_blocks, "block long, payload binary"), "blocks", "none")

    def anchors(batches):
        for batch in batches:
            for block, payload in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                _, off, text = _load(payload)
                doc, _, _, h = runs_of(text, off, match_bytes, anchor_bytes)
                h, many = _distinct(h, doc)
                to = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                mark = h // np.uint64(buckets)
                found = []
                for b in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[b] : cuts[b + 1]]
                    x = mark[own]
                    found.append((int(b), block, pack((x & np.uint64(0xFFFFFFFF)).astype("<u4"), (x >> np.uint64(32)).astype(np.uint8), np.packbits(many[own]))))
                if found:
                    yield _rows(found, [pa.int32(), pa.int64(), pa.binary()], ["bucket", "block", "payload"])

    def shared(batches):
        owners, marks, flags = [], [], []
        for batch in batches:
            for bucket, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                low, high, many = unpack(payload)
                owners.append((bucket, block, len(low)))
                marks.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32) | np.uint64(bucket) << np.uint64(40))
                flags.append(np.unpackbits(many, count=len(low)))
        if not owners:
            return
        mark, flag = np.concatenate(marks), np.concatenate(flags)
        order = np.argsort(mark)
        first = np.flatnonzero(np.r_[True, np.diff(mark[order]) != 0])
        size = np.diff(np.r_[first, len(mark)])
        hit = (size > 1) | (np.maximum.reduceat(flag[order], first) > 0)
        out = np.empty(len(mark), bool)
        out[order] = np.repeat(hit, size)
        cuts = np.r_[0, np.cumsum([n for _, _, n in owners])]
        yield _rows([(block, bucket, np.packbits(out[a:b]).tobytes()) for (bucket, block, _), a, b in zip(owners, cuts[:-1], cuts[1:], strict=True)], [pa.int64(), pa.int32(), pa.binary()], ["block", "bucket", "bits"])

    def segments(batches):
        width = 2 * match_bytes - anchor_bytes
        width += -width % 8
        for batch in batches:
            for block, payload, bits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, off, text = _load(payload)
                doc, begin, count, h = runs_of(text, off, match_bytes, anchor_bytes)
                marks, _ = _distinct(h, doc)
                to = (marks % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                keep = np.zeros(len(marks), bool)
                for x in bits:
                    own = order[cuts[x["bucket"]] : cuts[x["bucket"] + 1]]
                    keep[own] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=len(own)).astype(bool)
                pick = np.flatnonzero(keep[np.searchsorted(marks, h)])
                if not len(pick):
                    continue
                doc, begin, count, h = doc[pick], begin[pick], count[pick], h[pick]
                size = count + match_bytes - 1
                padded = np.concatenate([text, np.zeros(width, np.uint8)])
                data = np.ndarray((len(padded) - width + 1, width), np.uint8, padded.data, 0, (1, 1))[begin]
                data[np.arange(width) >= size[:, None]] = 0
                key = _pair_hash(data, size)
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((key[1], key[0], bucket))
                new = np.r_[True, (key[0][order][1:] != key[0][order][:-1]) | (key[1][order][1:] != key[1][order][:-1]) | (bucket[order][1:] != bucket[order][:-1])]
                first = np.flatnonzero(new)
                segment = np.empty(len(order), np.int64)
                segment[order] = np.cumsum(new) - 1
                rep = order[first]
                owner = ids[doc]
                low, high = np.minimum.reduceat(owner[order], first), np.maximum.reduceat(owner[order], first)
                own_bucket = bucket[rep]
                cuts = np.searchsorted(own_bucket, np.arange(buckets + 1))
                found = [(int(block % buckets), 1, block, pack(doc.astype("<u4"), begin.astype("<u8"), segment.astype("<u4"), cuts.astype("<u4")))]
                sub = ((h[rep] // np.uint64(buckets)) >> np.uint64(8) & np.uint64(0xFFFF)).astype("<u2")
                for b in np.flatnonzero(np.diff(cuts)):
                    at = slice(cuts[b], cuts[b + 1])
                    one = rep[at]
                    flat = data[one][np.arange(width) < size[one][:, None]]
                    found.append((int(b), 0, block, pack(size[one].astype(np.uint8), sub[at], low[at], high[at], flat)))
                yield _rows(found, [pa.int32(), pa.int32(), pa.int64(), pa.binary()], ["bucket", "kind", "block", "payload"])

    def classes(batches):
        parts, width = [], 2 * match_bytes - anchor_bytes
        width += -width % 8
        for batch in batches:
            for bucket, kind, block, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind:
                    yield _rows([(block, bucket, 1, payload)], [pa.int64(), pa.int32(), pa.int32(), pa.binary()], ["block", "bucket", "kind", "payload"])
                else:
                    parts.append((block, bucket, *unpack(payload)))
        if not parts:
            return
        sizes = np.concatenate([p[2] for p in parts])
        sub = np.concatenate([p[3] for p in parts])
        low, high = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
        ends = np.cumsum(sizes.astype(np.int64))
        flat = np.concatenate([*(p[6] for p in parts), np.zeros(width, np.uint8)])
        starts = ends - sizes
        part = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
        ordinal = np.arange(len(sizes)) - np.repeat(np.cumsum([0] + [len(p[2]) for p in parts[:-1]]), [len(p[2]) for p in parts])
        view = np.ndarray((len(flat) - width + 1, width), np.uint8, flat.data, 0, (1, 1))
        out: list[list[tuple]] = [[] for _ in parts]
        by_sub = np.argsort(sub, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(sub[by_sub]) != 0, True])
        at = 0
        while at < len(edges) - 1:  # whole sub-buckets, about BWT_SEGMENTS together
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + BWT_SEGMENTS, "right")) - 1)
            own = by_sub[edges[at] : edges[to]]
            at = to
            data = view[starts[own]]
            data[np.arange(width) >= sizes[own][:, None]] = 0
            key = _pair_hash(data, sizes[own])
            order = np.lexsort((key[1], key[0]))
            new = np.r_[True, (key[0][order][1:] != key[0][order][:-1]) | (key[1][order][1:] != key[1][order][:-1])]
            first = np.flatnonzero(new)
            segment = np.empty(len(own), np.int64)
            segment[order] = np.cumsum(new) - 1
            rep = order[first]
            least = bounded_minima(data[rep], sizes[own][rep], np.minimum.reduceat(low[own][order], first), match_bytes)
            mine = least[segment]
            useful = mine < high[own][:, None]  # a later document of the block loses bytes
            begin = useful.copy()
            begin[:, 1:] &= ~useful[:, :-1] | (mine[:, 1:] != mine[:, :-1])
            row, col = np.nonzero(begin)
            stop = useful.copy()
            stop[:, :-1] &= ~useful[:, 1:] | (mine[:, 1:] != mine[:, :-1])
            end = np.nonzero(stop)[1] + 1
            if len(row):
                whose = part[own[row]]
                by = np.argsort(whose, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(whose[by]) != 0, True])
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    x = by[a:b]
                    out[whose[x[0]]].append((ordinal[own[row[x]]], col[x], end[x] - col[x], mine[row[x], col[x]]))
        for (block, bucket, *_), found in zip(parts, out, strict=True):
            if found:
                o, c, n, d = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _rows([(block, bucket, 0, pack(o.astype("<u4"), c.astype(np.uint8), n.astype(np.uint8), d))], [pa.int64(), pa.int32(), pa.int32(), pa.binary()], ["block", "bucket", "kind", "payload"])

    def cut(batches):
        for batch in batches:
            for payload, found in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                ids, off, text = _load(payload)
                mask = np.zeros(len(text), bool)
                place = next((unpack(x["payload"]) for x in found or () if x["kind"]), None)
                runs = [(x["bucket"], *unpack(x["payload"])) for x in found or () if not x["kind"]]
                if place and runs:
                    doc, begin, segment, cuts = place
                    seg = np.concatenate([r[1].astype(np.int64) + cuts[r[0]] for r in runs])
                    by = np.argsort(seg, kind="stable")
                    seg = seg[by]
                    first, count, least = (np.concatenate([r[i] for r in runs])[by].astype(np.int64) for i in (2, 3, 4))
                    a, b = np.searchsorted(seg, segment, "left"), np.searchsorted(seg, segment, "right")
                    row = np.repeat(np.arange(len(segment)), b - a)
                    use = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
                    hit = least[use] < ids[doc[row]]
                    row, use = row[hit], use[hit]
                    start = begin[row].astype(np.int64) + first[use]
                    step = np.bincount(start, minlength=len(text) + 1).astype(np.int64)
                    step -= np.bincount(start + count[use] - 1 + match_bytes, minlength=len(text) + 1)
                    mask = np.cumsum(step[:-1]) > 0
                yield _digest(pa.array(ids, pa.int64()), off, text, mask)

    near = (
        blocks.mapInArrow(anchors, "bucket int, block long, payload binary")
        .repartitionById(buckets, "bucket")
        .mapInArrow(shared, "block long, bucket int, bits binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))
    )
    near = scratch.save(near, "near")
    sweep(spark)
    runs = (
        blocks.join(near, "block")
        .select("block", "payload", "bits")
        .mapInArrow(segments, "bucket int, kind int, block long, payload binary")
        .repartitionById(buckets, "bucket")
        .mapInArrow(classes, "block long, bucket int, kind int, payload binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "kind", "payload")).alias("found"))
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    runs = scratch.save(runs, "runs")
    del near
    sweep(spark)  # the shuffles up to here are not needed any more
    done = blocks.join(runs, "block", "left").select("payload", "found").mapInArrow(cut, schema)

    def whole(batches):
        for batch in batches:
            raw, off = string_bytes(batch.column(1))
            yield _digest(batch.column(0), off, raw, np.zeros(len(raw), bool))

    return done.unionByName(docs.where("doc_id is null").mapInArrow(whole, schema))


def _pair_hash(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each padded row: two mixed sums over its 8-byte words."""
    words = np.ascontiguousarray(data).view("<u8")
    a, b = size.astype(np.uint64) * _ODD[0], size.astype(np.uint64) * _ODD[1]
    for i in range(words.shape[1]):
        x = (words[:, i] ^ a) * _ODD[2]
        a = x ^ (x >> np.uint64(31))
        y = (words[:, i] + b) * _ODD[3]
        b = y ^ (y >> np.uint64(27))
    return a, b


def _digest(ids: pa.Array, off: np.ndarray, text: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    n = len(off) - 1
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(text))]
    split = inner[mask[inner] & mask[inner - 1]] if len(inner) else inner  # a run that crosses into the next document
    begin, end = np.unique(np.r_[begin, split]), np.unique(np.r_[end, split])
    whose = np.searchsorted(off, begin, "right") - 1
    cuts = np.searchsorted(whose, np.arange(n + 1))
    removed = np.r_[0, np.cumsum(mask)][off]
    kept, held = text[~mask], off - removed
    raw = kept.tobytes()
    sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(held[:-1].tolist(), held[1:].tolist(), strict=True)]
    pairs = np.stack([begin - off[whose], end - off[whose]], 1).ravel()
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(off), pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(2 * cuts, pa.int32()), pa.array(pairs, pa.int64()))],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
    )
