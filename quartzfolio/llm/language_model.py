"""Language-model scoring with an Elias-Fano n-gram trie, dealt over the cluster.

The model is an interpolated trigram model with absolute discounting over smoothed
unigrams: p(w | u v) = max(c(u, v, w) - D, 0) / c(u, v) + D t(u, v) / c(u, v) p(w | v),
with c(u, v) the times a word follows u v and t(u, v) the number of different words
that do, p(w | v) alike one order lower, and p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))
at the bottom; a context that was never seen leaves its order out. The first token of
a document has no more context than the document's start, the second one word more.
Discounted probabilities and back-off weights are held as 8-bit logarithms, counts
exactly and in 64 bits; the back-off weights of often contexts come from whole counts.

Documents are packed into blocks. A block sends its different contexts, word pairs
and triples, each once with its count, to the partition of the first word, so what is
gathered grows with the corpus and nothing goes to the driver but N, V and the lists
of words and of word pairs that hold a share of at least ``HEAVY`` of all places (at
most 2 / HEAVY each). Successors of those are split over all partitions, so a word or
pair of any frequency loads all partitions alike; their whole counts are added up and
known to every block. A partition builds its trie from the
training counts, maps its files, answers the blocks' pairs and triples by successor
search between a context's pointers, and the blocks add up scores.

Words are told apart by 48-bit hashes within a partition, by 32 bits among one
context's successors, and pairs by 64 bits within a block. Null text is empty text: its one token is
the end. Rows with a null id are held out and scored; repeated ids count as often as
they stand there. An empty table gives an empty result; without training rows all
tokens are unknown.
"""

from __future__ import annotations

import math
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, configure, id_text, pack, partitions, sweep, unpack
from .elias_fano import NgramTrie, restore
from .shingles import mix, word_hashes
from .suffix_dedup import _blocks, _rows

DISCOUNT, HEAVY = 0.75, 0.002
START, END = np.uint64(1), np.uint64(2)
_NO_ID = -(1 << 63)
_MASK32, _MASK48 = (np.uint64((1 << k) - 1) for k in (32, 48))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _tokens(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens to predict, the token before each, and whether one is its text's first."""
    opens = np.zeros(len(h) + len(first) - 1, bool)
    opens[first[:-1] + np.arange(len(first) - 1)] = True
    return np.insert(h, first[1:], END), np.insert(h, first[:-1], START), opens


def _pair_key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context ^ (token * _ODD))


def _planes(x: np.ndarray, kind: str = "<u4") -> np.ndarray:
    """The numbers' lowest bytes, then the next ones: small numbers compress well so."""
    x = x.astype(kind)
    return x.view("u1").reshape(len(x), x.itemsize).T.ravel()


def _joined(x: np.ndarray, kind: str = "<u4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(x.reshape(size, -1).T).view(kind).ravel()


class _Block:
    """Tokens of a block and its different contexts, pairs and triples, by partition.

    ``row_*``: contexts of a partition; ``node_*``: pairs of a partition, as successors
    of its contexts and as contexts of its triples; ``leaf_*``: triples.
    """

    def __init__(self, payload: bytes, shards: int, heavy: np.ndarray, heavy_pairs: np.ndarray, folds: int):
        self.ids, lens, text = unpack(payload)
        off = np.r_[0, np.cumsum(lens)].astype(np.int64)
        h, first = word_hashes(text, off)
        self.words = np.diff(first)
        self.token, self.context, self.opens = token, context, opens = _tokens(h, first)
        self.cuts = first + np.arange(len(first))
        self.held = np.array([i == _NO_ID or zlib.crc32(str(i).encode()) % folds == 0 for i in self.ids.tolist()], bool)
        train = np.repeat(~self.held, self.words + 1)
        # Different contexts, and for each place which one it has, and its token would be.
        order, new = _grouped(context)
        self.known = context[order][new]
        self.context_of = np.empty(len(context), np.int64)
        self.context_of[order] = np.cumsum(new) - 1
        self.known_split = _place_in(heavy, self.known)
        self.token_of = np.r_[self.context_of[1:], 0]
        self.token_of[self.cuts[1:] - 1] = np.searchsorted(self.known, START)
        # Different pairs, each at home in one partition.
        spread = _pair_key(context, token)
        order, new = _grouped(spread)
        at = order[new]
        pair_of = np.empty(len(order), np.int64)
        pair_of[order] = np.cumsum(new) - 1
        count = np.add.reduceat(train[order], np.flatnonzero(new), dtype=np.int64)
        key, of_pair, word = spread[at], self.context_of[at], token[at] & _MASK32
        split = _place_in(heavy_pairs, key)  # -1: not heavy
        home = (np.where(self.known_split[of_pair] >= 0, key, context[at]) % np.uint64(shards)).astype(np.int64)
        # Triples go where their pair is, those of a heavy pair anywhere.
        self.inner = np.flatnonzero(~opens)
        pair, last = pair_of[self.inner - 1], token[self.inner]
        far = np.flatnonzero(split[pair] >= 0)
        to = (mix(key[pair[far]] ^ (last[far] * _ODD)) % np.uint64(shards)).astype(np.int64)
        trip = to * len(at) + pair[far]
        away, where = np.unique(np.where(to == home[pair[far]], -1, trip), return_inverse=True)
        extra = away[away >= 0]
        # Pairs of each partition: those at home, and heavy ones whose triples come there.
        node_s, node_p = np.r_[home, extra // len(at)], np.r_[np.arange(len(at)), extra % len(at)]
        order = np.argsort(node_s.astype(np.uint64) << np.uint64(40) | of_pair[node_p].astype(np.uint64))
        self.node_shard, self.node_pair = node_s[order], node_p[order]
        self.node_word, self.node_split = word[self.node_pair], split[self.node_pair]
        self.node_count = np.where(order < len(at), count[self.node_pair], 0)
        self.node_cuts = np.searchsorted(self.node_shard, np.arange(shards + 1))
        spot = np.empty(len(order), np.int64)
        spot[order] = np.arange(len(order))
        node = spot[pair]
        lost = away[where] >= 0
        node[far[lost]] = spot[len(at) + where[lost] - (len(away) - len(extra))]
        key = node.astype(np.uint64) << np.uint64(32) | last & _MASK32
        order, new = _grouped(key)
        self.leaf_of = np.empty(len(order), np.int64)
        self.leaf_of[order] = np.cumsum(new) - 1
        key = key[order][new]
        self.leaf_node, self.leaf_word = (key >> np.uint64(32)).astype(np.int64), key & _MASK32
        self.leaf_count = np.add.reduceat(train[self.inner][order], np.flatnonzero(new), dtype=np.int64) if len(key) else np.zeros(0, np.int64)
        self.leaf_cuts = np.searchsorted(self.leaf_node, self.node_cuts)
        self.pair_of, self.before = pair_of, pair
        # Contexts of each partition.
        s, c = self.node_shard, of_pair[self.node_pair]
        new = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]
        self.node_row, self.row_known = np.cumsum(new) - 1, c[new]
        self.row_cuts = np.searchsorted(s[new], np.arange(shards + 1))
        self.row_split = self.known_split[self.row_known]
        self.row48 = self.known[self.row_known] // np.uint64(shards) & _MASK48

    def part(self, k: int) -> bytes | None:
        """What partition ``k`` has to know, or nothing."""
        a, b, c, d, e, f = *self.row_cuts[k : k + 2], *self.node_cuts[k : k + 2], *self.leaf_cuts[k : k + 2]
        if a == b:
            return None
        row48, word, rows, nodes = self.row48[a:b], self.node_word[c:d], self.row_split[a:b], self.node_split[c:d]
        return pack(
            (row48 & _MASK32).astype("<u4"), (row48 >> np.uint64(32)).astype("<u2"), _planes(np.bincount(self.node_row[c:d] - a, minlength=b - a)),
            word.astype("<u4"), _planes(self.node_count[c:d]), _planes(np.bincount(self.leaf_node[e:f] - c, minlength=d - c)),
            self.leaf_word[e:f].astype("<u4"), _planes(self.leaf_count[e:f]),
            np.flatnonzero(rows >= 0).astype("<u4"), rows[rows >= 0].astype("<u4"), np.flatnonzero(nodes >= 0).astype("<u4"), nodes[nodes >= 0].astype("<u4"),
        )

    def scores(self, got: list, n: int, v: int, often: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, base score and score, from the partitions' answers
        and the whole (counts, successors) of heavy words and of heavy pairs."""
        counts, weights = np.zeros(len(self.row_known), np.int64), np.zeros(len(self.row_known))
        chance, deep, held = (np.zeros(len(self.node_pair)) for _ in range(3))
        leaf = np.zeros(len(self.leaf_node))
        for r in got:
            k = r["part"]
            c, w, p, q, t, x = unpack(r["payload"])
            rows, nodes = slice(*self.row_cuts[k : k + 2]), slice(*self.node_cuts[k : k + 2])
            counts[rows], weights[rows], chance[nodes], deep[nodes] = _joined(c, "<i8"), restore(w), restore(p), restore(q)
            held[nodes] = q > 0
            held[self.node_cuts[k] + np.flatnonzero(self.node_split[nodes] >= 0)] = t
            leaf[self.leaf_cuts[k] : self.leaf_cuts[k + 1]] = restore(x)
        # A context is in one part; of a heavy one this block may know few, so its whole counts say.
        total, weight = np.zeros(len(self.known), np.int64), np.zeros(len(self.known))
        full = counts > 0
        total[self.row_known[full]], weight[self.row_known[full]] = counts[full], weights[full]
        (total, weight), (after, deeper) = _whole(total, weight, self.known_split, often[0]), _whole(*self._by_pair(held, deep), often[1])
        pairs = len(after)
        part = counts[self.node_row] / np.maximum(total[self.row_known[self.node_row]], 1)
        pair = np.bincount(self.node_pair, chance * part, pairs)
        c = total[self.token_of]
        base = np.log10(total + 0.1) - math.log10(n + 0.1 * (v + 1))
        p1 = ((total + 0.1) / (n + 0.1 * (v + 1)))[self.token_of]
        p = pair[self.pair_of] + np.where(total > 0, weight, 1)[self.context_of] * p1
        leaf *= (held / np.maximum(after[self.node_pair], 1))[self.leaf_node]
        p[self.inner] = leaf[self.leaf_of] + np.where(after > 0, deeper, 1)[self.before] * p[self.inner]
        at = self.cuts[:-1]
        return np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(base[self.token_of], at), np.add.reduceat(np.log10(p), at)

    def _by_pair(self, held: np.ndarray, deep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair: times it was seen as a context (light: 1 or 0), weight, place in the heavy list."""
        n = int(self.node_pair.max()) + 1
        after, weight, split = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        full = held > 0
        after[self.node_pair[full]], weight[self.node_pair[full]], split[self.node_pair] = held[full], deep[full], self.node_split
        return after, weight, split


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal numbers together, and where each starts in it."""
    order = np.argsort(x)
    y = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(y[1:], y[:-1], out=new[1:])
    return order, new


def _whole(total: np.ndarray, weight: np.ndarray, split: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and back-off weights, those of heavy contexts from their whole counts."""
    at = np.flatnonzero(split >= 0)
    if len(at):
        count, kinds = (x[split[at]] for x in often)
        total[at], weight[at] = count, DISCOUNT * kinds / np.maximum(count, 1)
    return total, weight


def _place_in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each in sorted values; -1 where it is not there."""
    if not len(values):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, at, -1)


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (kind 0) and pairs (kind 1) that are often in a block, and its places (kind 2)."""
    for batch in batches:
        for payload in batch.column(1).to_pylist():
            _, lens, text = unpack(payload)
            token, context, _ = _tokens(*word_hashes(text, np.r_[0, np.cumsum(lens)].astype(np.int64)))
            out = [(2, 0, len(token))]
            for kind, x in enumerate((context, _pair_key(context, token))):
                x = np.sort(x)
                new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                size = np.diff(np.r_[new, len(x)])
                keep = size >= HEAVY / 2 * len(x)
                out += [(kind, int(w), int(k)) for w, k in zip(x[new][keep].view(np.int64), size[keep], strict=True)]
            yield _rows(out, [pa.int32(), pa.int64(), pa.int64()], ["kind", "word", "n"])


def _merged(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys with summed counts, and each one's place among them."""
    order, new = _grouped(key)
    key = key[order]
    total = np.add.reduceat(count[order], np.flatnonzero(new)) if len(key) else np.zeros(0, np.int64)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return key[new], total, place


def _answers(parts: list[list[np.ndarray]]) -> tuple[list[tuple[int, int, int, int]], Iterator[bytes]]:
    """Builds the trie of a partition from all blocks' parts and answers each of them:
    sums (kind, heavy place, count, successors), and one payload a part. Kind 0 and 1 are
    heavy words and pairs, kind 2 all tokens and the different words that are not heavy."""
    row48 = np.concatenate([p[0].astype(np.uint64) | p[1].astype(np.uint64) << np.uint64(32) for p in parts])
    whole = lambda i: np.concatenate([_joined(p[i]) for p in parts]).astype(np.int64)
    contexts, rank = np.unique(row48, return_inverse=True)
    word, last = (np.concatenate([p[i] for p in parts]).astype(np.uint64) for i in (3, 6))
    key, total, node = _merged(np.repeat(rank, whole(2)).astype(np.uint64) << np.uint64(32) | word, whole(4))
    deep, deep_total, leaf = _merged(np.repeat(node, whole(5)).astype(np.uint64) << np.uint64(32) | last, whole(7))
    seen = deep_total > 0
    parent = (deep[seen] >> np.uint64(32)).astype(np.int64)
    kept = total > 0  # what no training text holds is not in the trie
    kept[parent] = True
    moved = np.cumsum(kept) - 1
    first, second = (key[kept] >> np.uint64(32)).astype(np.int64), key[kept] & _MASK32
    with tempfile.TemporaryDirectory() as folder:
        trie = NgramTrie(folder, contexts, (first, second, total[kept]), (moved[parent], deep[seen] & _MASK32, deep_total[seen]), DISCOUNT)
        _, counts, weights = trie.word(contexts)
        at, chance, deep_weight, after = trie.pair((key >> np.uint64(32)).astype(np.int64), key & _MASK32)
        there = np.flatnonzero(at[(deep >> np.uint64(32)).astype(np.int64)] >= 0)
        deep_chance = np.zeros(len(deep), "u1")
        deep_chance[there] = trie.triple(at[(deep[there] >> np.uint64(32)).astype(np.int64)], deep[there] & _MASK32)
        del trie
    rows, nodes = np.cumsum([0] + [len(p[0]) for p in parts]), np.cumsum([0] + [len(p[3]) for p in parts])
    split = np.concatenate([rank[a + p[8]] for a, p in zip(rows, parts)]), np.concatenate([p[9] for p in parts])
    split_pairs = np.concatenate([node[a + p[10]] for a, p in zip(nodes, parts)]), np.concatenate([p[11] for p in parts])
    kinds = np.bincount((key[total > 0] >> np.uint64(32)).astype(np.int64), minlength=len(contexts))
    deep_kinds = np.bincount(parent, minlength=len(key))
    light = np.ones(len(contexts), bool)
    light[split[0]] = False
    sums = [(2, 0, int(counts.sum()), int(np.count_nonzero(light & (counts > 0))))]
    for kind, (at, place), count, different in ((0, split, counts, kinds), (1, split_pairs, after, deep_kinds)):
        place, own = np.unique(place, return_index=True)
        sums += [(kind, int(i), int(count[j]), int(different[j])) for i, j in zip(place, at[own])]

    def payloads() -> Iterator[bytes]:
        a = b = c = 0
        for p in parts:
            own, nodes, leaves = rank[a : a + len(p[0])], node[b : b + len(p[3])], leaf[c : c + len(p[6])]
            yield pack(_planes(counts[own], "<i8"), weights[own], chance[nodes], deep_weight[nodes], after[nodes[p[10]]], deep_chance[leaves])
            a, b, c = a + len(p[0]), b + len(p[3]), c + len(p[6])

    return sums, payloads()


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    configure(spark)
    scratch, shards = Scratch(spark, "lm"), partitions(spark)
    docs = id_text(documents, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    blocks = scratch.save(docs.mapInArrow(_blocks, "block long, payload binary"), "blocks", "none")

    counted = scratch.save(blocks.mapInArrow(_often, "kind int, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")), "often")
    every = counted.where("kind = 2").agg(F.sum("n")).collect()[0][0] or 0
    # A share of HEAVY over all blocks is at least half of it over those that count it.
    top = counted.where((F.col("kind") < 2) & (F.col("n") >= HEAVY / 2 * every)).select("kind", "word").collect()  # 2 / HEAVY of a kind at most
    heavy, heavy_pairs = (np.sort(np.array([r.word for r in top if r.kind == k], np.int64).view(np.uint64)) for k in (0, 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                x = _Block(payload, shards, heavy, heavy_pairs, folds)
                found = [(k, name, p) for k in range(shards) if (p := x.part(k)) is not None]
                yield _rows(found, [pa.int32(), pa.int64(), pa.binary()], ["part", "block", "payload"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = [], []
        for batch in batches:
            for part, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                names.append((part, block))
                parts.append(unpack(payload))
        if not names:
            return
        sums, payloads = _answers(parts)
        kinds, columns = [pa.int64(), pa.int32(), pa.binary()], ["block", "part", "payload"]
        yield _rows([(-1, names[0][0], pack(*np.array(sums, "<i8").T))], kinds, columns)
        for (part, block), payload in zip(names, payloads, strict=True):
            yield _rows([(block, part, payload)], kinds, columns)

    sent = blocks.mapInArrow(send, "part int, block long, payload binary").repartitionById(shards, "part")
    answers = scratch.save(sent.mapInArrow(answer, "block long, part int, payload binary"), "answers", "none")
    del sent
    sweep(spark)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(payload)], ["kind", "place", "n", "different"])

    sums = answers.where("block = -1").select("payload").mapInArrow(spread, "kind long, place long, n long, different long")
    sums = sums.groupBy("kind", "place").agg(F.sum("n").alias("n"), F.sum("different").alias("different")).collect()  # one row a heavy word or pair, and one
    n, v, often = 0, 0, tuple((np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)) for x in (heavy, heavy_pairs))
    for r in sums:
        if r.kind == 2:
            n, v = n + r.n, v + r.different
        else:
            often[r.kind][0][r.place], often[r.kind][1][r.place] = r.n, r.different
    v += int(np.count_nonzero(often[0][0]))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, got in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                x = _Block(payload, shards, heavy, heavy_pairs, folds)
                known, base, score = x.scores(got, n, v, often)
                ids = pa.array(x.ids, pa.int64(), mask=x.ids == _NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(x.held), pa.array(x.words + 1, pa.int64()), pa.array(known), pa.array(np.full(len(known), n), pa.int64()), pa.array(base), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    grouped = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "payload")).alias("got"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.join(grouped, "block").select("payload", "got").mapInArrow(add_up, schema)
