"""Monotone sequences and an n-gram trie of any number of levels in memory-mapped files."""

from __future__ import annotations

import os

import numpy as np

CHUNK = 1 << 15


class EliasFano:
    """A non-decreasing sequence below 2**63: low bits packed, high bits in unary.

    ``write`` puts both bit vectors into files; reading maps them. ``heads`` holds
    the first value and the unary position of every ``CHUNK``-th element.
    """

    def __init__(self, path: str, n: int, low: int, heads: np.ndarray, spots: np.ndarray):
        self.n, self.low, self.heads, self.spots = n, low, heads, spots
        self.high_bits = np.memmap(f"{path}.high", np.uint8, "r") if n else np.zeros(0, np.uint8)
        self.low_bits = np.memmap(f"{path}.low", np.uint8, "r") if n and low else np.zeros(0, np.uint8)

    @classmethod
    def write(cls, path: str, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64, copy=False)
        most = int(values[-1]) if n else 0
        low = max(0, (most // max(n, 1)).bit_length() - 1)
        spots = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        if n:
            bits = np.zeros(int(spots[-1]) + 1, np.uint8)
            bits[spots] = 1
            np.packbits(bits).tofile(f"{path}.high")
            if low:
                with open(f"{path}.low", "wb") as file:
                    for a in range(0, n, CHUNK):  # every chunk starts at a whole byte
                        part = np.unpackbits(values[a : a + CHUNK].astype(">u8").view("u1").reshape(-1, 8), axis=1)
                        np.packbits(part[:, 64 - low :].ravel()).tofile(file)
        return cls(path, n, low, values[::CHUNK].copy(), np.r_[spots[::CHUNK], spots[-1:] + 1] if n else np.zeros(1, np.int64))

    def chunk(self, k: int) -> np.ndarray:
        """Elements k * CHUNK and on, decoded."""
        size = min(CHUNK, self.n - k * CHUNK)
        first, last = int(self.spots[k]), int(self.spots[k + 1])
        bits = np.unpackbits(self.high_bits[first // 8 : -(-last // 8)])[first % 8 : first % 8 + last - first]
        out = (np.flatnonzero(bits)[:size] + first - np.arange(k * CHUNK, k * CHUNK + size)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            step = CHUNK * self.low // 8
            low = np.unpackbits(self.low_bits[k * step : k * step + -(-size * self.low // 8)])[: size * self.low].reshape(size, self.low)
            bits = np.zeros((size, 64), np.uint8)
            bits[:, 64 - self.low :] = low
            out |= np.packbits(bits, axis=1).view(">u8").ravel()
        return out

    def get(self, wanted: np.ndarray) -> np.ndarray:
        """Elements at ascending places; each chunk that holds one is decoded once."""
        out = np.zeros(len(wanted), np.uint64)
        edges = np.searchsorted(wanted, np.arange(0, self.n + CHUNK, CHUNK))
        for k in np.flatnonzero(np.diff(edges)):
            a, b = int(edges[k]), int(edges[k + 1])
            out[a:b] = self.chunk(int(k))[wanted[a:b] - int(k) * CHUNK]
        return out

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a strictly increasing sequence, for sorted values: place of the first
        element not below each, and whether it is equal. Each chunk that holds answers
        is decoded once."""
        place, equal = np.full(len(wanted), self.n, np.int64), np.zeros(len(wanted), bool)
        if not self.n:
            return place, equal
        edges = np.r_[0, np.searchsorted(wanted, self.heads[1:], "left"), len(wanted)]
        for k in np.flatnonzero(np.diff(edges)):
            a, b = int(edges[k]), int(edges[k + 1])
            values = self.chunk(int(k))
            at = np.searchsorted(values, wanted[a:b], "left")
            place[a:b] = at + k * CHUNK
            equal[a:b] = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == wanted[a:b])
        return place, equal


#: Logarithms to base 10 from -LOWEST to 0 in 255 steps; 0 stands for "none". A value
#: is off by 5.6 percent at most, and no count below 10**11 reaches the lowest one.
LOWEST = 12.0


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        x = np.log10(p)
    return np.where(p > 0, np.clip(np.rint(255 + x * (254 / LOWEST)), 1, 255), 0).astype(np.uint8)


_VALUES = np.r_[0.0, 10.0 ** ((np.arange(1, 256) - 255) * (LOWEST / 254))]


def restore(code: np.ndarray) -> np.ndarray:
    return _VALUES[code]


class Level:
    """The successors of every node of the level above, in order of their nodes.

    ``pointers`` (Elias-Fano) says where a node's successors start. A successor's value
    is relative to its node: its word number, from 1, plus the last value stored before
    the node's first successor, which keeps the whole level one monotone sequence. So a
    search reads the node's two pointers and the value before the first, and only then
    can look for its word between them.
    """

    def __init__(self, path: str, nodes: int, parent: np.ndarray, word: np.ndarray):
        """``parent`` and ``word`` sorted by both, without repeats."""
        count = np.bincount(parent, minlength=nodes) if len(parent) else np.zeros(nodes, np.int64)
        ends = np.cumsum(count)
        last = np.zeros(nodes, np.uint64)
        full = count > 0
        last[full] = word[ends[full] - 1] + np.uint64(1)
        before = np.cumsum(last) - last
        self.pointers = EliasFano.write(f"{path}.pointers", np.r_[0, ends])
        self.values = EliasFano.write(f"{path}.values", word + np.uint64(1) + before[parent])

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each (node, word), sorted by both; -1 where it is not there."""
        out = np.full(len(parent), -1, np.int64)
        if not len(parent) or not self.values.n:
            return out
        nodes, of = np.unique(parent, return_inverse=True)
        low, high = self.pointers.get(nodes).astype(np.int64), self.pointers.get(nodes + 1).astype(np.int64)
        base = np.where(low > 0, self.values.get(np.maximum(low - 1, 0)), np.uint64(0))
        top = np.where(high > low, self.values.get(np.maximum(high - 1, 0)), np.uint64(0))
        target = base[of] + word + np.uint64(1)
        maybe = np.flatnonzero((high > low)[of] & (target <= top[of]))
        place, equal = self.values.successor(target[maybe])
        hit = equal & (place >= low[of[maybe]]) & (place < high[of[maybe]])
        out[maybe[hit]] = place[hit]
        return out


class NgramTrie:
    """Words, their successors, and the successors of word pairs, with quantised
    discounted probabilities.

    Level one holds context words with counts and back-off weights, level two their
    successors with probabilities and, as contexts, back-off weights and counts, level
    three the successors of those. What a level knows of its elements is an array in a
    file, one 8-bit code or count an element, mapped when it is asked.
    """

    def __init__(self, folder: str, words: np.ndarray, pairs: tuple, triples: tuple, discount: float):
        """``words`` sorted; ``pairs`` (word's place, next word, count, ...) and ``triples``
        (pair's place, next word, count) sorted by the first two. A pair may have count 0
        and still be the context of triples."""
        self.folder, self.discount = folder, discount
        first, second, count = pairs
        self.words = EliasFano.write(f"{folder}/words", words)
        self.second = Level(f"{folder}/second", len(words), first, second)
        self.third = Level(f"{folder}/third", len(first), *triples[:2])
        self._write("1", len(words), first, count)
        self._write("2", len(first), triples[0], triples[2])

    def _write(self, name: str, nodes: int, parent: np.ndarray, count: np.ndarray) -> None:
        seen = count > 0
        total = np.bincount(parent, count, nodes) if len(parent) else np.zeros(nodes)
        kinds = np.bincount(parent[seen], minlength=nodes) if len(parent) else np.zeros(nodes)
        chance = np.maximum(count - self.discount, 0) / np.maximum(total[parent], 1) if len(parent) else np.zeros(0)
        weight = np.divide(self.discount * kinds, total, out=np.zeros(nodes), where=total > 0)
        for kind, data in (("total", total.astype("<i8")), ("weight", quantise(weight)), ("chance", quantise(chance))):
            data.tofile(f"{self.folder}/{kind}{name}")

    def _map(self, name: str, kind: str = "u1") -> np.ndarray:
        path = f"{self.folder}/{name}"
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

    def _pick(self, name: str, place: np.ndarray, kind: str = "u1") -> np.ndarray:
        data = self._map(name, kind)
        return np.where(place >= 0, data[np.maximum(place, 0)], 0).astype(kind) if len(data) else np.zeros(len(place), kind)

    def word(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, counts and weight codes of sorted context words (place -1: not there)."""
        place, known = self.words.successor(wanted)
        place = np.where(known, place, -1)
        return place, self._pick("total1", place, "<i8"), self._pick("weight1", place)

    def pair(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted (word's place, next word): places, probability codes, and as a
        context the weight codes and counts."""
        place = self.second.find(first, second)
        return place, self._pick("chance1", place), self._pick("weight2", place), self._pick("total2", place, "<i8")

    def triple(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability codes of sorted (pair's place, next word)."""
        return self._pick("chance2", self.third.find(pair, word))
