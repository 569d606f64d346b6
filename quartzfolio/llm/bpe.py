"""BPE encoding and decoding over a trie of distinct words.

The last token of a prefix's encoding fixes the rest: a prefix ends in the one
vocabulary token ``t`` that either is the whole prefix or may follow the last token
of what is left without ``t``. Two tokens may stand side by side when no earlier
merge crosses their border, which undoing their merges in order shows. New words
of a batch go into a trie, a depth-first walk hands each node the last tokens of
its ancestors, and a shared prefix is worked out once. Encodings are remembered per
white-space chunk in two generations of up to ``CACHE`` chunks a worker; older ones
are worked out again, which changes no result.

Texts are read whole. Null text is empty text: no ids, empty decoded text. White
space only and unknown scripts follow the tokenizer file. Null or repeated ids are
kept as they are, one output row per input row.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import configure, id_text, string_bytes
from .shingles import word_hashes, word_spans

#: Chunks a worker remembers in each of two generations: words by the trie come with
#: decoded texts, and so take more memory beside them.
CACHE, LIBRARY_CACHE = 250_000, 400_000
END = "</w>"


class WordTrie:
    """The trie of a set of words, walked depth first.

    Words in sorted order are the trie's leaves in depth-first order. The walk keeps
    one path only: the last token and its size for every node from the root to where
    it stands. The next word backs up to the prefix it shares with the word before
    and goes on from there, so a shared prefix is worked out once, and memory is the
    length of the longest word, not its square.
    """

    def __init__(self, vocabulary: TokenTable):
        self.vocabulary = vocabulary

    def encode(self, words: set[str]) -> dict[str, bytes]:
        """Every word's ids as little-endian unsigned 32-bit integers."""
        table, four = self.vocabulary, self.vocabulary.bytes_of
        ids, sizes, known, follows = table.ids, table.sizes, table.known, table.follows
        out: dict[str, bytes] = {}
        before, path, steps = "", [-1], [0]  # [d]: last token of the first d letters, and its size
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n, len(path)) - 1
            if most > 0 and word[:most] == before[:most]:
                shared = most
            else:
                while shared < most and word[shared] == before[shared]:
                    shared += 1
            del path[shared + 1 :], steps[shared + 1 :]
            for d in range(shared + 1, n):  # new nodes
                for size in sizes.get(word[max(d - 3, 0) : d], (2, 1)):
                    if size <= d:
                        token = ids.get(word[d - size : d])
                        if token is not None:
                            if size == d:
                                break
                            key = (path[d - size], token)
                            if known[key] if key in known else follows(key):
                                break
                else:
                    raise ValueError(f"no encoding for {word[:d]!r}")
                path.append(token)
                steps.append(size)
            for size in sizes.get(word[max(n - 3, 0) :] + END, (2, 1)):
                if size <= n:
                    token = ids.get(word[n - size :] + END)
                    if token is not None:
                        if size == n:
                            break
                        key = (path[n - size], token)
                        if known[key] if key in known else follows(key):
                            break
            else:
                raise ValueError(f"no encoding for {word!r}")
            before = word
            if size == n:
                out[word] = four[token]
                continue
            found, at = [four[token]], n - size
            while at:
                found.append(four[path[at]])
                at -= steps[at]
            found.reverse()
            out[word] = b"".join(found)
        return out


class TokenTable:
    """Vocabulary, merge order, and which tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.ids = vocab
        self.size_of = {i: len(t.removesuffix(END)) for t, i in vocab.items()}
        #: For the last three letters of a prefix, the lengths of tokens that end so.
        sizes: dict[str, set[int]] = {}
        for t, i in vocab.items():
            n = self.size_of[i]
            if n >= 3:
                sizes.setdefault(t[n - 3 :], set()).add(n)
        self.sizes = {tail: (*sorted(x, reverse=True), 2, 1) for tail, x in sizes.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = {a + b for a, b in pairs}
        base = [t for t in vocab if t not in made]
        order = {t: i for i, t in enumerate(base)}
        for a, b in pairs:
            order.setdefault(a + b, len(order))
        self.order = {vocab[t]: i for t, i in order.items()}
        self.halves = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in reversed(pairs)}
        self.joined = {(vocab[a], vocab[b]): order[a + b] for a, b in pairs}
        self.known: dict[tuple[int, int], bool] = {}

    def follows(self, pair: tuple[int, int]) -> bool:
        if len(self.known) > CACHE:
            self.known.clear()
        out = self.known[pair] = self._apart(*pair)
        return out

    def _apart(self, left: int, right: int) -> bool:
        """Undoes the later merge of the two sides, again and again: a merge over
        the border that comes before what was undone would have happened first."""
        order, halves, limit = self.order, self.halves, len(self.order) + 1
        while True:
            over = self.joined.get((left, right))
            if over is not None and over < limit:
                return False
            undo_left = order[left] > order[right]
            if undo_left and left not in halves:
                undo_left = False
            if not undo_left and right not in halves:
                if left not in halves:
                    return True
                undo_left = True
            if undo_left:
                limit = order[left]
                left = halves[left][1]
            else:
                limit = order[right] + 1  # on equal rank the merge further left comes first
                right = halves[right][0]


def _byte_letters() -> str:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for
    itself, the other bytes follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


class Encoder:
    """Text to ids and back for one tokenizer file with word ends.

    ``by_library`` has the tokenizers library encode unseen chunks instead of the trie.
    """

    by_library = False

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        if model.get("end_of_word_suffix") != END or told.get("decoder"):
            raise ValueError("a BPE file with word ends and no decoder is needed")
        self.table = TokenTable(model["vocab"], model["merges"])
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = _byte_letters()
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall
        self.simple = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
        self.bytes_of = self.table.bytes_of = {i: np.array([i], "<u4").tobytes() for i in self.token}
        self.known: list[dict[int, bytes]] = [{}, {}]  # a chunk's hash to its ids: young, old

    def forget(self) -> None:
        self.known = [{}, {}]
        self.table.known.clear()

    def words_of(self, text: str) -> list[str]:
        """The words of a text without special tokens, as byte letters."""
        if self.simple(text):
            found = self.pieces(text.lower())
            if text.isascii():
                return found
            return [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in found]
        normal = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def learn(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks not remembered, through a trie of their distinct words."""
        rows: list = []
        fresh: set[str] = set()
        for chunk in chunks:
            if chunk.isalpha():  # ASCII letters only: one word
                row = chunk.decode().lower()
                fresh.add(row)
            elif b"<|" in chunk and self.split_special:
                row = []
                for piece in self.split_special.split(chunk.decode("utf-8", "replace")):
                    if piece in self.special:
                        row.append(self.special[piece])
                    elif piece:
                        row += self.words_of(piece)
                fresh.update([w for w in row if w.__class__ is str])
            else:
                row = self.words_of(chunk.decode("utf-8", "replace"))
                fresh.update(row)
            rows.append(row)
        four = self.bytes_of
        if self.by_library:
            words, tokenize = list(fresh), self.library.model.tokenize
            known = {w: b"".join([four[t.id] for t in tokenize(w)]) for w in words}
        else:
            known = WordTrie(self.table).encode(fresh)
        return [known[row] if row.__class__ is str else b"".join([four[w] if w.__class__ is int else known[w] for w in row]) for row in rows]

    def _remembered(self, keys: list[int], chunks) -> list[bytes]:
        """Ids of distinct chunks, by hash from the young or the old memory, or worked out."""
        young, old = self.known
        if len(young) + len(keys) > (LIBRARY_CACHE if self.by_library else CACHE):
            young, old = self.known = [{}, young]
        out = list(map(young.get, keys))
        lost = [i for i, x in enumerate(out) if x is None]
        if lost:
            if old:
                for i in lost:
                    out[i] = old.get(keys[i])
            new = [i for i in lost if out[i] is None] if old else lost
            if new:
                for i, x in zip(new, self.learn(chunks(new)), strict=True):
                    out[i] = x
            for i in lost:
                young[keys[i]] = out[i]
        return out

    def encode_bytes(self, raw: np.ndarray, off: np.ndarray, decoded: bool = False):
        """Ids of texts laid end to end: (ids, first id of each text, decoded texts).

        Chunks are told apart by a 64-bit hash.
        """
        start, end = spans = word_spans(raw, off)
        h, first = word_hashes(raw, off, False, spans)
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        np.not_equal(h[order[1:]], h[order[:-1]], out=new[1:])
        where, chunk = order[new], np.empty(len(h), np.int64)
        chunk[order] = np.cumsum(new) - 1
        keys = h[where]
        data = raw.tobytes()

        def chunks(new: list[int]) -> list[bytes]:
            return [data[a:b] for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)]

        got = self._remembered(keys.tolist(), chunks)
        flat = np.frombuffer(b"".join(got), "<u4")
        size = np.array([len(x) for x in got], np.int64) // 4
        at = np.cumsum(size) - size
        count = size[chunk]
        cuts = np.r_[0, np.cumsum(count)]
        ids = flat[np.repeat(at[chunk] - cuts[:-1], count) + np.arange(cuts[-1])]
        back = None
        if decoded:
            strings, shown = list(map(self.token.__getitem__, flat.tolist())), np.empty(len(got), object)
            for i, (a, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
                shown[i] = strings[a] if n == 1 else " ".join(strings[a : a + n])
            rows = shown[chunk[count > 0]].tolist()
            edges = np.r_[0, np.cumsum(count > 0)][first].tolist()
            back = [" ".join(rows[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return ids, cuts[first], back

    def encode(self, texts: list[bytes], decoded: bool = False) -> tuple[list[bytes], list[str] | None]:
        """Ids of each text as little-endian unsigned 32-bit integers, and what
        decoding them gives: the tokens' strings with a space between."""
        raw, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
        ids, cuts, back = self.encode_bytes(raw, off, decoded)
        return split_ids(ids, cuts), back

    def decode(self, ids: bytes) -> str:
        token = self.token
        return " ".join([token[i] for i in np.frombuffer(ids, "<u4").tolist() if i in token])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, by_library: bool = False) -> Encoder:
    """One encoder a worker process, file and way."""
    key = f"{path}\n{by_library}"
    if key not in _ENCODERS:
        gc.freeze()  # what is remembered is large and free of cycles
        gc.set_threshold(200_000, 50, 1000)
        _ENCODERS[key] = Encoder(path)
        _ENCODERS[key].by_library = by_library
    return _ENCODERS[key]


def split_ids(ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    data, at = ids.astype("<u4", copy=False).tobytes(), (4 * cuts).tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encode_decode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded."""
    configure(documents.sparkSession, 600)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        try:
            for batch in batches:
                ids, cuts, back = coder.encode_bytes(*string_bytes(batch.column(1)), decoded=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(cuts), pa.int64()), pa.array(split_ids(ids, cuts), pa.binary()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )
        finally:
            coder.forget()  # the worker may go on to other operators

    return id_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
