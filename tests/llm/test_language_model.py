import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quartzfolio.llm.elias_fano import CHUNK, EliasFano, Level, quantise, restore
from quartzfolio.llm.language_model import score_documents


def words_of(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def brute(rows, d=0.75):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    uni, bi, tri = Counter(), defaultdict(Counter), defaultdict(Counter)
    for i, t in rows:
        if not held(i):
            x = [*words_of(t), "</end>"]
            uni.update(x)
            for a, b in zip(["<start>", *x], x):
                bi[a][b] += 1
            for a, b, c in zip(["<start>", *x], x, x[1:]):
                tri[a, b][c] += 1
    n, v = sum(uni.values()), len(uni)

    def mixed(table, context, word, lower):
        c = sum(table[context].values()) if context in table else 0
        if not c:
            return lower
        q = restore(quantise(np.array([max(table[context][word] - d, 0) / c, d * len([1 for k in table[context].values() if k]) / c])))
        return q[0] + q[1] * lower

    out = []
    for i, t in rows:
        x = [*words_of(t), "</end>"]
        p1 = [(uni[w] + 0.1) / (n + 0.1 * (v + 1)) for w in x]
        total = 0.0
        for k, (a, b, p) in enumerate(zip(["<start>", *x], x, p1)):
            p = mixed(bi, a, b, p)
            if k:
                p = mixed(tri, (x[k - 2] if k > 1 else "<start>", a), b, p)
            total += math.log10(p)
        out.append((i, held(i), len(x), sum(uni[w] > 0 for w in x), n, sum(map(math.log10, p1)), total))
    return sorted(out, key=str)


def corpus(n=200):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([3, 60])]) for _ in range(rng.randrange(60)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, "Unseen WORDS only\x0bhere"), (None, "ab ab"), (3, rows[3][1]), (4, "other text")]


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    return sorted(map(tuple, score_documents(df).collect()), key=str)


@pytest.mark.parametrize("heavy", [0.002, 0.03, 4.0])
def test_against_brute_force(spark, monkeypatch, heavy):
    import quartzfolio.llm.language_model as m

    monkeypatch.setattr(m, "HEAVY", heavy)
    rows = corpus()
    for x, y in zip(got(spark, rows), brute(rows), strict=True):
        assert x[:5] == y[:5]
        assert math.isclose(x[5], y[5], rel_tol=1e-12)
        # The weights of heavy contexts are not quantised here, but are in the plain model.
        assert math.isclose(x[6], y[6], rel_tol=1e-9, abs_tol=1e-9 if heavy > 2 else 0.025 * x[2])


def test_one_pair_for_a_third_of_all_places(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"the end {rng.choice('abcdefghijklm')}{rng.randrange(40)}" for _ in range(rng.randrange(1, 40)))) for i in range(150)]
    for x, y in zip(got(spark, rows), brute(rows), strict=True):
        assert x[:5] == y[:5] and math.isclose(x[6], y[6], abs_tol=0.025 * x[2])


def test_a_repeated_text_is_likelier_than_its_words(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda: " ".join(rng.choice(vocab) for _ in range(40))
    twin = text()
    rows = [(i, text()) for i in range(1, 80)] + [(1001, twin), (1002, twin)]
    per = {r[0]: r[6] / r[2] for r in got(spark, rows) if not r[1]}
    assert min(per[1001], per[1002]) > max(p for i, p in per.items() if i < 1000)


def test_no_training_rows_and_empty(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert got(spark, [(i, "a b")]) == [(i, True, 3, 0, 0, 0.0, 0.0)]
    assert got(spark, []) == []


@pytest.mark.parametrize("n", [0, 1, 5, CHUNK, 3 * CHUNK + 17])
def test_elias_fano(tmp_path, n):
    rng = np.random.default_rng(n)
    for top in (1, 50, 1 << 50):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        ef = EliasFano.write(str(tmp_path / "x"), values)
        assert n == 0 or (np.concatenate([ef.chunk(k) for k in range(-(-n // CHUNK))]) == values).all()
        values = np.unique(values)
        ef = EliasFano.write(str(tmp_path / "y"), values)
        wanted = np.sort(np.r_[values[:: max(n // 50, 1)], rng.integers(0, top + 5, 200).astype(np.uint64)])
        place, equal = ef.successor(wanted)
        assert (equal == np.isin(wanted, values)).all()
        assert (place == np.searchsorted(values, wanted)).all()


def test_level_finds_successors_between_pointers(tmp_path):
    rng = np.random.default_rng(5)
    both = np.unique(np.stack([rng.integers(0, 3000, 40_000), rng.integers(0, 60, 40_000)], 1), axis=0)
    both = both[both[:, 0] % 7 != 3]  # nodes without successors
    parent, word = both[:, 0], both[:, 1].astype(np.uint64) * np.uint64(1 << 33)
    level = Level(str(tmp_path / "l"), 3000, parent, word)
    ask = np.unique(np.stack([rng.integers(0, 3000, 60_000), rng.integers(0, 64, 60_000)], 1), axis=0)
    held = {(a, b): i for i, (a, b) in enumerate(both.tolist())}
    got = level.find(ask[:, 0], ask[:, 1].astype(np.uint64) * np.uint64(1 << 33))
    assert got.tolist() == [held.get((a, b), -1) for a, b in ask.tolist()]


def test_quantised_logarithms():
    p = 10.0 ** -np.linspace(0, 11.9, 500)
    assert np.max(np.abs(restore(quantise(p)) / p - 1)) < 0.056
    assert restore(quantise(np.array([0.0]))) == 0
