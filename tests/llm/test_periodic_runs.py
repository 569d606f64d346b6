import hashlib
import random
import re
import zlib

import pytest

from quartzfolio.llm import periodic_runs as runs
from quartzfolio.llm.periodic_runs import digest, find_runs, periodic_runs, plant, scales

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=12):
    """Every maximal stretch of every distance, each named by its smallest period."""
    n, out = len(w), set()
    for d in range(1, n // 2 + 1):
        i = 0
        while i + d < n:
            j = i
            while j + d < n and w[j] == w[j + d]:
                j += 1
            if j > i and j - i + d >= max(least, 2 * d):
                a, z = i, j + d
                q = next(q for q in range(1, d + 1) if w[a : z - q] == w[a + q : z])
                out.add((a, z - a, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_plant(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def plain(doc_id, text):
    w = plain_plant(doc_id, WORD.findall(text or ""))
    found = plain_runs(w)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(((-n, a, q) for a, n, q in found), default=None)
    head = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *head, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sequences(seed, count, longest):
    rng = random.Random(seed)
    for _ in range(count):
        n, k, w = rng.randrange(longest), rng.choice([1, 2, 2, 3, 5]), []
        while len(w) < n:
            p = [rng.randrange(k) for _ in range(rng.randrange(1, 30))]
            w += (p * rng.randrange(1, 6))[: rng.randrange(1, 90)] if rng.random() < 0.7 else p
        yield w[:n]


def test_against_every_distance():
    for w in sequences(1, 800, 150):
        assert find_runs(w) == plain_runs(w)
    for least in (4, 5, 7, 20, 40):
        for w in sequences(least, 150, 100):
            assert find_runs(w, least) == plain_runs(w, least)


def test_blocks_in_several_automata(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 8)
    for w in sequences(2, 400, 150):
        assert find_runs(w) == plain_runs(w)


def test_each_distance_has_one_scale_whose_blocks_fit():
    for least in (4, 12, 40):
        seen = [(d, size) for size, spans in scales(500, least) for a, z in spans for d in range(a, z + 1)]
        assert sorted(d for d, _ in seen) == list(range(1, 251))
        assert all(2 * size - 1 <= max(d, least - d) < 4 * size - 1 for d, size in seen)


def test_long_sequences_of_one_word_and_of_two():
    n = 60_000
    assert find_runs([0] * n) == [(0, n, 1)]
    assert find_runs([0, 1] * (n // 2)) == [(0, n, 2)]
    w = [i % 20_011 for i in range(n)]
    assert find_runs(w + [-1 % 7] + w[:5]) == [(0, n, 20_011)]


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(220):
        w = [rng.choice("abc") + rng.choice(["", "é", " ", "\x1c"]) for _ in range(rng.choice([3, 12, 40, 120]))]
        if i % 3 == 0:
            k = rng.randrange(1, 15)
            w += w[:k] * rng.randrange(2, 9)
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \r\n"), (None, "x " * 30), (None, None), (5, "la " * 12), (5, "la " * 12), (-17, "b c " * 9), (2000, "long é word " * 40_000)]


def test_rows_against_plain_python(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id long, text string, runs string, n_words int")
    out = digest(periodic_runs(plant(df)))
    got = sorted(map(tuple, out.collect()), key=str)
    small = [r for r in rows if r[0] != 2000]
    want = sorted((plain(d, t) for d, t in small), key=str)
    assert [r for r in got if r[0] != 2000] == want
    (long,) = [r for r in got if r[0] == 2000]
    assert long[1] >= 1 and long[3] > 1000


def test_interface_gives_texts_and_runs(spark):
    df = spark.createDataFrame([(1, "one two\nthree " * 4 + "end"), (2, "no run here")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 12, 3)] and got[1].collapsed == "one two three end" and got[1].n_words == 13
    assert got[2].runs == [] and got[2].collapsed == "no run here"
    with pytest.raises(ValueError):
        periodic_runs(df, least=3)


def test_empty_table(spark):
    assert digest(periodic_runs(plant(spark.createDataFrame([], "doc_id long, text string")))).collect() == []
