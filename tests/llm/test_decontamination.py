import random
import re

import numpy as np
import pyarrow as pa

from quartzfolio.llm.decontamination import find_contamination, tile, windows, words


def tokens(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[a-z0-9\x80-\U0010FFFF]+", t)


def greedy(text, item, least):
    """The plain algorithm: all longest matches of unmarked words, leftmost first."""
    ft, fi, out = [True] * len(text), [True] * len(item), []
    while True:
        best, size = None, least - 1
        for i in range(len(text)):
            for j in range(len(item)):
                k = 0
                while i + k < len(text) and j + k < len(item) and ft[i + k] and fi[j + k] and text[i + k] == item[j + k]:
                    k += 1
                if k > size:
                    best, size = (i, j), k
        if best is None:
            return sorted(out)
        out.append((*best, size))
        for k in range(size):
            ft[best[0] + k] = fi[best[1] + k] = False


def test_tiles_against_the_plain_algorithm():
    rng = random.Random(0)
    for _ in range(60):
        text, item = ([rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        got = tile(np.array(text, np.uint64), np.array(item, np.uint64), 3)
        assert got == greedy(text, item, 3)


def test_windows_are_equal_where_words_are():
    h = np.array([1, 2, 3, 1, 2, 3, 1, 2], np.uint64)
    for size in range(1, 9):
        w = windows(h, size)
        for i in range(len(w)):
            for j in range(len(w)):
                assert (w[i] == w[j]) == (h[i : i + size] == h[j : j + size]).all()


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(rng.randrange(8, 40))).capitalize() + ".") for i in range(20)] + [(50, "two words"), (51, None), (52, ""), (53, "...")]
    docs = []
    for i in range(120):
        w = prose(rng.randrange(5, 80))
        item = items[rng.randrange(20)][1].split()
        if i % 4 == 0:
            w[3:3] = item
        elif i % 4 == 1:
            cut = len(item) // 2
            w = w[:2] + item[cut:] + w[2:5] + item[:cut] + w[5:]
        elif i % 4 == 2:
            w[3:3] = item[: len(item) // 4]
        docs.append((i, " ".join(w), "x"))
    return docs + [(200, None, ""), (201, "", ""), (202, "Two, WORDS!", ""), (None, items[0][1], ""), (3, items[1][1], "")], items


def test_pairs_against_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, coverage string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([(r.doc_id, r.item_id, r.n_words, r.n_covered, r.n_tiles) for r in find_contamination(d, b).collect()], key=str)
    want = []
    for i, t, _ in docs:
        for j, s in items:
            x, y = tokens(t), tokens(s)
            seed = min(5, len(y))
            if not y or not {tuple(x[k : k + seed]) for k in range(len(x) - seed + 1)} & {tuple(y[k : k + seed]) for k in range(len(y) - seed + 1)}:
                continue
            tiles = greedy(x, y, min(3, len(y)))
            covered = sum(n for *_, n in tiles)
            if covered >= 0.5 * len(y):
                want.append((i, j, len(y), covered, len(tiles)))
    assert got == sorted(want, key=str)
    assert len({r[0] for r in got if r[0] is not None and r[0] < 120 and r[0] % 4 < 2}) == 60


def test_seeds_of_any_number_and_empty_tables(spark, monkeypatch):
    import quartzfolio.llm.decontamination as m

    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, coverage string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, find_contamination(d, b).collect()), key=str)
    monkeypatch.setattr(m, "BROADCAST_SEEDS", 10)
    assert sorted(map(tuple, find_contamination(d, b).collect()), key=str) == whole
    assert find_contamination(d.limit(0), b).collect() == [] == find_contamination(d, b.limit(0)).collect()


def test_a_phrase_that_all_share(spark):
    """One seed in every text and item: each pair once, and only covered ones stay."""
    phrase = "one very common phrase here"
    docs = [(i, f"a{i} b{i} {phrase} c{i}", "") for i in range(60)] + [(7, f"a7 b7 {phrase} c7", "")]
    items = [(i, f"{phrase} " + " ".join(f"k{i}x{j}" for j in range(i))) for i in range(1, 9)]
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string, row string"), spark.createDataFrame(items, "item_id long, text string"))
    found = sorted((r.doc_id, r.item_id, r.n_covered) for r in got.collect())
    assert found == sorted((d, i, 5) for d, _, _ in docs for i in range(1, 6))


def test_words_by_hand():
    h, first = words(pa.array(["Ab, ab!", "x-y É"]))
    assert h[0] == h[1] and first.tolist() == [0, 2, 5]
