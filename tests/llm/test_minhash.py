import random
import re

import numpy as np
import pyarrow as pa

from quartzfolio.llm.components import connected_components
from quartzfolio.llm.common import Scratch
from quartzfolio.llm.minhash import BUCKETS, estimate, near_duplicates, registers
from quartzfolio.llm.shingles import mix, shingle_sets


def words_of(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def brute(rows, percent=75):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, len(s), least[find(i)] if d is not None else None, d is None or least[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def got(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, regs string")
    return sorted(map(tuple, near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 6)))
    rows = []
    for i in range(n):
        if i % 3 and rows:
            w = words_of(rng.choice(rows)[1])
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w += [word()]
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 8, 12, 40, 150])))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, rows[0][1]), (None, "x"), (n + 3, rows[0][1].upper()), (0, rows[0][1])]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(spark, rows) == brute(rows)


def test_hot_groups(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(200)]
    for i in range(200, 420):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    assert got(spark, rows) == brute(rows)


def test_repeated_ids_lose_no_link(spark):
    """An id with two texts: each text keeps the links of its own."""
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(5, x), (5, y), (7, x.rsplit(" ", 1)[0]), (8, y.rsplit(" ", 1)[0]), (3, x + " more"), (9, "else a b c d e f")]
    assert got(spark, rows) == brute(rows)
    assert (8, 55, 5, False) in got(spark, rows) and (7, 55, 3, False) in got(spark, rows)


def test_one_id_for_all_texts(spark):
    rows = [(4, t) for _, t in corpus(3, 60)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 0.9):
        pool = mix(rng.integers(0, 2**63, 3000).astype(np.uint64))
        k = int(share * 3000)
        rest = (3000 - k) // 2
        a, b = np.sort(pool[: k + rest]), np.sort(np.r_[pool[:k], pool[k + rest :]])
        x, y = registers(a)[0], registers(b)[0]
        assert abs(estimate(x[None], y[None])[0] - k / 3000) < 6 * np.sqrt(share * (1 - share) / BUCKETS)


def test_shingles_split_at_ascii_space_only():
    x, y, z = shingle_sets(pa.array(["a\x0bB c\td\re f", "A b\nC d\x0ce\x20F", "a b c d e\xa0f"]))
    assert (x == y).all() and len(x) == 2 and len(z) == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in connected_components(df, Scratch(spark, "t")).collect()} == {x: find(x) for x in list(parent)}
