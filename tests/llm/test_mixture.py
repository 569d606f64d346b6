import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from quartzfolio.llm import mixture
from quartzfolio.llm.mixture import mix

COLUMNS = ("doc_id", "source", "size", "source_size", "target", "taken")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Excess over a cap is shared out again until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        for s in open_:
            out[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if out[s] > epochs * sizes[s]:
                left += out[s] - epochs * sizes[s]
                out[s] = float(epochs * sizes[s])
                open_.remove(s)
    return out


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def corpus(seed, n=400, hot=0.5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < hot else rng.choice(["a", "Z", "é", "b", None, "tiny" if i < 9 else "a"])
        rows.append((i, rng.choice(["w ", "w3 ", "élève\n", "-- 9 "]) * rng.choice([0, 1, 5, 30, 90]), source))
    return rows + [(n, None, "a"), (n + 1, "", "hot"), (None, "x y z", "b"), (None, "x y", "b"), (7, "dup dup", "Z"), (7, "dup dup", "Z"), (n + 2, "", "void"), (n + 3, "w\t" * 30_000, "é")]


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in rows], "doc_id long, text string, source string, size int, taken int")
    return mix(df, **more)


def test_targets_and_sums(spark):
    for seed, hot in ((1, 0.5), (2, 0.95), (3, 0.0)):
        rows = corpus(seed, hot=hot)
        got = run(spark, rows).select(*COLUMNS).collect()
        assert len(got) == len(rows)
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + words(t)
        want = plain_targets(sizes)
        assert sorted(r.size for r in got) == sorted(words(t) for _, t, _ in rows)
        for s, size in sizes.items():
            mine = [r for r in got if r.source == s]
            assert all(r.source_size == size and math.isclose(r.target, want[s], abs_tol=1e-6) for r in mine)
            assert sum(r.taken for r in mine) == math.floor(mine[0].target + 0.5)
            assert all(0 <= r.taken <= 2 * r.size for r in mine)
            assert sum(r.taken % r.size > 0 for r in mine if r.size) <= 1  # the row at the border


def test_order_of_keys_decides(spark):
    """Epochs whole, then the smallest keys, each worked out in plain Python."""
    rows = [(i, f"text {i} " + "w " * (i % 7), "ab"[i % 2]) for i in range(300)]
    got = {r.doc_id: r for r in run(spark, rows, seed=9).collect()}
    for d, t, _ in rows:
        h = hashlib.sha256(f"9:{d}:{hashlib.sha256(t.encode()).hexdigest()}".encode()).hexdigest()
        letters, seen = sum(c.isalpha() for c in t), len("".join(t.split()))
        q = max(0.1, letters / seen)
        assert math.isclose(got[d].quality, q) and math.isclose(got[d].key, -math.log((int(h[:12], 16) + 0.5) / 2**48) / q)
    for s in "ab":
        mine = sorted((r for r in got.values() if r.source == s), key=lambda r: r.key)
        want = math.floor(mine[0].target + 0.5)
        whole, rest = divmod(want, mine[0].source_size)
        for r in mine:
            part = min(max(rest, 0), r.size)
            assert r.taken == whole * r.size + part
            rest -= part


def test_quality_raises_the_chance(spark):
    rows = [(i, "w " * 10, "s") for i in range(2000)]
    got = run(spark, rows, share=0.4, quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).collect()
    even = sum(r.taken for r in got if r.doc_id % 2 == 0)
    assert sum(r.taken for r in got) == 8000 and 0.65 < even / 8000 < 0.85


def test_bands_and_partitions_do_not_matter(spark, monkeypatch):
    rows = corpus(5)
    one = sorted(map(tuple, run(spark, rows).select(*COLUMNS).collect()), key=str)
    monkeypatch.setattr(mixture, "BAND_ROWS", 1)
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)
    assert sorted(map(tuple, mix(df).select(*COLUMNS).collect()), key=str) == one


def test_native(spark):
    plan = run(spark, corpus(1))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_empty_tables(spark):
    assert run(spark, []).collect() == []
    assert [(r.size, r.target, r.taken) for r in run(spark, [(1, None, None), (2, "", "s")]).collect()] == [(0, 0.0, 0)] * 2
