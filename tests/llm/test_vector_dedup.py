import math

import numpy as np

from quartzfolio.llm.vector_dedup import near_vectors


def brute(rows, least=0.9):
    n = len(rows)
    ok = [v is not None and i is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    comp, links = list(range(n)), [0] * n

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    unit = [np.array(v) / np.linalg.norm(v) if k else None for (_, v), k in zip(rows, ok)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and (rows[i][1] == rows[j][1] or unit[i] @ unit[j] >= least):
                links[i] += 1
                links[j] += 1
                comp[find(i)] = find(j)
    least_id = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least_id[find(i)] = min(least_id.get(find(i), d), d)
    return sorted([(d, links[i], least_id[find(i)] if d is not None else None, d is None or least_id[find(i)] == d) for i, (d, _) in enumerate(rows)], key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int")
    return sorted(map(tuple, near_vectors(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def corpus():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(120):
        v = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 4))):
            rows.append((len(rows), np.float32(v + 0.1 * rng.standard_normal(16)).tolist()))
    v = rng.standard_normal(16)
    rows += [(len(rows) + i, np.float32(v + 0.15 * rng.standard_normal(16)).tolist()) for i in range(700)]
    k = len(rows)
    rows += [(k + i, rows[3][1]) for i in range(40)]
    k = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 8, [2.0] * 8, [None] + [1.0] * 15]
    return rows + [(k + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1]), (3, rows[3][1])]


def test_against_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_repeated_ids_keep_vectors_apart(spark):
    """An id with two unlike vectors: neither gets the other's links."""
    x, y, z = np.eye(16)[:3].tolist()
    rows = [(1, x), (1, y), (2, [1.0, 0.1] + [0.0] * 14), (3, [0.1, 1.0] + [0.0] * 14), (4, y), (5, z)]
    assert got(spark, rows) == brute(rows)
    assert {r[:3] for r in got(spark, rows)} >= {(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1)}
    rows = [(7, v) for _, v in corpus()[:200]]
    assert got(spark, rows) == brute(rows)


def test_recall_of_single_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        a = rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(32)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.92
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    rows += [(1000 + i, rng.standard_normal(32).tolist()) for i in range(3000)]
    linked = sum(r[1] for r in got(spark, rows, window=20) if r[0] < 1000)
    assert linked >= 0.95 * 600


def dense(n=1800, pairs=300, inside=0.87, least=0.905, d=64):
    """One topic, a third of the rows, of alike vectors with planted pairs above 0.9."""
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    topic = unit(rng.standard_normal(d))
    spread = lambda k: rng.standard_normal((k, d)) / math.sqrt(d)
    x = unit(math.sqrt(inside) * topic + math.sqrt(1 - inside) * spread(n))
    side = spread(pairs)
    a = x[:pairs]
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    x = np.concatenate([x, least * a + math.sqrt(1 - least**2) * side, unit(spread(2 * n))])
    return [(i, v) for i, v in enumerate(np.float32(x).tolist())]


def whole(rows, least=0.9):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (new == label).all():
            return sorted(((i, int(k), int(c), int(c) == i) for i, (k, c) in enumerate(zip(near.sum(1), label))), key=str)
        label = new


def test_dense_topic_misses_no_link(spark):
    rows = dense(inside=0.7)
    assert got(spark, rows, passes=2, window=4) == whole(rows)


def test_tiles_of_any_size_meet(spark, monkeypatch):
    import quartzfolio.llm.vector_dedup as m

    monkeypatch.setattr(m, "TILE_VALUES", 16 * 50)
    monkeypatch.setattr(m, "CHUNK", 3)
    rows = corpus()
    assert got(spark, rows, passes=1, window=1) == brute(rows)


def test_links_do_not_depend_on_partitions(spark):
    rows = dense(n=20, pairs=20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        assert got(spark, rows, passes=1) == whole(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty(spark):
    assert got(spark, []) == []
