import hashlib
import math
import random
import re
import zlib

import numpy as np

from quartzfolio.llm.importance import bucket_counts, gains, hashed_features, resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n=3, buckets=10_000):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    w = WORD.findall(low)
    return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, percent=5, min_words=20):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                side[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    rows = []
    for d, x in docs:
        n, found = features(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= min_words))
    good = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[2], r[1]))
    drawn = good[: percent * len(good) // 100]
    return sorted([(*r[:4], None) for r in rows if not r[4]] + [(*r[:4], i + 1 if i < len(drawn) else None) for i, r in enumerate(good)], key=str)


def corpus(seed, n=500):
    rng = random.Random(seed)
    words = ["the", "Of", "é", "Éa", "x1", "10", "run", "WALK", "ß", "日本"]
    rows = [(i, rng.choice([" ", ", ", "\n", "__"]).join(rng.choice(words[: rng.randrange(2, 11)]) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "!?"), (None, "the of " * 15), (None, "run é " * 15), (3, "walk 10 " * 12), (3, "walk 10 " * 12), (n + 3, "the run of x1 " * 20_000)]


def got(spark, docs, target, **more):
    df = spark.createDataFrame([(d, t, 0, "r") for d, t in docs], "doc_id long, text string, score int, rank string")
    return sorted(map(tuple, resample(df, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), **more).collect()), key=str)


def test_rows_against_plain_python(spark):
    target = ["run the WALK of 日本", None, "x1 x1 10"]
    docs = corpus(1)
    assert got(spark, docs, target) == plain(docs, target)
    assert got(spark, docs, target, percent=60, min_words=2) == plain(docs, target, 60, 2)


def test_empty_target_and_empty_documents(spark):
    docs = corpus(2, 60)
    assert got(spark, docs, []) == plain(docs, [])
    assert got(spark, [], ["a b"]) == []


def test_ring_against_joined_words(spark):
    df = spark.createDataFrame([(1, "A b, C d e"), (2, "A b")], "doc_id long, text string")
    for n, buckets in ((1, 50), (2, 10_000), (5, 100_000)):
        rows = hashed_features(df, n, buckets)
        assert {r.doc_id: r.n_features for r in rows.collect()} == {1: len(features("A b, C d e", n)[1]), 2: len(features("A b", n)[1])}
        want = np.bincount(features("A b, C d e", n, buckets)[1] + features("A b", n, buckets)[1], minlength=buckets)
        assert (bucket_counts(rows, buckets) == want).all()


def test_gains_are_smoothed_shares():
    assert gains(np.array([0, 9]), np.array([4, 0])).tolist() == [math.floor(1000 * math.log(5 * 11 / 6)), math.floor(1000 * math.log(11 / 60))]


def test_texts_like_the_target_are_drawn(spark):
    docs = [(i, ("alpha beta gamma " if i % 20 == 0 else "delta eps zeta ") * 10) for i in range(400)]
    ranks = [r for r in got(spark, docs, ["alpha beta gamma alpha"]) if r[4] is not None]
    assert len(ranks) == 20 and all(r[0] % 20 == 0 for r in ranks)
