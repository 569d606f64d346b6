import random
import re
import zlib

import numpy as np

from quartzfolio.llm.quality import FEATURES, classify, statistics


def corpus(n=500):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(1, 80))]
        bad = rng.random() < 0.3
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        rows.append((i, text, "x"))
        labels.append((i, 0 if bad else 1, None))
    return rows, labels


def run(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(None, "text", ""), (700, None, ""), (701, "", ""), (5, "again and again", ""), (702, "word " * 50000, "")]
    got = run(spark, rows + odd, labels + [(800, 1, 0), (1, None, 0), (None, 1, 0), (2, 7, 0)])
    assert len(got) == len(rows) + len(odd)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_scores_against_plain_densities(spark):
    """Log densities of both classes by inverses and determinants, from all training rows."""
    rows, labels = corpus(200)
    truth = {i: y for i, y, _ in labels}
    x = {}
    for i, t, _ in rows:
        raw = t.encode()
        x[i] = statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    train = [i for i in x if zlib.crc32(str(i).encode()) % 5]
    by = [np.array([x[i] for i in train if truth[i] == k]) for k in (0, 1)]
    cov = [np.cov(b, rowvar=False) for b in by]
    both = sum(c * (len(b) - 1) for c, b in zip(cov, by)) / (len(train) - 2)
    shrunk = [0.88 * c + 0.1 * both + 0.02 * np.diag(np.maximum(np.diag(both), 1e-8)) for c in cov]

    def density(v, k):
        r = v - by[k].mean(0)
        return -0.5 * r @ np.linalg.inv(shrunk[k]) @ r - 0.5 * np.linalg.slogdet(shrunk[k])[1] + np.log(len(by[k]))

    for r in run(spark, rows, labels):
        z = density(x[r.doc_id], 1) - density(x[r.doc_id], 0)
        assert np.isclose(r.score, 1 / (1 + np.exp(-np.clip(z, -700, 700))), rtol=1e-6, atol=1e-9)


def test_without_labels(spark):
    assert [(r.score, r.predicted) for r in run(spark, [(1, "a b", "")], [])] == [(0.5, 1)]
    assert run(spark, [], []) == []


def test_statistics_by_hand():
    texts = ["The CAT sat. The dog!!\nOk", "", "aaa"]
    raw = [t.encode() for t in texts]
    x = statistics(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    names = dict(zip(FEATURES, x[0]))
    words = re.findall(r"\S+", texts[0])
    assert np.isclose(names["log_bytes"], np.log1p(len(texts[0])))
    assert np.isclose(names["upper"] ** 2, sum(c.isupper() for c in texts[0]) / len(texts[0]))
    assert np.isclose(names["word_mean"], np.log1p(np.mean([len(w) for w in words])))
    assert np.isclose(names["word_sd"], np.log1p(np.std([len(w) for w in words])))
    assert np.isclose(names["distinct_words"], len({w.lower() for w in words}) / len(words))
    assert np.isclose(names["marked_words"] ** 2, 1 / len(words))
    assert (x[1] == [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]).all()
