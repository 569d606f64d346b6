import random
import zlib

import numpy as np
import pyarrow as pa

from quartzfolio.llm.language_id import identify, subwords, train

ALPHABETS = {"aa": ["the ", "and ", "ing "], "bb": ["què", "eux ", "oir "], "cc": ["und ", "sch", "keit "]}


def corpus(n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice(list(ALPHABETS))
        rows.append((i, "".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(5, 60))), lang, "x"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus() + [(900, None, "aa", ""), (901, "", None, ""), (902, "123 !?", "bb", ""), (None, "the and ing the", "aa", ""), (3, "und schkeit", None, ""), (903, "the " * 40000, None, "")]
    df = frame(spark, rows)
    got = identify(df, train(df, per_language=60)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(i, lang) for i, _, lang, _ in rows[:400] if zlib.crc32(str(i).encode()) % 5 == 0 and i != 3]
    assert np.mean([by_id[i][0].lang_pred == lang for i, lang in held]) > 0.98
    assert all(by_id[i][0].lang_pred == "und" and by_id[i][0].rejected and by_id[i][0].score == 0 for i in (900, 901, 902))
    assert by_id[903][0].lang_pred == "aa" and not by_id[903][0].rejected


def test_unlike_texts_are_rejected_and_clean_ones_stay(spark):
    """Letters unlike every learnt language fall under the calibrated limit; of the
    clean held-out texts, short ones included, few do."""
    rows = corpus(900)
    rng = random.Random(5)
    strange = [(5000 + i, "".join(rng.choice(["щука ", "жёлт", "ъезд ", "ωψφ ", "ξρδ "]) for _ in range(rng.randrange(5, 40))), None, "") for i in range(60)]
    df = frame(spark, rows + strange)
    got = {r.doc_id: r for r in identify(df, train(df)).collect()}
    held = [got[i] for i, *_ in rows if got[i].held_out]
    assert np.mean([r.rejected for r in held]) <= 0.02
    assert np.mean([got[i].rejected for i, *_ in strange]) >= 0.9
    assert all(got[i].lang_pred in ALPHABETS for i, *_ in strange)


def test_prediction_against_plain_sums(spark):
    """Scores from the folded table equal a plain softmax over each text's subwords."""
    import math

    rows = corpus(150)
    model = train(frame(spark, rows), per_language=40)
    for _, text, *_ in rows[:40]:
        h, first, _ = subwords(pa.array([text]))
        z = [(sum(float(model.table[x, j]) for x in h) / len(h) + model.bias[j]) / model.temperature for j in range(3)]
        p = [math.exp(v - max(z)) for v in z]
        best, score, rejected = model.predict(pa.array([text]))
        assert best[0] == p.index(max(p)) and math.isclose(score[0], max(p) / sum(p), rel_tol=1e-6)
        assert rejected[0] == (score[0] < model.limit)


def test_nothing_to_learn(spark):
    df = frame(spark, [(1, "some text", None, "")])
    assert [r.lang_pred for r in identify(df, train(df)).collect()] == ["und"]
    assert identify(df.limit(0), train(df.limit(0))).collect() == []


def test_subwords_stay_inside_words_and_texts():
    texts = ["Ab cde", "", "É-f"]
    h, first, lettered = subwords(pa.array(texts))
    assert lettered.tolist() == [True, False, True]
    for t, a, b in zip(texts, first[:-1], first[1:]):
        alone, _, _ = subwords(pa.array([t]))
        assert (alone == h[a:b]).all()
    words = [f" {w} ".encode() for w in ("ab", "cde")]
    three = sum(len(w) - 2 for w in words)
    four = sum(len(w) - 3 for w in words)
    assert first[1] == three + four
