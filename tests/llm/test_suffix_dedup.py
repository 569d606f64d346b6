import hashlib
import random

import numpy as np

from quartzfolio.llm.suffix_dedup import remove_repeats, window_minima


def brute(rows, match):
    seen = {}
    for i, t in rows:
        if i is None:
            continue
        b = (t or "").encode()
        for q in range(len(b) - match + 1):
            w = b[q : q + match]
            seen[w] = min(seen.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        if i is not None:
            for q in range(len(b) - match + 1):
                if seen[b[q : q + match]] < i:
                    gone[q : q + match] = [True] * match
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted([tuple(r[c] for c in cols) for r in remove_repeats(df, **more).collect()], key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["ab", "é", "the", "xyz", "🙂", "\x00", "qq"] + ["".join(rng.choice("abc") for _ in range(5)) for _ in range(20)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(30) for _ in range(4)]
    rows = [(i, text(rng.randrange(1, 30)) + rng.choice(shared) + text(rng.randrange(30)) + rng.choice([*shared, ""])) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (None, shared[0]), (3, shared[1] * 2), (n + 2, "a" * 400), (n + 3, "a" * 200), (n + 4, rows[0][1]), (n + 4, rows[0][1])]
    return rows


def test_against_brute_force(spark):
    rows = corpus(1)
    assert got(spark, rows) == brute(rows, 50)


def test_other_lengths(spark):
    rows = corpus(2, 25)
    assert got(spark, rows, match_bytes=20, anchor_bytes=9) == brute(rows, 20)


def test_long_text_and_small_blocks(spark, monkeypatch):
    import quartzfolio.llm.suffix_dedup as m

    monkeypatch.setattr(m, "PIECE", 700)
    rows = corpus(3, 20) + [(500, " ".join(t for _, t in corpus(3, 20) if t))]
    raw = [t.encode() for _, t in rows if t]
    text = np.frombuffer(b"".join(raw), np.uint8)
    off = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    doc, begin, count, _ = m.runs_of(text, off, 50, 20)
    want = {q for d in range(len(raw)) for q in range(off[d], off[d + 1] - 49)}
    have = [q for b, c in zip(begin, count) for q in range(b, b + c)]
    assert len(have) == len(set(have)) and set(have) == want
    assert all(off[d] <= b and b + c + 49 <= off[d + 1] for d, b, c in zip(doc, begin, count))


def test_empty_table(spark):
    assert got(spark, []) == []


def test_window_minima_is_the_class_minimum():
    rng = np.random.default_rng(0)
    segs = rng.integers(97, 99, (40, 24)).astype(np.uint8)
    lens = rng.integers(8, 25, 40)
    segs[np.arange(24) >= lens[:, None]] = 0
    owner = rng.integers(0, 1000, 40)
    out = window_minima(segs, lens, owner, 8)
    best = {}
    for s, n, o in zip(segs, lens, owner):
        for q in range(n - 7):
            w = s[q : q + 8].tobytes()
            best[w] = min(best.get(w, 9999), o)
    for i, (s, n) in enumerate(zip(segs, lens)):
        assert [best[s[q : q + 8].tobytes()] for q in range(n - 7)] == out[i, : n - 7].tolist()


def test_an_anchor_in_very_many_contexts(monkeypatch):
    """Windows dealt by content give the same minima as whole segments do."""
    import quartzfolio.llm.suffix_dedup as m

    rng = np.random.default_rng(1)
    segs = rng.integers(97, 99, (900, 56)).astype(np.uint8)
    segs[:, 18:38] = 122  # the anchor
    segs[::3, :40] = segs[0, :40]  # and a passage that many contexts hold
    lens = rng.integers(30, 57, 900)
    segs[np.arange(56) >= lens[:, None]] = 0
    owner = rng.permutation(900)
    whole = window_minima(segs, lens, owner, 30)
    monkeypatch.setattr(m, "HOT_SEGMENTS", 64)
    monkeypatch.setattr(m, "PIECE", 100)
    assert (m.bounded_minima(segs, lens, owner, 30) == whole).all()
