import hashlib
import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_decontamination import greedy, tokens
from test_minhash import brute
from test_secrets import base

from quartzfolio.llm.language_id import train

LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def corpus():
    rng = random.Random(8)
    parts = {"en": ["the", "and", "ing", "tion", "er"], "fr": ["eux", "que", "oir", "è", "au"]}
    word = lambda k: "".join(rng.choice(parts[k]) for _ in range(rng.randrange(1, 4)))
    items = [(i, " ".join(word("en") for _ in range(20))) for i in range(5)]
    rows = []
    for i in range(160):
        k = rng.choice(["en", "fr"])
        w = [word(k) for _ in range(rng.randrange(10, 60))]
        if i % 9 == 1 and rows:
            w = rows[-1][1].split()[:-1] + [word(k)]
        if i % 11 == 2:
            w[2:2] = rng.choice(items)[1].split()
        if i % 7 == 3:
            w[1:1] = ['token="abcdefgh12345"', "deadbeef" * 4][: 1 + i % 2]
        rows.append((i, " ".join(w), k, "src", sum(map(len, w))))
    return rows + [(500, None, "en", None, None), (501, "", None, "s", 0), (502, "12345 !!", "en", "s", 8), (None, "the anding", "en", "s", 10), (7, rows[7][1], rows[7][2], "src", rows[7][4])], items


def mask(t):
    out, at = "", 0
    covered = [False] * len(t)
    for a, _, b in base(t):
        covered[a:b] = [True] * (b - a)
    while at < len(t):
        if covered[at]:
            out += "[SECRET]"
            while at < len(t) and covered[at]:
                at += 1
        else:
            out += t[at]
            at += 1
    return out


def test_run_against_plain_steps(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, f"file://{tmp_path}").collect()), key=str)
    import pyarrow as pa

    model = train(docs)
    left = [r for r in rows if not model.predict(pa.array([r[1]], pa.string()))[2][0]]
    gone = {r[0] for r in rows} - {r[0] for r in left}
    mixed = {i for i in range(160) if i % 11 == 2}  # a passage in another language
    assert {500, 501, 502} <= gone <= {500, 501, 502} | mixed and len(gone) <= 5
    marks = {}
    for d, _, _, kept in brute([(r[0], r[1]) for r in left]):
        marks[d] = marks.get(d, False) or kept
    left = [r for r in dict.fromkeys(left) if r[0] is None or marks[r[0]]]
    seeds = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    left = [r for r in left if not any(seeds(tokens(r[1])) & seeds(tokens(s)) and 2 * sum(n for *_, n in greedy(tokens(r[1]), tokens(s), 3)) >= len(tokens(s)) for _, s in items)]
    want = []
    for r in left:
        ids = LIB.encode(mask(r[1]), add_special_tokens=False).ids
        text = LIB.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_stage_columns(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").collect() == []
