import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quartzfolio.llm.bpe import Encoder, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
MINE = Encoder(PATH)
HARD = ["", " ", " ", "a b", "<|endoftext|>", "x<|startoftext|>y <|endoftext|", "I'LL we're 'tis don't'd", "É é é", "́x", "ΣΑΣ", "İI", "12.5%", "\x1c\x1d a\x00b", "日本語 テスト", "🙂🙂 !!??", "</w> w</w>", "ß×÷ª²", "a" * 500, "thethe" * 80, " line ", "ﬁ ǅ"]


LIKE_IT = Encoder(PATH)
LIKE_IT.by_library = True


def same(texts):
    assert LIKE_IT.encode([t.encode() for t in texts])[0] == MINE.encode([t.encode() for t in texts])[0]
    ids, back = MINE.encode([t.encode() for t in texts], decoded=True)
    for t, i, b in zip(texts, ids, back):
        want = LIB.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(i) // 4}I", i)) == want, t
        assert b == LIB.decode(want, skip_special_tokens=False) == MINE.decode(i)


def test_hard_texts():
    same(HARD)
    same([" ".join(HARD), "\n".join(HARD)])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    same([t])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeinorstuTHE' .é", max_size=80))
def test_like_prose(t):
    same([t])


def test_every_token_alone():
    same([t.removesuffix("</w>") for t in list(MINE.table.ids)[::7]])


def test_very_long_words():
    """Memory and time stay in proportion to the letters of a word."""
    import random
    import tracemalloc

    rng = random.Random(3)
    texts = ["a" * 1_000_000, "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)), "the" * 100_000 + " x" + "é" * 50_000]
    ids, _ = MINE.encode([t.encode() for t in texts])
    for t, i in zip(texts, ids):
        assert list(struct.unpack(f"<{len(i) // 4}I", i)) == LIB.encode(t, add_special_tokens=False).ids
    MINE.forget()
    tracemalloc.start()
    MINE.encode([texts[1][:300_000].encode()])
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    MINE.forget()


def test_memory_starts_anew(monkeypatch):
    import quartzfolio.llm.bpe as m

    monkeypatch.setattr(m, "CACHE", 5)
    same(["one two three four", "five six seven one", "two eight nine ten eleven twelve"] * 3)


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(None, "null id", ""), (1, None, ""), (1, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_decode(df, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id and r.doc_id > 1:
            want = LIB.encode(HARD[r.doc_id], add_special_tokens=False).ids
            assert r.n_tokens == len(want)
            assert hashlib.sha256(r.ids).hexdigest() == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    assert encode_decode(df.limit(0), PATH).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_files_are_refused(name):
    with pytest.raises(ValueError):
        Encoder(public_tokenizers.path(name))
