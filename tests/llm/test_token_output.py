import glob
import struct
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quartzfolio.llm.token_output import read_ids, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
ROWS = [(i * 7 % 101, f"Document {i} says hello, " * (i % 5), "x") for i in range(101)] + [(None, "none", "a"), (200, None, ""), (201, "", ""), (5, "again", "")]


def ids(t):
    return [*LIB.encode(t or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, tmp_path, encoding):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    path = write_tokens(df, f"file://{tmp_path}/t", PATH, encoding=encoding)
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for i, t, _ in rows:
        x = ids(t)
        want.append((i, at, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
        at += len(x)
    assert sorted(map(tuple, read_tokens(spark, path).collect()), key=lambda r: r[1]) == want
    some = {r.doc_id: r.ids for r in read_ids(spark, path, 10, 12).collect()}
    assert some == {i: ids(t) for i, t, _ in ROWS if i in (10, 11, 12)}
    metas = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/t/*.parquet")]
    columns = [m.row_group(0).column(2) for m in metas if m.num_row_groups]
    assert all(c.has_offset_index for c in columns)
    assert any("DICTIONARY" in str(c.encodings) for c in columns) == (encoding == "dictionary")
    assert any("DELTA" in str(c.encodings) for c in columns) == (encoding == "delta")


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    path = write_tokens(df, f"file://{tmp_path}/t", PATH)
    assert read_tokens(spark, path).collect() == []
