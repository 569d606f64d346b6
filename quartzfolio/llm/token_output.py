"""Token ids in Parquet list columns, in document order, and reading them back.

``write_tokens`` deals the documents into ranges of ids, sorts each range, encodes
it and lets Spark's Parquet writer put every document's ids into one list column.
Row groups and pages have given sizes; page indexes are written, so a read of some
documents, or of the metadata columns alone, touches only their pages. Ids are
dictionary-encoded (``encoding="dictionary"``), or delta-encoded with version 2
pages (``encoding="delta"``).

``read_tokens`` gives the documents back with their place in the whole id stream.
Only one row per file goes to the driver. Null text is empty text: the list holds
the end id alone. Null ids come first; rows that share an id follow their text. An
empty table gives files without rows and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import configure, id_text, partitions, string_bytes

ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"},
}


def write_tokens(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = 1,
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 64 << 10,
    compression: str = "zstd",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Writes doc_id, n_tokens and ids (array<int>) under ``path``; gives the path."""
    spark = documents.sparkSession
    configure(spark, 1000)
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, by_library=True)
        for batch in batches:
            ids, cuts, _ = coder.encode_bytes(*string_bytes(batch.column(1)))
            flat = (np.insert(ids, cuts[1:], tail[0]) if len(tail) else ids).view("<i4")
            cuts = (cuts + len(tail) * np.arange(len(cuts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(cuts), pa.int32()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))],
                ["doc_id", "n_tokens", "ids"],
            )

    docs = id_text(documents, id_col, text_col).withColumn("head", F.substring("text", 1, 64))
    # Rows that share an id, or have none, are split by how their texts begin.
    sorted_docs = docs.repartitionByRange(partitions(spark), "doc_id", "head").sortWithinPartitions("doc_id", "text")
    out = sorted_docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens int, ids array<int>")
    options = ENCODINGS[encoding] | {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "compression": compression}
    out.write.mode("overwrite").options(**options).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32."""
    schema = "doc_id long, n_tokens int, ids array<int>"
    files = spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    totals = files.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()  # one row a file
    before, at = [], 0
    for name, n in sorted((r.file, r.n) for r in totals):
        before.append((name, at))
        at += n
    offsets = spark.createDataFrame(before, "file string, before long")
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            cuts = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64()), batch.column(3), batch.column(4)],
                ["doc_id", "n_tokens", "ids_crc32", "file", "row"],
            )

    digests = files.mapInArrow(check, "doc_id long, n_tokens long, ids_crc32 long, file string, row long")
    placed = digests.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(offsets), "file")
    return placed.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id and ids of a range of documents; other pages are skipped."""
    out = spark.read.schema("doc_id long, n_tokens int, ids array<int>").parquet(path)
    if first is not None:
        out = out.where(F.col("doc_id") >= first)
    if last is not None:
        out = out.where(F.col("doc_id") <= last)
    return out.select("doc_id", "ids")
