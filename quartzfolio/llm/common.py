"""Helpers shared by the corpus operators: shared scratch tables, packing, batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker; bounds its memory.
ARROW_ROWS, ARROW_BYTES = 250, 4 << 20


def configure(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Python worker gets at once (whole rows; nothing is dropped)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    with contextlib.suppress(Exception):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only where the session names none, and
    then only on a local master."""
    jsc = spark.sparkContext._jsc.sc()
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(told)
        return told
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quartzfolio-"))
    return jsc.getCheckpointDir().get()


class Scratch:
    """Intermediate tables, written to the shared folder and read back.

    A written table cuts lineage and outlives any executor. ``drop`` removes one
    that no pending result reads; the rest go when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._forget)

    def save(self, frame: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.base}/{name}-{self.count}"
        frame.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(getattr(frame, "_scratch_path", None))

    def _delete(self, path: str | None) -> None:
        if path:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _forget(self) -> None:
        with contextlib.suppress(Exception):
            self._delete(self.base)


def sweep(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def released(run):
    """``run`` over batches, and at a task's end its memory goes back to the system: the
    worker lives on and waits beside whatever the executor does next."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            from .shingles import forget

            forget()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, compressed: count, then (dtype, length) each."""
    head = [np.array([len(arrays)], "<u4").tobytes()]
    head += [a.dtype.str.encode().ljust(4) + np.array([len(a)], "<u8").tobytes() for a in arrays]
    raw = b"".join(head + [np.ascontiguousarray(a).tobytes() for a in arrays])
    return np.array([len(raw)], "<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int(np.frombuffer(data[:8], "<u8")[0]), codec="zstd", asbytes=True)
    count = int(np.frombuffer(raw[:4], "<u4")[0])
    at, out = 4 + 12 * count, []
    for i in range(count):
        kind = np.dtype(raw[4 + 12 * i : 8 + 12 * i].decode().strip())
        n = int(np.frombuffer(raw[8 + 12 * i : 16 + 12 * i], "<u8")[0])
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (length n + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_string())
    off = np.frombuffer(wide.buffers()[1], "<i8")[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def id_text(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that matter, under fixed names: extra ones can't clash."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def py_fold(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus
