"""Small results that several steps read: written once, read back by each.

A written table cuts the plan, so a fact table behind it is scanned once however many
steps follow, and it outlives any executor. Inside a ``scope`` a result is written the
first time it is asked for; scopes keep nothing for each other, so a later query reads
its tables anew.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_HELD: ContextVar[dict | None] = ContextVar("held", default=None)
_WRITTEN: list[str] = []


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Results are shared until the outermost scope ends."""
    if _HELD.get() is not None:
        yield
        return
    token = _HELD.set({})
    try:
        yield
    finally:
        _HELD.reset(token)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only
    on a local master."""
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    found = context._jsc.sc().getCheckpointDir()
    if not found.isEmpty():
        return found.get()
    if not context.master.startswith("local"):
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quartzfolio-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame's rows from a table in the shared folder."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _WRITTEN.append(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes every table written so far and says how many: for a long session, between
    queries whose results have been read."""
    gone = 0
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
        gone += 1
    held = _HELD.get()
    if held:
        held.clear()
    return gone


def once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a written table, the same one for equal keys of a scope."""
    held = _HELD.get()
    if held is None:
        return written(build(), str(key[0]))
    key = (spark.sparkContext.applicationId, *key)
    if key not in held:
        held[key] = written(build(), str(key[1]))
    return held[key]


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
