"""Factor archives of a snapshot as a Spark data source.

``spark.read.format("factor_archives").option("path", root).load()`` reads every factor
archive that a snapshot's manifest declares: path (relative to the snapshot, so two
files of one name are told apart), vintage, period_month, factor, ret. An archive is a
partition, parsed where it is read. Filters on the month are pushed down: an archive
whose declared months lie outside them is no partition at all, and in the others the
rows outside are skipped before they become rows. Filters on path and factor are pushed
alike. Every pushed filter is applied in full; others stay with Spark.

The root may be a folder all executors share or an address that ``pyarrow.fs`` opens.
A file that is missing or not an archive raises, a snapshot without archives refuses.
"""

from __future__ import annotations

import datetime as dt
import json
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import DataStop, ManifestError

NAME, SCHEMA = "factor_archives", "path string, vintage string, period_month date, factor string, ret double"
_ARROW = pa.schema([("path", pa.string()), ("vintage", pa.string()), ("period_month", pa.date32()), ("factor", pa.string()), ("ret", pa.float64())])
_ORDER = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, EqualTo: operator.eq}


def _read(root: str, path: str) -> bytes:
    where, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    with where.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
        return stream.read()


@dataclass
class Archive(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.tests = root, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, kind = getattr(f, "attribute", None), type(f)
            if column in (("period_month",), ("path",), ("factor",)) and kind in _ORDER:
                self.tests.append((column[0], kind.__name__, f.value))
            elif column in (("period_month",), ("path",), ("factor",)) and kind is In:
                self.tests.append((column[0], "In", tuple(f.value)))
            else:
                yield f

    def _meets(self, column: str, value) -> bool:
        named = {k.__name__: v for k, v in _ORDER.items()} | {"In": lambda a, b: a in b}
        return all(named[kind](value, other) for c, kind, other in self.tests if c == column)

    def _may_meet(self, first: dt.date, last: dt.date) -> bool:
        """Whether some month of a declared range can pass the filters."""
        for column, kind, other in self.tests:
            if column != "period_month":
                continue
            if kind == "In":
                if not any(first <= x <= last for x in other):
                    return False
            elif not {"GreaterThan": last > other, "GreaterThanOrEqual": last >= other, "LessThan": first < other, "LessThanOrEqual": first <= other, "EqualTo": first <= other <= last}[kind]:
                return False
        return True

    def partitions(self) -> list[Archive]:
        try:
            manifest = json.loads(_read(self.root, "manifest.json"))
        except FileNotFoundError as e:
            raise ManifestError(f"no manifest in {self.root}") from e
        declared = [e for e in manifest["files"] if e["role"] == "factor"]
        if not declared:
            raise DataStop("missing file", "no factor archive")
        day = lambda text: dt.date.fromisoformat(text if len(text) > 7 else f"{text}-01")
        return [Archive(e["path"]) for e in declared if self._meets("path", e["path"]) and (not e.get("first") or self._may_meet(day(e["first"]), day(e["last"])))]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        from .snapshot import parse_archive

        if partition is None:  # no archive is left
            return
        rows, vintage = parse_archive(_read(self.root, partition.path))
        kept = [(partition.path, vintage, m, n, v) for m, n, v in ((dt.date.fromisoformat(m), n, v) for m, n, v in rows) if self._meets("period_month", m) and self._meets("factor", n)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*kept, strict=True) if kept else [()] * 5, _ARROW, strict=True)], schema=_ARROW)


class FactorArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        if not self.options.get("path"):
            raise ManifestError("name the snapshot's folder in path")
        return ArchiveReader(self.options["path"])


def read_factor_archives(spark: SparkSession, root: str) -> DataFrame:
    """All declared archives of a snapshot. Registers the source, and lets Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FactorArchives)
    return spark.read.format(NAME).option("path", str(root)).load()
