"""The archives' data source: partitions, pushed filters, paths and refusals."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, Not, StringStartsWith

from quartzfolio.errors import DataStop, ManifestError
from quartzfolio.sources.archives import ArchiveReader, read_factor_archives


def zipped(names, first, months, scale=1.0):
    rows = [f"{first + i // 12}{i % 12 + 1:02}," + ",".join(f"{scale * (i + j):.2f}" for j in range(len(names))) for i in range(months)]
    text = "This file was created by hand using the 202607 database\n\n," + ",".join(names) + "\n" + "\n".join(rows) + "\n\n Annual\n"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.csv", text)
    return data.getvalue()


@pytest.fixture
def root(tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "new").mkdir()
    (tmp_path / "old" / "f.zip").write_bytes(zipped(["A", "B"], 1990, 24))
    (tmp_path / "new" / "f.zip").write_bytes(zipped(["A", "C"], 2000, 24, 2.0))  # the same name in another folder
    files = [{"path": "old/f.zip", "role": "factor", "first": "1990-01", "last": "1991-12"}, {"path": "new/f.zip", "role": "factor", "first": "2000-01", "last": "2001-12"}, {"path": "p.csv", "role": "price"}]
    (tmp_path / "manifest.json").write_text(json.dumps({"files": files}))
    return tmp_path


def test_every_archive_is_a_partition(spark, root):
    rows = read_factor_archives(spark, root)
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == 96
    got = {(r.path, r.factor): (r.n, r["first"], r.v) for r in rows.groupBy("path", "factor").agg(F.count("*").alias("n"), F.min("period_month").alias("first"), F.min("vintage").alias("v")).collect()}
    assert got == {("old/f.zip", "A"): (24, dt.date(1990, 1, 1), "202607"), ("old/f.zip", "B"): (24, dt.date(1990, 1, 1), "202607"), ("new/f.zip", "A"): (24, dt.date(2000, 1, 1), "202607"), ("new/f.zip", "C"): (24, dt.date(2000, 1, 1), "202607")}
    assert sorted(r.ret for r in rows.where("path = 'new/f.zip' and factor = 'C'").limit(30).collect())[:2] == [0.02, 0.04]


def test_months_prune_archives_and_rows(spark, root):
    rows = read_factor_archives(spark, root)
    late = rows.where("period_month >= '2001-07-01' and factor = 'C'")
    assert late.rdd.getNumPartitions() == 1 and {r.path for r in late.collect()} == {"new/f.zip"} and late.count() == 6
    assert rows.where("period_month = '1990-03-01'").count() == 2 and rows.where("period_month < '1990-01-01'").count() == 0
    assert rows.where("period_month in ('1991-01-01', '2001-01-01')").count() == 4
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert ">=" not in plan and "isnotnull" in plan  # only what the source does not take is left to Spark


def test_pushed_filters_are_those_applied_in_full(root):
    reader = ArchiveReader(str(root))
    kept = [StringStartsWith(("factor",), "A"), EqualTo(("ret",), 0.1), Not(EqualTo(("factor",), "A"))]
    pushed = [GreaterThanOrEqual(("period_month",), dt.date(1991, 1, 1)), LessThan(("period_month",), dt.date(2000, 1, 1)), In(("factor",), ("A", "B"))]
    assert list(reader.pushFilters(kept + pushed)) == kept
    (only,) = reader.partitions()
    assert only.path == "old/f.zip"
    (batch,) = reader.read(only)
    assert batch.num_rows == 24 and set(batch.column("factor").to_pylist()) == {"A", "B"}


def test_refusals(spark, root, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(ManifestError):
        ArchiveReader(str(tmp_path / "none")).partitions()
    (tmp_path / "none" / "manifest.json").write_text(json.dumps({"files": [{"path": "p.csv", "role": "price"}]}))
    with pytest.raises(DataStop):
        ArchiveReader(str(tmp_path / "none")).partitions()
    (root / "old" / "f.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="SourceFormatError|not a zip"):
        read_factor_archives(spark, root).collect()
