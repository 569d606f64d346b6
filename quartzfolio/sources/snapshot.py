"""Frozen snapshots: manifest, hashes, CSV legs, rate series and factor archives."""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataStop, ManifestError, SourceFormatError
from ..operators.calendar import add_availability
from ..operators.returns import first_by

FILE_FIELDS = ("path", "role", "source", "url", "retrieved", "rows", "first", "last", "sha256")
INSTRUMENT_FIELDS = ("isin", "ter", "income_policy", "replication", "fund_size", "currency")
PRICE_SCHEMA = "date date, close double, adj_close double, dividend double"
RATE_SCHEMA = "KEY string, TIME_PERIOD date, OBS_VALUE double"
#: A factor archive's mark for a missing value (fixed value).
MISSING = -99.99


def snapshot_root(base: str, explicit: str | None = None, variable: str = "QUARTZFOLIO_SNAPSHOT") -> Path:
    """The named folder, else the environment's, else the newest dated one; never a mix."""
    if explicit or os.environ.get(variable):
        return Path(explicit or os.environ[variable])
    dated = sorted(p for p in Path(base).iterdir() if p.is_dir() and re.fullmatch(r"\d{4}-\d{2}-\d{2}", p.name))
    if not dated:
        raise ManifestError(f"no dated snapshot under {base}")
    return dated[-1]


def relative(root: Path, column: str) -> Column:
    """A file's address as the manifest names it: its path under the snapshot's folder."""
    plain = F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))
    return F.substring_index(plain, f"{os.path.abspath(root)}/", -1)


def file_hashes(spark: SparkSession, root: Path, paths: list[str]) -> DataFrame:
    """path (under the snapshot) and SHA-256 of each file, hashed where the file is read."""
    found = spark.read.format("binaryFile").load([str(root / p) for p in paths])
    return found.select(relative(root, "path").alias("path"), F.sha2("content", 256).alias("sha256"))


def read_prices(spark: SparkSession, root: Path, entries: list[dict], kind: str = "price") -> DataFrame:
    """One read of all files of a role, joined with what the manifest says of each."""
    if not entries:
        raise DataStop("missing file", f"no {kind} file")
    rows = spark.read.csv([str(root / e["path"]) for e in entries], schema=PRICE_SCHEMA, header=True, enforceSchema=False)
    named = spark.createDataFrame([(e["path"], e["instrument"], e["currency"]) for e in entries], "file string, instrument string, currency string")
    rows = rows.withColumn("file", relative(root, "_metadata.file_path")).join(F.broadcast(named), "file")
    rows = rows.select("instrument", F.col("date").alias("period_month"), "close", F.coalesce("adj_close", "close").alias("adj_close"), F.coalesce("dividend", F.lit(0.0)).alias("dividend"), "currency", F.lit(kind).alias("kind"))
    return add_availability(rows)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """day, pct of a daily series; of repeated days the first row stays."""
    rows = spark.read.csv(path, schema=RATE_SCHEMA, header=True).withColumn("_row", F.monotonically_increasing_id())
    return first_by(rows, ["TIME_PERIOD"], [F.col("_row")]).select(F.col("TIME_PERIOD").alias("day"), F.col("OBS_VALUE").alias("pct"))


def parse_archive(content: bytes) -> tuple[list[tuple[str, str, float | None]], str | None]:
    """(month, factor, value as a fraction) of the monthly block, and the vintage.

    The header is the first line that starts with a comma; the block ends at the
    first row that does not start with six digits.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            text = archive.read(archive.namelist()[0]).decode("latin-1")
    except (zipfile.BadZipFile, IndexError) as e:
        raise SourceFormatError(str(e)) from e
    lines = text.splitlines()
    vintage = re.search(r"created .*?using (?:the )?(\S+)", lines[0]) if lines else None
    start = next((i for i, x in enumerate(lines) if x.startswith(",")), None)
    if start is None:
        raise SourceFormatError("no header line")
    names, out = [n.strip() for n in lines[start].split(",")[1:]], []
    for line in lines[start + 1 :]:
        first, *cells = (c.strip() for c in line.split(","))
        if not re.fullmatch(r"\d{6}", first):
            break
        try:
            values = [None if abs(float(c) - MISSING) < 1e-9 else float(c) / 100 for c in cells]
            if len(values) != len(names):
                raise ValueError(f"{len(values)} values of {len(names)}")
        except ValueError as e:
            raise SourceFormatError(f"{first}: {e}") from e
        if any(v is not None for v in values):
            out += [(f"{first[:4]}-{first[4:]}-01", n, v) for n, v in zip(names, values, strict=True)]
    return out, vintage[1] if vintage else None


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file (its whole address), period_month, factor, ret of factor archives, parsed where they are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, c in zip(batch["path"], batch["content"], strict=True) for r in parse_archive(bytes(c))[0]]
            yield pd.DataFrame(rows, columns=["file", "month", "factor", "ret"])

    found = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "file string, month string, factor string, ret double")
    return found.select("file", F.to_date("month").alias("period_month"), "factor", "ret")


def measure(spark: SparkSession, root: Path, entries: list[dict]) -> DataFrame:
    """path, rows, first, last of each declared file, in one job per format; a file without
    a dated row has none and no dates."""
    csv = [str(root / e["path"]) for e in entries if e["path"].endswith(".csv")]
    zips = [str(root / e["path"]) for e in entries if e["path"].endswith(".zip")]
    out = spark.createDataFrame([], "path string, rows long, first string, last string")
    if csv:
        lines = spark.read.text(csv).withColumn("path", relative(root, "_metadata.file_path"))
        day = F.regexp_extract("value", r"(?:^|,)(\d{4}-\d{2}-\d{2})(?:,|$)", 1)
        dated = lines.select("path", day.alias("day")).where("day <> ''")
        out = out.unionByName(dated.groupBy("path").agg(F.count("*").alias("rows"), F.min("day").alias("first"), F.max("day").alias("last")))
    if zips:
        months = read_archives(spark, zips).select(relative(root, "file").alias("path"), F.date_format("period_month", "yyyy-MM").alias("m")).distinct()
        out = out.unionByName(months.groupBy("path").agg(F.count("*").alias("rows"), F.min("m").alias("first"), F.max("m").alias("last")))
    paths = spark.createDataFrame([(e["path"],) for e in entries], "path string")
    return paths.join(out, "path", "left").select("path", F.coalesce("rows", F.lit(0)).alias("rows"), "first", "last")


def build_manifest(spark: SparkSession, root: Path, entries: list[dict], instruments: dict, created: str, **extra) -> dict:
    """Measures the declared files and writes manifest.json; ``extra`` may override."""
    sizes = {r.path: r.asDict() for r in measure(spark, root, entries).collect()}
    hashes = {r.path: r.sha256 for r in file_hashes(spark, root, [e["path"] for e in entries]).collect()}
    files = [e | {k: sizes[e["path"]][k] for k in ("rows", "first", "last")} | {"sha256": hashes[e["path"]]} for e in entries]
    manifest = {"snapshot_id": root.name, "created": created, "files": files, "instruments": instruments} | extra
    (root / "manifest.json").write_text(json.dumps(manifest, indent=1, sort_keys=True))
    return manifest


def read_manifest(root: Path) -> dict:
    if not (root / "manifest.json").exists():
        raise ManifestError(f"no manifest in {root}")
    return json.loads((root / "manifest.json").read_text())


def verify(spark: SparkSession, root: Path) -> dict:
    """The manifest, if every file is there, unchanged, as long as declared, and every
    price line has its facts; refuses otherwise."""
    manifest = read_manifest(root)
    if not manifest.get("files") or not manifest.get("instruments"):
        raise ManifestError("the manifest lacks files or instruments")
    for e in manifest["files"]:
        if absent := [k for k in FILE_FIELDS if e.get(k) in (None, "")]:
            raise ManifestError(f"{e.get('path')}: no {', '.join(absent)}")
        if not (root / e["path"]).exists():
            raise ManifestError(f"{e['path']}: missing")
        if e["role"] == "price":
            facts = manifest["instruments"].get(e.get("instrument"), {})
            if absent := [k for k in INSTRUMENT_FIELDS if not facts.get(k)]:
                raise DataStop("manifest mismatch", f"{e.get('instrument')}: no {', '.join(absent)}")
    declared = {e["path"]: (e["rows"], e["first"], e["last"]) for e in manifest["files"]}
    hashes = {r.path: r.sha256 for r in file_hashes(spark, root, list(declared)).collect()}
    for e in manifest["files"]:
        if hashes.get(e["path"]) != e["sha256"]:
            raise ManifestError(f"{e['path']}: its hash differs")
    for r in measure(spark, root, manifest["files"]).collect():
        if (r.rows, r["first"], r["last"]) != declared[r.path]:
            raise ManifestError(f"{r.path}: rows or dates differ")
    return manifest
