"""A verified snapshot as one document: every leg read, gated, trimmed and joined."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataStop
from ..operators import calendar as C
from ..operators import quality as Q
from ..operators import returns as R
from . import snapshot as S
from .archives import read_factor_archives
from .scratch import once, scope

#: Roles and file names of a snapshot, and the column that is no factor (fixed values).
SPOT, LEG_A, LEG_B = "ecb_eurusd", "ecb_eonia", "ecb_estr"
DEVELOPED, MOMENTUM, EUROPE = "Developed_5_Factors", "Developed_MOM_Factor", "Europe_5_Factors"
RENAMED, NOT_A_FACTOR = {"WML": "MOM"}, ("RF",)
#: The declared window and the day the overnight rate changes its leg (fixed values).
WINDOW_START, WINDOW_END, SPLICE = "2010-09-01", "2026-08-01", "2019-10-01"


def entries(manifest: dict, role: str) -> list[dict]:
    """The files of a role; refuses a role without any."""
    found = [e for e in manifest["files"] if e.get("role") == role]
    if not found:
        raise DataStop("missing file", f"no file with role {role}")
    return found


def role_path(root: Path, manifest: dict, role: str) -> str:
    return str(root / entries(manifest, role)[0]["path"])


@dataclass(frozen=True)
class Factors:
    """Long factor sets (factor, period_month, ret) and the rate behind the euro one."""

    usd: DataFrame
    eur: DataFrame
    europe_usd: DataFrame
    fx_level: DataFrame
    untranslated: DataFrame


def load_factors(spark: SparkSession, root: Path, manifest: dict) -> Factors:
    """The spine and momentum on the months both have, quoted and in euro; the regional
    cut beside them; months without a rate are listed, not filled."""
    files = entries(manifest, "factor")
    if len(files) < 2:
        raise DataStop("missing file", "fewer than two factor archives")
    named = {}
    for part in (DEVELOPED, MOMENTUM, EUROPE):
        match = [e["path"] for e in files if part in e["path"]]
        if not match:
            raise DataStop("missing file", f"no factor archive {part}")
        named[part] = match[0]
    rows = once(spark, ("archives", str(root)), lambda: read_factor_archives(spark, str(root)).select(F.col("path").alias("file"), "period_month", "factor", "ret"))
    own = {part: rows.where(F.col("file") == name).drop("file") for part, name in named.items()}
    factor = F.col("factor")
    for old, new in RENAMED.items():
        factor = F.when(F.col("factor") == old, new).otherwise(factor)
    momentum = own[MOMENTUM].withColumn("factor", factor)
    both = R.joined_months(own[DEVELOPED], momentum)
    usd = own[DEVELOPED].unionByName(momentum).join(both, "period_month", "left_semi")
    level = R.monthly_last(S.read_rates(spark, role_path(root, manifest, SPOT)))
    fx = level.select(F.lit("USD").alias("currency"), "period_month", F.col("level").alias("close"))
    known = R.monthly_returns(fx, "currency", "close").select("period_month")
    untranslated = usd.select("period_month").distinct().join(known, "period_month", "left_anti")
    return Factors(usd, to_euro(usd, fx), own[EUROPE], fx, untranslated)


def to_euro(factors: DataFrame, fx: DataFrame) -> DataFrame:
    """A factor set in euro, on the months the rate covers."""
    covered = factors.join(R.monthly_returns(fx, "currency", "close").select("period_month"), "period_month", "left_semi")
    return R.eur_translate(covered, fx).select("factor", "period_month", F.col("eur").alias("ret"))


def cross_check(factors: Factors) -> DataFrame:
    """The regional cut without momentum, in euro: the same results on other data."""
    return to_euro(factors.europe_usd.where(~F.col("factor").isin(*NOT_A_FACTOR)), factors.fx_level)


@dataclass(frozen=True)
class RiskFree:
    daily: DataFrame
    monthly: DataFrame
    basis: DataFrame


def load_risk_free(spark: SparkSession, root: Path, manifest: dict, splice: str = SPLICE) -> RiskFree:
    """The overnight rate of both legs, spliced and accrued, and the basis between them."""
    a, b = (S.read_rates(spark, role_path(root, manifest, role)).withColumn("leg", F.lit(leg)) for role, leg in ((LEG_A, "A"), (LEG_B, "B")))
    legs = a.unionByName(b)
    daily = R.splice(legs, splice)
    return RiskFree(daily, R.accrue_monthly(daily), R.splice_basis(legs))


@dataclass(frozen=True)
class Document:
    """A snapshot ready for analysis."""

    snapshot_id: str
    manifest: dict
    facts: DataFrame
    prices: DataFrame
    fx: DataFrame
    factors: Factors
    risk_free: RiskFree
    months: DataFrame
    split: DataFrame
    returns: DataFrame
    warnings: DataFrame
    dropped: DataFrame
    as_of: str


def load_panel(
    spark: SparkSession, root: str | Path, as_of: dt.datetime | dt.date | str | None = None, start: str = WINDOW_START, end: str = WINDOW_END, splice: str = SPLICE, bounds: dict[str, float] | None = None,
) -> Document:
    """Verifies, reads, gates, trims to the declared window, cuts at the reader's moment,
    and joins. Without a moment the document is as of the snapshot's own stamp."""
    root = Path(root)
    with scope():
        manifest = S.verify(spark, root)
        taken = manifest["created"]
        prices = once(spark, ("prices", str(root)), lambda: S.read_prices(spark, root, entries(manifest, "price")))
        fx = once(spark, ("fx", str(root)), lambda: S.read_prices(spark, root, entries(manifest, "fx"), "fx"))
        rows = [(n, f["income_policy"], f["fund_size"]) for n, f in manifest["instruments"].items()]
        facts = spark.createDataFrame(rows, "instrument string, income string, size string")
        factors, risk = load_factors(spark, root, manifest), load_risk_free(spark, root, manifest, splice)
        Q.run_gate(Q.violations(prices, facts, start, taken, bounds))
        Q.run_gate(Q.violations(fx, None, start, taken))
        rates = Q.newest_rates(fx.where(F.col("period_month") <= F.lit(end).cast("date")))
        warnings = Q.warnings(prices, facts, rates, factors.usd).unionByName(Q.warnings(fx))
        legs = {"prices": prices, "fx": fx, "usd": factors.usd, "eur": factors.eur, "europe_usd": factors.europe_usd, "fx_level": factors.fx_level, "risk_free": risk.monthly}
        dropped = None
        for name, leg in legs.items():
            legs[name], count = C.window(leg, start, end)
            count = count.select(F.lit(name).alias("leg"), "dropped")
            dropped = count if dropped is None else dropped.unionByName(count)
            if as_of is not None:
                legs[name] = C.as_of(legs[name], as_of)
        daily = risk.daily if as_of is None else risk.daily.where(F.col("day") <= F.lit(C.cutoff(as_of)))
        risk = RiskFree(daily, legs["risk_free"], risk.basis)
        factors = Factors(legs["usd"], legs["eur"], legs["europe_usd"], legs["fx_level"], factors.untranslated)
        quotes = legs["fx"].select("currency", "period_month", "close")
        key = (str(root), str(as_of), start, end)
        months = once(spark, ("months", *key), lambda: R.joined_months(legs["prices"], factors.eur, risk.monthly))
        held = legs["prices"].join(months, "period_month", "left_semi")
        returns = once(spark, ("returns", *key), lambda: R.excess_table(legs["prices"], quotes, risk.monthly, months))
        return Document(
            manifest["snapshot_id"], manifest, facts, legs["prices"], quotes, factors, risk, months, R.currency_split(held, quotes), returns, warnings, dropped, str(as_of or taken)
        )
