"""Statistical components and covariance estimates of every rolling window, as rows.

A window is a row with its sums of products; its correlations, eigenvalues and
covariances are column expressions. The null of shifted series is a row for each window
and draw: every series turned by its own number of months, the same seeded draws for
all windows of a length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as L
from ..operators.calendar import numbered
from ..sources.scratch import once
from . import draws as D
from .factors import moments, monthly

#: Percentile of the null that a component has to pass (fixed value).
PERCENTILE = 0.95
#: Retained counts that jump by more than one in over this share of the steps are given
#: up for a fixed count (fixed values).
MOVE_SHARE, FIXED_COUNT = 0.25, 3


def correlation(cov: Column) -> Column:
    """The correlations of a covariance; raises where a series does not vary."""
    sd = F.transform(cov, lambda row, i: F.sqrt(F.when(F.get(row, i) > 0, F.get(row, i)).otherwise(F.raise_error(F.lit("a series without variance has no correlation")).cast("double"))))
    return L.let(sd, lambda s: F.transform(cov, lambda row, i: F.zip_with(row, s, lambda c, d: c / (F.get(s, i) * d))))


def structure(windows: DataFrame, width: int, protocol: str = "rolling") -> DataFrame:
    """traded, n, cov, parts: sample covariance of each window's ``moments`` of ones and
    ``width`` series, and the eigenvalues and vectors of its correlations. A window
    refused for a hole has no row."""
    every = list(range(1, width + 1))
    rows = windows.where((F.col("protocol") == protocol) & F.col("gram").isNotNull())
    rows = rows.select("traded", "n", L.covariance(F.col("gram"), F.col("n"), every).alias("cov"))
    return rows.select("traded", "n", "cov", L.eigen(correlation(F.col("cov")), width).alias("parts"))


def null(monthly: DataFrame, months: DataFrame, windows: DataFrame, width: int, draws: int = D.SHIFTS, seeds: tuple[int, ...] = (D.SEED,), size: int = 60) -> DataFrame:
    """traded, seed, component, bar, median: each place's eigenvalue under independent
    circular shifts of the series of (period_month, z), z beginning with a one."""
    spark = monthly.sparkSession
    whole = F.when(~F.exists("z", lambda v: v.isNull() | F.isnan(v)), F.slice("z", 2, width))
    frame = Window.orderBy("pos").rangeBetween(-size, -1)
    placed = numbered(months).join(monthly, "period_month", "left").select("period_month", "pos", F.collect_list(whole).over(frame).alias("x"))
    held = placed.where(F.col("pos") >= size).select(F.col("period_month").alias("traded"), L.transposed(F.col("x"), width).alias("x"), F.size("x").alias("months"))

    def standard(v: Column) -> Column:
        n = F.size(v)
        centred = lambda m: F.transform(v, lambda a: a - m)
        return L.let(L.let(L.total(v) / n, centred), lambda c: L.let(F.sqrt(L.dot(c, c)), lambda s: F.transform(c, lambda a: a / F.nullif(s, F.lit(0.0)))))

    held = held.join(windows.where("protocol = 'rolling'").select("traded", "n"), "traded").select("traded", "months", F.transform("x", standard).alias("x"))
    lengths = sorted(r[0] for r in windows.where("protocol = 'rolling'").select("n").distinct().collect())  # a few window lengths
    moved = None
    for t in lengths:
        for seed in seeds:
            part = D.shifts(spark, t, width, draws, seed).groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("ord", "shift"))).alias("s"))
            part = part.select(F.lit(t).alias("months"), F.lit(seed).alias("seed"), "draw", F.col("s.shift").alias("shift"))
            moved = part if moved is None else moved.unionByName(part)
    if moved is None:
        return spark.createDataFrame([], "traded date, seed int, component int, bar double, median double")
    rows = held.join(moved, "months").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "traded", "seed", "draw")
    turned = F.zip_with("x", "shift", lambda v, s: F.concat(F.slice(v, F.size(v) - s + 1, s), F.slice(v, F.lit(1), F.size(v) - s)))
    corr = L.let(turned, lambda v: F.transform(v, lambda a: F.transform(v, lambda b: L.dot(a, b))))
    values = rows.select("traded", "seed", F.posexplode(F.transform(L.eigen(corr, width, 8), lambda p: p["value"])).alias("component", "value"))
    return values.groupBy("traded", "seed", "component").agg(F.percentile("value", PERCENTILE).alias("bar"), F.percentile("value", 0.5).alias("median"))


def retained(parts: DataFrame, bars: DataFrame) -> DataFrame:
    """traded, seed, retained: components whose eigenvalue passes the bar of its place."""
    values = parts.select("traded", F.posexplode(F.transform("parts", lambda p: p["value"])).alias("component", "value"))
    return values.join(bars, ["traded", "component"]).groupBy("traded", "seed").agg(F.count_if(F.col("value") > F.col("bar")).cast("int").alias("retained"))


def report(parts: DataFrame, bars: DataFrame, names: list[str]) -> DataFrame:
    """A row for each window and component: eigenvalue, bar, retained count, shares of the
    whole, the edge of random matrices, and the three names it loads most on."""
    top = lambda v: F.array_join(F.transform(F.slice(F.array_sort(F.zip_with(v, F.lit(names), lambda x, n: F.struct((-F.abs(x)).alias("x"), n.alias("n")))), 1, 3), lambda s: s["n"]), ", ")
    rows = parts.select("traded", "n", F.posexplode("parts").alias("component", "p"))
    rows = rows.join(bars, ["traded", "component"]).join(retained(parts, bars), ["traded", "seed"])
    edge = F.pow(1 + F.sqrt(F.lit(float(len(names))) / F.col("n")), 2)
    return rows.select("traded", "component", F.col("p.value").alias("eigenvalue"), "bar", "retained", (F.col("p.value") / len(names)).alias("share"), (F.col("median") / len(names)).alias("noise_share"), edge.alias("mp_edge"), top(F.col("p.vector")).alias("top"))


def shrunk(returns: DataFrame, months: DataFrame, size: int = 60, value: str = "excess", name: str = "instrument") -> DataFrame:
    """protocol, traded, i, j, value, intensity: Ledoit and Wolf's (2004) shrinkage to the
    scaled identity, rescaled to ddof 1. The intensity needs mean squared products of
    centred series; they come from frames of sums of powers over the months."""
    placed = returns.join(F.broadcast(numbered(months)), "period_month").select("period_month", "pos", F.col(name).alias("i"), F.col(value).alias("x"))
    pairs = placed.join(placed.select("period_month", F.col("i").alias("j"), F.col("x").alias("y")), "period_month")
    order = Window.partitionBy("i", "j").orderBy("pos")
    frames = {"rolling": order.rangeBetween(-size, -1), "expanding": order.rangeBetween(Window.unboundedPreceding, -1)}
    x, y = F.col("x"), F.col("y")
    powers = {"n": F.lit(1.0), "x": x, "y": y, "xy": x * y, "xx": x * x, "yy": y * y, "xxy": x * x * y, "xyy": x * y * y, "xxyy": x * x * y * y}
    cells = F.array(*[F.struct(F.lit(k).alias("protocol"), *[F.sum(e).over(frame).alias(p) for p, e in powers.items()]) for k, frame in frames.items()])
    found = pairs.select(F.col("period_month").alias("traded"), "i", "j", "pos", cells.alias("c")).where(F.col("pos") >= size).select("traded", "i", "j", F.explode("c").alias("c")).select("traded", "i", "j", "c.*")
    n, a, b = F.col("n"), F.col("x") / F.col("n"), F.col("y") / F.col("n")
    s = F.col("xy") / n - a * b
    fourth = (F.col("xxyy") - 2 * b * F.col("xxy") - 2 * a * F.col("xyy") + b * b * F.col("xx") + a * a * F.col("yy") + 4 * a * b * F.col("xy") - 3 * n * a * a * b * b) / n
    whole = Window.partitionBy("protocol", "traded")
    same = F.col("i") == F.col("j")
    found = found.select("protocol", "traded", "i", "j", "n", s.alias("s"), fourth.alias("q"))
    p, trace, squares, spread = F.col("p"), F.col("trace"), F.col("squares"), F.col("spread")
    found = found.select("*", F.sum(F.when(same, 1.0)).over(whole).alias("p"), F.sum(F.when(same, F.col("s"))).over(whole).alias("trace"), F.sum(F.col("s") * F.col("s")).over(whole).alias("squares"), F.sum("q").over(whole).alias("fourth"))
    found = found.withColumn("spread", (squares - trace * trace / p) / p).withColumn("noise", (F.col("fourth") - squares) / (p * n))
    found = found.withColumn("intensity", F.when(spread > 0, F.least("noise", "spread") / F.when(spread > 0, spread)).otherwise(1.0))
    value_ = ((1 - F.col("intensity")) * F.col("s") + F.when(same, F.col("intensity") * trace / p).otherwise(0.0)) * n / (n - 1)
    return found.select("protocol", "traded", "i", "j", value_.alias("value"), "intensity")


def factor_model(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """traded, cov, retained: the retained components (one at least) plus a diagonal rest,
    on the scale of the sample covariance."""
    rows = parts.join(counts, "traded").withColumn("k", F.greatest("retained", F.lit(1)))
    kept = F.slice("parts", F.lit(1), F.col("k"))
    common = lambda i, j: F.aggregate(kept, F.lit(0.0), lambda s, p: s + F.greatest(p["value"], F.lit(0.0)) * F.get(p["vector"], i) * F.get(p["vector"], j))
    scale = lambda i, j: F.sqrt(L.cell(F.col("cov"), i, i) * L.cell(F.col("cov"), j, j))
    cov = F.transform("cov", lambda row, i: F.transform(row, lambda _, j: scale(i, j) * F.when(i == j, 1.0).otherwise(common(i, j))))
    return rows.select("traded", cov.alias("cov"), F.col("k").alias("retained"))


def condition(cov: Column, width: int) -> Column:
    """Largest over smallest eigenvalue of a covariance; null where the smallest is nothing."""
    size = lambda p: F.abs(p["value"])
    return L.let(F.transform(L.eigen(cov, width), size), lambda v: F.array_max(v) / F.nullif(F.array_min(v), F.lit(0.0)))


def matrices(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, cov: long rows (keys, i, j, value) as matrices in the given order of names;
    raises where a pair is missing."""
    at = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "i", "j"), "value")))
    found = rows.groupBy(*keys).agg(at.alias("m"))
    cell = lambda a, b: F.coalesce(F.try_element_at("m", F.concat_ws("|", a, b)), F.raise_error(F.lit("a covariance lacks a pair of its sleeves")).cast("double"))
    return found.select(*keys, F.transform(F.lit(order), lambda a: F.transform(F.lit(order), lambda b: cell(a, b))).alias("cov"))


def estimators(parts: DataFrame, shrinkage: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """traded, estimator, cov, report: all three estimates of every rolling window; the
    report is the intensity or the number of components."""
    null_ = F.lit(None).cast("double")
    sample = parts.select("traded", F.lit("sample").alias("estimator"), "cov", null_.alias("report"))
    rolling = shrinkage.where("protocol = 'rolling'")
    drawn = matrices(rolling, ["traded"], names).join(rolling.groupBy("traded").agg(F.first("intensity").alias("report")), "traded")
    model = factor_model(parts, counts).select("traded", F.lit("factor").alias("estimator"), "cov", F.col("retained").cast("double").alias("report"))
    return sample.unionByName(drawn.select("traded", F.lit("shrinkage").alias("estimator"), "cov", "report")).unionByName(model)


def window_estimates(returns: DataFrame, months: DataFrame, names: list[str], size: int = 60) -> DataFrame:
    """protocol, traded, estimator, cov, report: every estimate of every window without a
    hole; expanding windows have the sample covariance only."""
    spark, width, key = returns.sparkSession, len(names), uuid.uuid4().hex
    rows = once(spark, ("sleeves", key), lambda: monthly(returns, None, [], names).coalesce(1))
    sums = once(spark, ("own_moments", key), lambda: moments(rows, months, 1 + width, size, strict=False))
    whole = sums.where("gram is not null")
    parts = once(spark, ("parts", key), lambda: structure(whole, width).coalesce(1))
    bars = once(spark, ("null", key), lambda: null(rows, months, whole, width, size=size))
    held = shrunk(returns, months, size).join(whole.select("protocol", "traded"), ["protocol", "traded"], "left_semi")
    rolling = estimators(parts, held, retained(parts, bars), names).select(F.lit("rolling").alias("protocol"), "traded", "estimator", "cov", "report")
    grown = whole.where("protocol = 'expanding'").select("protocol", "traded", F.lit("sample").alias("estimator"), L.covariance(F.col("gram"), F.col("n"), list(range(1, width + 1))).alias("cov"), F.lit(None).cast("double").alias("report"))
    return rolling.unionByName(grown)


def portfolios(parts: DataFrame, width: int, count: int) -> DataFrame:
    """traded, map: rows of weights of the first ``count`` components, each summing to one;
    raises where a component's weights sum to nothing."""
    raw = lambda p: F.transform(p["vector"], lambda v, i: v / F.sqrt(L.cell(F.col("cov"), i, i)))
    whole = lambda w: L.let(L.total(w), lambda t: F.when(F.abs(t) >= 1e-8, F.transform(w, lambda v: v / t)).otherwise(F.raise_error(F.lit("a component portfolio sums to nothing")).cast(L.VECTOR)))
    return parts.select("traded", F.transform(F.slice("parts", 1, count), lambda p: L.let(raw(p), whole)).alias("map"))


def spanning(windows: DataFrame, parts: DataFrame, width: int, count: int) -> DataFrame:
    """traded, statistic, p: all sleeves but the last ``count`` tested on the first
    ``count`` component portfolios, from sums of products of ones and sleeves."""
    rows = windows.join(portfolios(parts, width, count), "traded")
    one = L.identity(width + 1)
    turned = F.concat(F.slice(one, 1, 1), F.transform("map", lambda w: F.concat(F.expr("array(0D)"), w)), F.slice(one, 2, width - count))
    found = L.grs(F.col("g"), F.col("n"), count, width - count)
    return rows.select("traded", "n", L.sandwich(turned, F.col("gram")).alias("g")).select("traded", found.alias("f")).select("traded", "f.statistic", "f.p")


def directions(windows: DataFrame, parts: DataFrame, factors: int, width: int, count: int) -> DataFrame:
    """traded, direction, statistic, p: component portfolios tested on the named factors
    (headline) and the factors on the portfolios (reverse), from sums of products of
    ones, factors and sleeves."""
    rows = windows.join(portfolios(parts, width, count), "traded")
    one = L.identity(1 + factors + width)
    made = F.transform("map", lambda w: F.concat(F.array_repeat(F.lit(0.0), 1 + factors), w))
    named, first = F.slice(one, 2, factors), F.slice(one, 1, 1)
    ways = {"headline": (F.concat(first, named, made), factors, count), "reverse": (F.concat(first, made, named), count, factors)}
    out = None
    for way, (turned, base, tested) in ways.items():
        part = rows.select("traded", "n", L.sandwich(turned, F.col("gram")).alias("g")).select("traded", F.lit(way).alias("direction"), L.grs(F.col("g"), F.col("n"), base, tested).alias("f"))
        out = part if out is None else out.unionByName(part)
    return out.select("traded", "direction", "f.statistic", "f.p")
