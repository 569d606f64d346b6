"""Rolling factor fits from sums of products, in column functions.

A month is one vector: a one, the factors, the sleeves' returns. Every pair's products
are summed by frames over the months, so no month is repeated for the windows that hold
it; the sums of a window are a matrix of a few rows, and regressions, inflation and the
traded month's basis are algebra on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as L
from ..operators.calendar import numbered
from ..operators.labels import one_value


def monthly(returns: DataFrame, factors: DataFrame | None, names: list[str], sleeves: list[str]) -> DataFrame:
    """period_month, z: a one, the factors in the order of ``names`` (long: factor,
    period_month, ret; several sets may be stacked) and the excess of ``sleeves``. Two values of a name in a month raise."""
    wide = lambda rows, key, value, wanted: rows.groupBy("period_month").agg(*[one_value(value, key, n).alias(f"{key}_{i}") for i, n in enumerate(wanted)])
    x = wide(returns, "instrument", "excess", sleeves)
    z = [F.lit(1.0), *[F.col(f"factor_{i}") for i in range(len(names))], *[F.col(f"instrument_{i}") for i in range(len(sleeves))]]
    if names:
        x = x.join(wide(factors, "factor", "ret", names), "period_month")
    return x.select("period_month", F.array(*z).alias("z"))


def _pairs(width: int) -> Column:
    """Each pair of places once."""
    last = F.lit(width - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def _matrix(width: int) -> Column:
    """The symmetric matrix of ``u``: (i, j, x) for each pair once, in order."""
    place = lambda i, j: (F.least(i, j) * (2 * width - F.least(i, j) - 1) / 2).cast("int") + F.greatest(i, j)
    every = F.sequence(F.lit(0), F.lit(width - 1))
    return F.transform(every, lambda i: F.transform(every, lambda j: F.get("u", place(i, j))["x"]))


def grams(rows: DataFrame, key: str, width: int) -> DataFrame:
    """key, n, gram: sums of products of (key, z) over all rows of a key."""
    cells = rows.select(key, "z", F.explode(_pairs(width)).alias("p")).select(key, "p.i", "p.j", (F.get("z", F.col("p.i")) * F.get("z", F.col("p.j"))).alias("x"))
    sums = cells.groupBy(key, "i", "j").agg(F.sum("x").alias("x"), F.count("x").alias("n"))
    found = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "j", "x"))).alias("u"), F.min("n").alias("n"))
    return found.select(key, "n", _matrix(width).alias("gram"))


def moments(rows: DataFrame, months: DataFrame, width: int, size: int = 60, strict: bool = True) -> DataFrame:
    """protocol, traded, n, gram: sums of products of (period_month, z) over each traded
    month's windows. A window with a hole raises, or if not ``strict`` has no sums; only
    its first month may be absent."""
    whole = F.when(~F.exists("z", lambda v: v.isNull() | F.isnan(v)), F.col("z"))
    placed = numbered(months).join(rows, "period_month", "left").select("period_month", "pos", whole.alias("z"), F.explode(_pairs(width)).alias("p"))
    cells = placed.select(F.col("period_month").alias("traded"), "pos", "p.i", "p.j", (F.get("z", F.col("p.i")) * F.get("z", F.col("p.j"))).alias("x"))
    order = Window.partitionBy("i", "j").orderBy("pos")
    frames = {"rolling": order.rangeBetween(-size, -1), "expanding": order.rangeBetween(Window.unboundedPreceding, -1)}
    start = {"rolling": F.col("pos") - size, "expanding": F.lit(0)}
    sums = [F.struct(F.lit(k).alias("protocol"), F.sum("x").over(w).alias("x"), F.count("x").over(w).alias("n"), F.min(F.when(F.col("x").isNotNull(), F.col("pos"))).over(w).alias("oldest"), start[k].alias("start"), (F.col("pos") - start[k]).alias("months")) for k, w in frames.items()]
    found = cells.select("traded", "pos", "i", "j", F.array(*sums).alias("s")).where(F.col("pos") >= size).select("traded", "i", "j", F.explode("s").alias("s"))
    found = found.groupBy("s.protocol", "traded").agg(F.array_sort(F.collect_list(F.struct("i", "j", "s.x"))).alias("u"), *[F.min(f"s.{c}").alias(c) for c in ("n", "oldest", "start", "months")])
    missing = F.col("months") - F.col("n")
    hole = (missing > 1) | ((missing == 1) & (F.col("oldest") == F.col("start"))) | (F.col("n") < size - 1)
    said = F.concat(F.lit("a hole: the window before "), F.col("traded").cast("string"), F.lit(" holds "), F.col("n").cast("string"), F.lit(" months"))
    return found.select("protocol", "traded", "n", F.when(hole, F.raise_error(said).cast(L.MATRIX) if strict else F.lit(None).cast(L.MATRIX)).otherwise(_matrix(width)).alias("gram"))


def _turned(names: int, constructed: int, sleeves: int) -> Column:
    """The map that leaves all but the last ``constructed`` factors, each of those net of
    the ones before it."""
    width, first = 1 + names + sleeves, 1 + names - constructed
    if not constructed:
        return L.identity(width)
    block = list(range(first, 1 + names))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    turned = lambda t, i: F.concat(zeros(first), F.get(t, i - first), zeros(sleeves))
    return L.let(L.orthogonaliser(L.part(F.col("gram"), block, block), constructed), lambda t: F.transform(L.identity(width), lambda row, i: F.when(i.between(first, names), turned(t, i)).otherwise(row)))


def rolling(windows: DataFrame, names: list[str], sleeves: list[str], constructed: int = 0) -> DataFrame:
    """Every window's regressions of its ``moments``, long (protocol, traded, instrument,
    quantity, factor, value, determined): alpha, beta and their t, residual and explained
    variance, R2, F, and the design's inflation.

    The last ``constructed`` of ``names`` are built from sleeves. They are orthogonalised
    in their order inside the window. A sleeve they determine is fitted on the others
    alone: its loadings on them are identities, its alpha and their t are absent, its R2
    is one, and what the others explain stands as ``spine_r2``. A window with a hole, too
    few rows or dependent factors raises.
    """
    k, first = len(names), 1 + len(names) - constructed
    spine, block, every = list(range(1, first)), list(range(first, 1 + k)), list(range(1, 1 + k))
    n, raw, gram, y = F.col("n"), F.col("gram"), F.col("turned"), F.col("y")
    rows = windows.withColumn("turned", L.sandwich(_turned(k, constructed, len(sleeves)), raw))
    text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    entry = lambda q, v, name=None, own=None: F.struct(F.lit(q).alias("quantity"), text(name).alias("factor"), v.cast("double").alias("value"), F.lit(own).cast("boolean").alias("determined"))
    inflation = lambda g, columns: L.let(L.covariance(g, n, columns), lambda c: L.variance_inflation(c, len(columns)))
    report = [entry("vif_spine", inflation(raw, spine)), entry("vif_declared", inflation(raw, every)), entry("vif_orthogonal", inflation(gram, every))]
    if constructed > 1:
        at = lambda m, i, j: L.cell(m, F.lit(i), F.lit(j))
        report.append(entry("block_correlation", L.let(L.covariance(raw, n, block[:2]), lambda m: at(m, 0, 1) / F.sqrt(at(m, 0, 0) * at(m, 1, 1)))))
    whole = rows.select("protocol", "traded", F.lit(None).cast("string").alias("instrument"), F.explode(F.array(*report)).alias("e"))

    labels = F.lit(names)
    number = F.posexplode(F.lit(sleeves)).alias("k", "instrument")
    each = rows.select("protocol", "traded", "n", "gram", "turned", number).withColumn("y", F.col("k") + 1 + k).drop("k")
    if constructed:
        to_y, sums = F.transform(L.numbers(block), lambda i: L.cell(raw, i, y)), F.transform(L.numbers(block), lambda i: L.cell(raw, F.lit(0), i))
        rest = lambda c, b: (L.cell(raw, y, y) - L.dot(c, b)) / n - F.pow((L.cell(raw, F.lit(0), y) - L.dot(c, sums)) / n, 2)
        spread = L.cell(raw, y, y) / n - F.pow(L.cell(raw, F.lit(0), y) / n, 2)
        each = each.withColumn("fixed", L.let(to_y, lambda b: L.let(L.solve(L.part(raw, block, block), b, constructed), lambda c: F.when(rest(c, b) <= 1e-9 * spread, c))))

    def loadings(r: Column, count: int, own: bool) -> Column:
        pair = lambda name, i: F.array(entry("beta", F.get(r["beta"], i + 1), name, own), entry("beta_t", F.get(r["t"], i + 1), name, own))
        return F.flatten(F.transform(F.slice(labels, 1, count), pair))

    def share(r: Column) -> Column:
        return F.coalesce(1 - r["resid_var"] / F.nullif(r["var"], F.lit(0.0)), F.lit(0.0))

    def free(r: Column) -> Column:
        numbers = {"alpha": F.get(r["beta"], F.lit(0)), "alpha_t": F.get(r["t"], F.lit(0)), "resid_var": r["resid_var"], "explained_var": r["var"] - r["resid_var"], "r2": share(r), "f": r["f"]}
        return F.concat(loadings(r, k, False), F.array(*[entry(q, v, None, False) for q, v in numbers.items()]))

    def determined(r: Column) -> Column:
        numbers = {"resid_var": F.lit(0.0), "explained_var": r["var"], "r2": F.lit(1.0), "spine_r2": share(r)}
        fixed = F.zip_with(F.slice(labels, first, constructed), F.col("fixed"), lambda name, v: entry("beta", v, name, True))
        return F.concat(loadings(r, first - 1, True), F.array(*[entry(q, v, None, True) for q, v in numbers.items()]), fixed)

    found = L.let(L.regression(gram, n, [0, *every], y), free)
    if constructed:
        found = F.when(F.col("fixed").isNull(), found).otherwise(L.let(L.regression(gram, n, [0, *spine], y), determined))
    rows = each.select("protocol", "traded", "instrument", F.explode(found).alias("e")).unionByName(whole)
    return rows.select("protocol", "traded", "instrument", "e.quantity", "e.factor", "e.value", "e.determined")


def design(windows: DataFrame, rows: DataFrame, names: list[str], sleeves: int, constructed: int = 0) -> DataFrame:
    """protocol, traded, factor, value, i, covariance: the traded month's factor values
    (``rows``: period_month, z) on its window's basis, and the covariance of the
    regressors that were fitted."""
    k, every = len(names), list(range(1, 1 + len(names)))
    met = windows.join(rows.select(F.col("period_month").alias("traded"), "z"), "traded")
    turned = met.select("protocol", "traded", "n", "gram", "z", _turned(k, constructed, sleeves).alias("map"))
    now = F.slice(L.times(F.col("map"), F.col("z")), 2, k)
    shared = turned.select("protocol", "traded", now.alias("now"), L.let(L.sandwich(F.col("map"), F.col("gram")), lambda g: L.covariance(g, F.col("n"), every)).alias("cov"))
    listed = F.posexplode(F.lit(names)).alias("i", "factor")
    return shared.select("protocol", "traded", "now", "cov", listed).select("protocol", "traded", "factor", F.get("now", F.col("i")).alias("value"), "i", F.get("cov", F.col("i")).alias("covariance"))


def two_pass(windows: DataFrame, names: list[str], priced: int, sleeves: int) -> DataFrame:
    """Fama and MacBeth (1973) from the ``moments`` of ones, ``names`` and ``sleeves``:
    protocol, traded, factor, premium, t, dof, identified. Loadings on the first
    ``priced`` names, then each month's returns on the loadings; the prices are a fixed
    map of the returns, so their mean and variance are those of the sums."""
    k, ys = priced + 1, L.numbers(list(range(1 + len(names), 1 + len(names) + sleeves)))
    n, gram = F.col("n"), F.col("gram")
    loads = F.transform(ys, lambda y: L.let(L.regression(gram, n, list(range(k)), y), lambda r: F.concat(F.expr("array(1D)"), F.slice(r["beta"], 2, priced))))
    rows = windows.select("protocol", "traded", "n", "gram", loads.alias("d"), L.covariance(gram, n, list(range(1 + len(names), 1 + len(names) + sleeves))).alias("c"))
    flipped = L.transposed(F.col("d"), k)
    gram2 = F.transform(flipped, lambda a: F.transform(flipped, lambda b: L.dot(a, b)))
    pricing = L.let(L.inverse(gram2, k), lambda v: F.transform(v, lambda row: F.transform("d", lambda d: L.dot(row, d))))
    rows = rows.withColumn("map", pricing)
    mean = F.transform(ys, lambda y: L.cell(gram, F.lit(0), y) / n)
    found = F.transform("map", lambda row, i: F.struct(F.get(F.lit(["intercept", *names[:priced]]), i).alias("factor"), L.dot(row, mean).alias("premium"), L.dot(row, L.times(F.col("c"), row)).alias("v")))
    rows = rows.select("protocol", "traded", "n", F.explode(found).alias("f"))
    return rows.select("protocol", "traded", "f.factor", "f.premium", (F.col("f.premium") / F.nullif(F.sqrt(F.col("f.v") / F.col("n")), F.lit(0.0))).alias("t"), F.lit(sleeves - k).alias("dof"), F.lit(sleeves - k <= 0).alias("identified"))


def decomposition(active_weights: DataFrame, fit: DataFrame, basis: DataFrame) -> DataFrame:
    """Per run and month: active return by factor, alpha, and the rest.
    ``active_weights``: run_id, traded, instrument, a, active."""
    beta = fit.where("quantity = 'beta' and protocol = 'rolling'").select("traded", "instrument", "factor", F.col("value").alias("beta"))
    alpha = fit.where("quantity = 'alpha' and protocol = 'rolling'").select("traded", "instrument", F.col("value").alias("alpha"))
    by_factor = active_weights.join(beta, ["traded", "instrument"]).join(basis.where("protocol = 'rolling'").select("traded", "factor", F.col("value").alias("f")), ["traded", "factor"])
    by_factor = by_factor.groupBy("run_id", "traded").agg(F.sum(F.col("a") * F.col("beta") * F.col("f")).alias("factors"))
    rest = active_weights.join(alpha, ["traded", "instrument"], "left").groupBy("run_id", "traded").agg(F.sum(F.col("a") * F.coalesce("alpha", F.lit(0.0))).alias("alpha"), F.sum(F.col("a") * F.col("ret")).alias("active"))
    return rest.join(by_factor, ["run_id", "traded"]).withColumn("residual", F.col("active") - F.col("factors") - F.col("alpha"))


def decomposition_by_factor(active_weights: DataFrame, fit: DataFrame, basis: DataFrame) -> DataFrame:
    """run_id, traded, factor, value: each factor's part of the active return."""
    beta = fit.where("quantity = 'beta' and protocol = 'rolling'").select("traded", "instrument", "factor", F.col("value").alias("beta"))
    now = basis.where("protocol = 'rolling'").select("traded", "factor", F.col("value").alias("f"))
    rows = active_weights.join(beta, ["traded", "instrument"]).join(now, ["traded", "factor"])
    return rows.groupBy("run_id", "traded", "factor").agg(F.sum(F.col("a") * F.col("beta") * F.col("f")).alias("value"))


def risk_attribution(active_weights: DataFrame, fit: DataFrame, basis: DataFrame) -> DataFrame:
    """Per run and month the factor and idiosyncratic variance of the active weights:
    exposures through the window's regressor covariance, residuals taken as uncorrelated."""
    beta = fit.where("quantity = 'beta' and protocol = 'rolling'").select("traded", "instrument", "factor", F.col("value").alias("beta"))
    load = active_weights.join(beta, ["traded", "instrument"]).groupBy("run_id", "traded", "factor").agg(F.sum(F.col("a") * F.col("beta")).alias("e"))
    order = basis.where("protocol = 'rolling'").select("traded", "factor", "i", "covariance")
    left = load.join(order, ["traded", "factor"])
    right = load.join(order.select("traded", "factor", F.col("i").alias("j")), ["traded", "factor"]).select("run_id", "traded", "j", F.col("e").alias("g"))
    factor = left.join(right, ["run_id", "traded"]).groupBy("run_id", "traded").agg(F.sum(F.col("e") * F.col("g") * F.get("covariance", F.col("j"))).alias("factor_part"))
    rest = fit.where("quantity = 'resid_var' and protocol = 'rolling'").select("traded", "instrument", F.col("value").alias("v"))
    own = active_weights.join(rest, ["traded", "instrument"]).groupBy("run_id", "traded").agg(F.sum(F.col("a") * F.col("a") * F.col("v")).alias("idio_part"))
    return factor.join(own, ["run_id", "traded"]).withColumn("total", F.col("factor_part") + F.col("idio_part"))


def risk_summary(variance: DataFrame, periods: int = 12) -> DataFrame:
    """Per run: annualised tracking errors of both parts and of the whole, and the factor share."""
    out = variance.groupBy("run_id").agg(*[F.avg(c).alias(c) for c in ("factor_part", "idio_part", "total")])
    error = lambda c: F.sqrt(F.col(c) * periods)
    share = F.when(F.col("total") > 0, F.col("factor_part") / F.col("total"))
    return out.select("run_id", error("factor_part").alias("factor_tracking_error"), error("idio_part").alias("idio_tracking_error"), error("total").alias("total_tracking_error"), share.alias("factor_share"))


def fund_example(series: DataFrame, factors: DataFrame, names: list[str], bar: float, detection: float, least: int = 59, periods: int = 12) -> DataFrame:
    """Each run's net series read as a manager's record: its alpha on the factors against
    the bar, and the least alpha its months could show (``detection`` standard errors). A
    record that can't be tested is a row with the reason. ``series``: run_id, traded,
    net; ``factors``: long."""
    k = len(names)
    by_month = factors.groupBy("period_month").agg(*[F.sum(F.when(F.col("factor") == n, F.col("ret"))).alias(f"_{i}") for i, n in enumerate(names)])
    packed = by_month.select(F.col("period_month").alias("traded"), F.array(F.lit(1.0), *[F.col(f"_{i}") for i in range(k)]).alias("f"))
    rows = series.select("run_id", "traded", "net").join(packed, "traded", "left")
    rows = rows.withColumn("z", F.when(F.col("f").isNotNull(), F.concat("f", F.array("net"))))
    gap = F.exists("z", lambda v: v.isNull() | F.isnan(v))
    seen = rows.groupBy("run_id").agg(F.count("*").cast("int").alias("months"), F.count("f").alias("held"), F.count_if(gap).alias("gaps"), F.coalesce(F.var_pop("net"), F.lit(0.0)).alias("spread"))
    why = F.when(F.col("spread") <= 1e-24, "the record does not vary").when(F.col("held") < least, F.concat(F.col("held").cast("string"), F.lit(f" months can't support {k} factors")))
    seen = seen.select("run_id", "months", why.when(F.col("gaps") > 0, "a factor lacks a month of the record").alias("refused"))
    tested = rows.join(seen.where("refused is null").select("run_id"), "run_id", "left_semi").where("z is not null")
    fits = grams(tested, "run_id", k + 2).select("run_id", L.regression(F.col("gram"), F.col("n"), list(range(k + 1)), F.lit(k + 1)).alias("r"))
    alpha, t = F.get("r.beta", F.lit(0)), F.get("r.t", F.lit(0))
    fits = fits.select(
        "run_id", alpha.alias("alpha_monthly"), (alpha * periods).alias("alpha_annualised"), t.alias("t_alpha"), F.sqrt(F.col("r.resid_var") * periods).alias("residual_volatility_annualised"),
        (1 - F.col("r.resid_var") / F.nullif(F.col("r.var"), F.lit(0.0))).alias("r2"), F.lit(bar).alias("bar"), (detection * F.abs(alpha / F.nullif(t, F.lit(0.0)))).alias("detectable_alpha_monthly"), (F.abs(t) >= bar).alias("clears"),
    )
    return seen.join(fits, "run_id", "left")


def loading_drift(fit: DataFrame) -> DataFrame:
    """Mean and largest month-to-month change of each beta."""
    order = Window.partitionBy("protocol", "instrument", "factor").orderBy("traded")
    rows = fit.where("quantity = 'beta'").withColumn("move", F.abs(F.col("value") - F.lag("value").over(order)))
    return rows.groupBy("protocol", "instrument", "factor").agg(F.avg("move").alias("mean_move"), F.max("move").alias("max_move"))
