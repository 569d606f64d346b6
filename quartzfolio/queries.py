"""Registered queries of the panel engine, and the SQL that checks them.

Each query applies one operator to the whole tables. Floating results are rounded,
since sums depend on their order.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arrays as L
from .functions import kernels as K
from .operators import attribution as A
from .operators import calendar as C
from .operators import metrics as M
from .operators import quality as Q
from .operators import returns as R
from .operators import verdicts as V
from .plans import analysis as Y
from .plans import backtest as B
from .plans import components as E
from .plans import draws as D
from .plans import factors as X
from .plans import study as S
from .sources import panel as P
from .sources.scratch import once, scope
from .sources.sqlviews import RETURNS, Views, coverage_agreement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 8

_ROWS = ", ".join(f"({i}, '{n}', '{c}', '{g}', {w})" for i, (n, c, g, w) in enumerate(P.UNIVERSE))
_FACTS = ", ".join(f"('{n}', '{i}', '{s}')" for n, i, s in P.FACTS)
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_BINS = [("early", "2000-01-01", "2000-06-30"), ("middle", "2000-07-01", "2000-12-31"), ("late", "2001-01-01", "2001-07-31")]

#: Named relations of the oracle, in the order in which they build on each other.
_CTES = {
    "universe": f"SELECT * FROM (VALUES {_ROWS}) t(ord, instrument, currency, grp, policy)",
    "facts": f"SELECT * FROM (VALUES {_FACTS}) t(instrument, income, size)",
    "prices": f"""SELECT instrument, period_month, CAST(period_month + INTERVAL 1 MONTH AS DATE) AS available_from,
        level * (1 - cut) AS close, level AS adj_close, CASE WHEN month(period_month) % 3 = 0 THEN level * cut ELSE 0.0 END AS dividend,
        CASE WHEN instrument = 'PROMO' THEN 'SEK' ELSE 'EUR' END AS currency
        FROM (SELECT p_type AS instrument, CAST(date_trunc('month', l_shipdate) AS DATE) AS period_month,
            sum(l_extendedprice) / sum(l_quantity) AS level, avg(l_discount) AS cut
            FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate < (SELECT date_trunc('month', max(l_shipdate) + INTERVAL 1 DAY) FROM lineitem) GROUP BY 1, 2)""",
    "levels": f"""SELECT c_mktsegment AS factor, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_month, avg(o_totalprice) AS level
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < (SELECT date_trunc('month', max(o_orderdate) + INTERVAL 1 DAY) FROM orders) GROUP BY 1, 2""",
    "fx": "SELECT 'SEK' AS currency, period_month, level / 10000 AS close FROM levels WHERE factor = 'BUILDING'",
    "fxret": "SELECT currency, period_month, close / lag(close) OVER (ORDER BY period_month) - 1 AS fx FROM fx",
    "factors": "SELECT * FROM (SELECT factor, period_month, level / lag(level) OVER (PARTITION BY factor ORDER BY period_month) - 1 AS ret FROM levels) WHERE ret IS NOT NULL",
    "rates": f"""SELECT CASE l_linestatus WHEN 'F' THEN 'A' ELSE 'B' END AS leg, CAST(l_shipdate AS DATE) AS day, avg(l_tax) * 100 AS pct
        FROM lineitem WHERE l_shipdate < (SELECT date_trunc('month', max(l_shipdate) + INTERVAL 1 DAY) FROM lineitem) AND l_linestatus IN ('F', 'O') GROUP BY 1, 2""",
    "spliced": f"SELECT day, pct FROM rates WHERE (leg = 'A' AND day < DATE '{P.SPLICE}') OR (leg = 'B' AND day >= DATE '{P.SPLICE}')",
    "cash": "SELECT CAST(date_trunc('month', day) AS DATE) AS period_month, product(1 + pct / 100 / 360) - 1 AS rf FROM spliced GROUP BY 1",
    "months": "SELECT DISTINCT period_month FROM prices INTERSECT SELECT period_month FROM fx INTERSECT SELECT period_month FROM cash",
    "split": """SELECT instrument, period_month, currency, local, translation, (1 + local) * (1 + translation) - 1 AS euro FROM (
        SELECT p.instrument, p.period_month, p.currency, local, CASE WHEN p.currency = 'EUR' THEN 0.0 ELSE 1 / (1 + fx) - 1 END AS translation
        FROM (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY instrument ORDER BY period_month) - 1 AS local
            FROM prices WHERE period_month IN (SELECT period_month FROM months)) p LEFT JOIN fxret f ON f.currency = p.currency AND f.period_month = p.period_month
        WHERE local IS NOT NULL)""",
    "returns": """SELECT s.period_month, instrument, currency, local, translation, euro, rf, euro - rf AS excess
        FROM split s LEFT JOIN cash c ON s.period_month = c.period_month WHERE euro - rf IS NOT NULL""",
    "numbered": "SELECT period_month, row_number() OVER (ORDER BY period_month) - 1 AS pos FROM months",
    "steps": """SELECT 'rolling' AS protocol, t.period_month AS traded, a.period_month AS window_start, b.period_month AS window_end, 60 AS months, t.pos - 60 AS lo, t.pos - 1 AS hi
        FROM numbered t JOIN numbered a ON a.pos = t.pos - 60 JOIN numbered b ON b.pos = t.pos - 1
        UNION ALL SELECT 'expanding', t.period_month, a.period_month, b.period_month, t.pos, 0, t.pos - 1
        FROM numbered t JOIN numbered a ON a.pos = 0 JOIN numbered b ON b.pos = t.pos - 1 WHERE t.pos >= 60""",
    "windows": """SELECT s.protocol, s.traded, r.period_month, r.instrument, u.ord, r.excess, u.policy, s.months, s.window_start FROM steps s JOIN numbered n ON n.pos BETWEEN s.lo AND s.hi
        JOIN returns r ON r.period_month = n.period_month JOIN universe u ON u.instrument = r.instrument""",
    "cov": """SELECT a.protocol, a.traded, a.instrument AS i, b.instrument AS j, covar_samp(a.excess, b.excess) AS value
        FROM windows a JOIN windows b ON a.protocol = b.protocol AND a.traded = b.traded AND a.period_month = b.period_month GROUP BY 1, 2, 3, 4""",
    "books": """SELECT 'equal_weight' AS run_id, traded, instrument, 1.0 / 6 AS weight FROM (SELECT DISTINCT traded FROM steps), universe
        UNION ALL SELECT 'policy', traded, instrument, policy FROM (SELECT DISTINCT traded FROM steps), universe
        UNION ALL SELECT 'inverse_volatility', traded, i, (1 / sqrt(value)) / sum(1 / sqrt(value)) OVER (PARTITION BY traded)
        FROM cov WHERE protocol = 'rolling' AND i = j""",
    "traded_returns": "SELECT b.run_id, b.traded, b.instrument, b.weight, r.local, r.translation, r.euro, r.rf, r.excess, u.policy, u.grp FROM books b JOIN returns r ON r.period_month = b.traded AND r.instrument = b.instrument JOIN universe u ON u.instrument = b.instrument",
    "turned": """SELECT run_id, traded, coalesce(sum(abs(weight - before)) / 2, 0) AS turnover FROM (
        SELECT *, lag(weight) OVER (PARTITION BY run_id, instrument ORDER BY traded) AS before FROM books) GROUP BY 1, 2""",
    "series": """SELECT g.run_id, g.traded, gross, turnover, gross - 2 * turnover * 10.0 / 1e4 AS net FROM (
        SELECT run_id, traded, sum(weight * excess) AS gross FROM traded_returns GROUP BY 1, 2) g JOIN turned t ON t.run_id = g.run_id AND t.traded = g.traded""",
    "active": "SELECT s.*, b.gross AS bench, s.net - b.gross AS active FROM series s JOIN (SELECT traded, gross FROM series WHERE run_id = 'policy') b ON b.traded = s.traded",
}
#: Sleeves that build the block, in the order long, short, credit, high yield.
_BLOCK, _BUILT_FROM = ("level", "slope", "credit", "high_yield"), ("SMALL", "STANDARD", "MEDIUM", "LARGE")
_NAMES = [*_SEGMENTS, *_BLOCK]
_OVER = "OVER (PARTITION BY protocol, traded)"
_Z = {"full": "[1.0, s1, s2, s3, s4, s5, b1, t2, t3, t4]", "spine": "[1.0, s1, s2, s3, s4, s5]", "declared": "[1.0, s1, s2, s3, s4, s5, b1, b2, b3, b4]"}
_SWEEP = """SELECT protocol, traded, CAST(1 AS BIGINT) AS k, m FROM {0} UNION ALL SELECT protocol, traded, k + 1,
        list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k]) ELSE list_transform(range(1, 2 * len(m) + 1), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END)
        FROM {1} WHERE k <= len(m)"""
_ROWS_OF = "SELECT protocol, traded, list(r ORDER BY i) AS m FROM (SELECT protocol, traded, i, list(g ORDER BY j) || list(CASE WHEN i = j THEN 1.0 ELSE 0.0 END ORDER BY j) AS r FROM {0} GROUP BY 1, 2, 3) GROUP BY 1, 2"
_INVERSE_OF = "SELECT protocol, traded, i, j, m[i][len(m) + j] AS v FROM {0}, range(1, 5) a(i), range(1, 5) b(j) WHERE k = len(m) + 1"
_CELL = "max(excess) FILTER (WHERE instrument = '{}')"
_L, _S, _C, _H = (_CELL.format(n) for n in _BUILT_FROM)
#: Regressions of every window by Gauss-Jordan elimination of the normal equations.
_CTES |= {
    "spine": "SELECT period_month, " + ", ".join(f"max(ret) FILTER (WHERE factor = '{n}') AS s{i + 1}" for i, n in enumerate(_SEGMENTS)) + " FROM factors GROUP BY 1",
    "built": f"SELECT period_month, ({_L} + {_S}) / 2 AS b1, {_L} - {_S} AS b2, {_C} - {_L} AS b3, {_H} - {_C} AS b4 FROM returns GROUP BY 1",
    "named": "SELECT * FROM spine JOIN built USING (period_month)",
    "held0": "SELECT protocol, traded, named.* FROM (SELECT DISTINCT protocol, traded, period_month FROM windows) w JOIN named ON named.period_month = w.period_month",
    "held2": f"SELECT *, b2 - c21 * b1 AS t2 FROM (SELECT *, sum(b2 * b1) {_OVER} / sum(b1 * b1) {_OVER} AS c21, sum(b3 * b1) {_OVER} / sum(b1 * b1) {_OVER} AS c31, sum(b4 * b1) {_OVER} / sum(b1 * b1) {_OVER} AS c41 FROM held0)",
    "held3": f"SELECT *, b3 - c31 * b1 - c32 * t2 AS t3 FROM (SELECT *, sum(b3 * t2) {_OVER} / sum(t2 * t2) {_OVER} AS c32, sum(b4 * t2) {_OVER} / sum(t2 * t2) {_OVER} AS c42 FROM held2)",
    "held": f"SELECT *, b4 - c41 * b1 - c42 * t2 - c43 * t3 AS t4 FROM (SELECT *, sum(b4 * t3) {_OVER} / sum(t3 * t3) {_OVER} AS c43 FROM held3)",
    "vectors": " UNION ALL ".join(f"SELECT '{k}' AS kind, protocol, traded, period_month, {z} AS z FROM held" for k, z in _Z.items()),
    "gram": "SELECT kind, protocol, traded, i, j, sum(z[i] * z[j]) AS g FROM vectors, range(1, 11) a(i), range(1, 11) b(j) WHERE i <= len(z) AND j <= len(z) GROUP BY 1, 2, 3, 4, 5",
    "grams": "SELECT kind, protocol, traded, list(r ORDER BY i) AS m FROM (SELECT kind, protocol, traded, i, list(g ORDER BY j) || list(CASE WHEN i = j THEN 1.0 ELSE 0.0 END ORDER BY j) AS r FROM gram GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3",
    "swept": """SELECT kind, protocol, traded, CAST(1 AS BIGINT) AS k, m FROM grams UNION ALL SELECT kind, protocol, traded, k + 1,
        list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k]) ELSE list_transform(range(1, 2 * len(m) + 1), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END)
        FROM swept WHERE k <= len(m)""",
    "inverse": "SELECT kind, protocol, traded, i, j, m[i][len(m) + j] AS v FROM swept, range(1, 11) a(i), range(1, 11) b(j) WHERE k = len(m) + 1 AND i <= len(m) AND j <= len(m)",
    "answers": f"""SELECT kind, v.protocol, v.traded, instrument, i, sum(z[i] * excess) AS xy FROM vectors v JOIN windows w ON w.protocol = v.protocol AND w.traded = v.traded AND w.period_month = v.period_month, range(1, 11) a(i)
        WHERE i <= len(z) AND kind = CASE WHEN instrument IN {_BUILT_FROM} THEN 'spine' ELSE 'full' END GROUP BY 1, 2, 3, 4, 5""",
    "coefficients": "SELECT a.kind, a.protocol, a.traded, instrument, n.i, max(CASE WHEN n.i = n.j THEN n.v END) AS vii, sum(n.v * xy) AS b, sum(CASE WHEN n.i = n.j THEN xy END) AS own FROM answers a JOIN inverse n ON n.kind = a.kind AND n.protocol = a.protocol AND n.traded = a.traded AND n.j = a.i GROUP BY 1, 2, 3, 4, 5",
    "totals": "SELECT protocol, traded, instrument, count(*) AS t, sum(excess * excess) AS yy, var_samp(excess) AS vary FROM windows GROUP BY 1, 2, 3",
    "rests": "SELECT c.kind, protocol, traded, instrument, max(t) AS t, count(*) AS k, max(yy) - sum(b * own) AS ssr, max(vary) AS vary FROM coefficients c JOIN totals USING (protocol, traded, instrument) GROUP BY 1, 2, 3, 4",
    "loadings": f"""SELECT kind, protocol, traded, instrument, i, {_NAMES}[i - 1] AS factor, b, b / sqrt(ssr / (t - k) * vii) AS t_value FROM coefficients JOIN rests USING (kind, protocol, traded, instrument)
        UNION ALL SELECT 'identity', protocol, traded, instrument, 10, factor, b, NULL FROM (SELECT DISTINCT protocol, traded FROM windows),
        (VALUES ('SMALL', 'level', 1.0), ('SMALL', 'slope', 0.5), ('SMALL', 'credit', 0.0), ('SMALL', 'high_yield', 0.0), ('STANDARD', 'level', 1.0), ('STANDARD', 'slope', -0.5), ('STANDARD', 'credit', 0.0), ('STANDARD', 'high_yield', 0.0),
        ('MEDIUM', 'level', 1.0), ('MEDIUM', 'slope', 0.5), ('MEDIUM', 'credit', 1.0), ('MEDIUM', 'high_yield', 0.0), ('LARGE', 'level', 1.0), ('LARGE', 'slope', 0.5), ('LARGE', 'credit', 1.0), ('LARGE', 'high_yield', 1.0)) x(instrument, factor, b)""",
    "inflation": """SELECT n.kind, n.protocol, n.traded, max(n.v * (g.g - o.g * o.g / c.g)) AS vif FROM inverse n JOIN gram g ON g.kind = n.kind AND g.protocol = n.protocol AND g.traded = n.traded AND g.i = n.i AND g.j = n.i
        JOIN gram o ON o.kind = n.kind AND o.protocol = n.protocol AND o.traded = n.traded AND o.i = 1 AND o.j = n.i JOIN gram c ON c.kind = n.kind AND c.protocol = n.protocol AND c.traded = n.traded AND c.i = 1 AND c.j = 1
        WHERE n.i = n.j AND n.i > 1 GROUP BY 1, 2, 3""",
    "fits": """SELECT protocol, traded, NULL AS instrument, CASE kind WHEN 'full' THEN 'vif_orthogonal' WHEN 'spine' THEN 'vif_spine' ELSE 'vif_declared' END AS quantity, NULL AS factor, vif AS value, NULL AS determined FROM inflation
        UNION ALL SELECT protocol, traded, NULL, 'block_correlation', NULL, corr(b1, b2), NULL FROM held GROUP BY 1, 2
        UNION ALL SELECT protocol, traded, instrument, 'beta', factor, b, kind <> 'full' FROM loadings WHERE i > 1
        UNION ALL SELECT protocol, traded, instrument, 'beta_t', factor, t_value, kind <> 'full' FROM loadings WHERE i > 1 AND kind <> 'identity'
        UNION ALL SELECT protocol, traded, instrument, 'alpha', NULL, b, false FROM loadings WHERE i = 1 AND kind = 'full'
        UNION ALL SELECT protocol, traded, instrument, 'alpha_t', NULL, t_value, false FROM loadings WHERE i = 1 AND kind = 'full'
        UNION ALL SELECT protocol, traded, instrument, 'resid_var', NULL, CASE WHEN kind = 'full' THEN ssr / (t - 1) ELSE 0 END, kind <> 'full' FROM rests
        UNION ALL SELECT protocol, traded, instrument, 'explained_var', NULL, CASE WHEN kind = 'full' THEN vary - ssr / (t - 1) ELSE vary END, kind <> 'full' FROM rests
        UNION ALL SELECT protocol, traded, instrument, 'r2', NULL, CASE WHEN kind = 'full' THEN 1 - ssr / (t - 1) / vary ELSE 1 END, kind <> 'full' FROM rests
        UNION ALL SELECT protocol, traded, instrument, 'f', NULL, (vary * (t - 1) - ssr) / (k - 1) / (ssr / (t - k)), false FROM rests WHERE kind = 'full'
        UNION ALL SELECT protocol, traded, instrument, 'spine_r2', NULL, 1 - ssr / (t - 1) / vary, true FROM rests WHERE kind = 'spine'""",
    "short": "SELECT protocol, traded, period_month, [1.0, s1, s2, s3] AS z FROM held0",
    "first_gram": "SELECT protocol, traded, i, j, sum(z[i] * z[j]) AS g FROM short, range(1, 5) a(i), range(1, 5) b(j) GROUP BY 1, 2, 3, 4",
    "first_rows": _ROWS_OF.format("first_gram"),
    "first_swept": _SWEEP.format("first_rows", "first_swept"),
    "first_inverse": _INVERSE_OF.format("first_swept"),
    "first_answers": "SELECT v.protocol, v.traded, instrument, i, sum(z[i] * excess) AS xy FROM short v JOIN windows w ON w.protocol = v.protocol AND w.traded = v.traded AND w.period_month = v.period_month, range(1, 5) a(i) GROUP BY 1, 2, 3, 4",
    "slopes": "SELECT a.protocol, a.traded, instrument, n.i, CASE WHEN n.i = 1 THEN 1.0 ELSE sum(n.v * xy) END AS b FROM first_answers a JOIN first_inverse n ON n.protocol = a.protocol AND n.traded = a.traded AND n.j = a.i GROUP BY 1, 2, 3, 4",
    "second_gram": "SELECT x.protocol, x.traded, x.i, y.i AS j, sum(x.b * y.b) AS g FROM slopes x JOIN slopes y ON y.protocol = x.protocol AND y.traded = x.traded AND y.instrument = x.instrument GROUP BY 1, 2, 3, 4",
    "second_rows": _ROWS_OF.format("second_gram"),
    "second_swept": _SWEEP.format("second_rows", "second_swept"),
    "second_inverse": _INVERSE_OF.format("second_swept"),
    "pricing": "SELECT n.protocol, n.traded, n.i, s.instrument, sum(n.v * s.b) AS w FROM second_inverse n JOIN slopes s ON s.protocol = n.protocol AND s.traded = n.traded AND s.i = n.j GROUP BY 1, 2, 3, 4",
    "prices_of_risk": "SELECT p.protocol, p.traded, p.i, r.period_month, sum(p.w * r.excess) AS x FROM pricing p JOIN windows r ON r.protocol = p.protocol AND r.traded = p.traded AND r.instrument = p.instrument GROUP BY 1, 2, 3, 4",
    "projections": "SELECT protocol, traded, any_value(c21) AS c21, any_value(c31) AS c31, any_value(c32) AS c32, any_value(c41) AS c41, any_value(c42) AS c42, any_value(c43) AS c43 FROM held GROUP BY 1, 2",
    "moved2": "SELECT p.*, n.* EXCLUDE (period_month), b2 - c21 * b1 AS u2 FROM projections p JOIN named n ON n.period_month = p.traded WHERE protocol = 'rolling'",
    "moved3": "SELECT *, b3 - c31 * b1 - c32 * u2 AS u3 FROM moved2",
    "moved": "SELECT *, b4 - c41 * b1 - c42 * u2 - c43 * u3 AS u4 FROM moved3",
    "current": " UNION ALL ".join(f"SELECT traded, '{n}' AS factor, {c} AS f FROM moved" for n, c in zip(_NAMES, ("s1", "s2", "s3", "s4", "s5", "b1", "u2", "u3", "u4"), strict=True)),
    "gaps": "SELECT run_id, traded, instrument, weight - policy AS a, excess, euro FROM traded_returns",
    "parts": "SELECT run_id, g.traded, l.factor, sum(a * b * f) AS value, sum(a * b) AS e FROM gaps g JOIN loadings l ON l.protocol = 'rolling' AND l.traded = g.traded AND l.instrument = g.instrument AND l.i > 1 JOIN current c ON c.traded = g.traded AND c.factor = l.factor GROUP BY 1, 2, 3",
}
_RATIO = "CASE WHEN count({0}) < 2 THEN NULL WHEN stddev_samp({0}) <= 1e-12 THEN 0.0 ELSE avg({0}) / stddev_samp({0}) * sqrt(12.0) END"


def _sql(body: str) -> str:
    """The body behind the named relations it needs."""
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in _CTES:
            if name not in need and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                todo.append(_CTES[name])
    head = ",\n".join(f"{n} AS ({_CTES[n]})" for n in _CTES if n in need)
    return f"WITH RECURSIVE {head}\n{body}" if head else body


def register(sql: str | None = None):
    def add(function):
        @functools.wraps(function)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            with scope():
                return function(spark, sf_dir)

        QUERIES[function.__name__] = query
        if sql:
            ORACLE_SQL[function.__name__] = _sql(sql)
        return query

    return add


def rounded(frame: DataFrame, digits: int = DIGITS) -> DataFrame:
    return frame.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def _round(columns: str, digits: int = DIGITS) -> str:
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))


# Sources, calendar and joins


@register(f"SELECT period_month, instrument, currency, {_round('local, translation, euro, rf, excess')} FROM returns")
def returns(spark, d):
    return rounded(P.load(spark, d).returns)


@register(f"SELECT instrument, period_month, available_from, currency, {_round('close, adj_close, dividend', 6)} FROM prices")
def long_table(spark, d):
    return rounded(P.prices(spark, d).drop("kind"), 6)


@register("SELECT instrument, count(*) AS n_rows, min(period_month) AS first, max(period_month) AS last FROM prices GROUP BY 1")
def measure(spark, d):
    return P.prices(spark, d).groupBy("instrument").agg(F.count("*").alias("n_rows"), F.min("period_month").alias("first"), F.max("period_month").alias("last"))


@register(f"SELECT instrument, period_month, {_round('adj_close', 6)} FROM prices WHERE available_from <= DATE '1999-06-15'")
def as_of(spark, d):
    return rounded(C.as_of(P.prices(spark, d), "1999-06-15T23:30:00+02:00").select("instrument", "period_month", "adj_close"), 6)


@register("SELECT instrument, min(period_month) AS first, max(period_month) AS last, count(DISTINCT period_month) AS months, count(DISTINCT period_month) FILTER (WHERE available_from <= DATE '1999-06-15') AS visible FROM prices GROUP BY 1")
def coverage(spark, d):
    rows = P.prices(spark, d).select("instrument", "period_month", "available_from").distinct()
    seen = F.count_if(F.col("available_from") <= F.lit("1999-06-15").cast("date"))
    return rows.groupBy("instrument").agg(F.min("period_month").alias("first"), F.max("period_month").alias("last"), F.count("*").alias("months"), seen.alias("visible"))


@register("SELECT factor, min(period_month) AS first, max(period_month) AS last, count(DISTINCT period_month) AS months, date_diff('month', min(period_month), max(period_month)) + 1 - count(DISTINCT period_month) AS missing FROM factors GROUP BY 1")
def month_span(spark, d):
    return C.month_span(P.load(spark, d).factors, ["factor"])


@register("SELECT period_month FROM months")
def joined_months(spark, d):
    return P.load(spark, d).months


@register("SELECT instrument, period_month FROM prices WHERE period_month BETWEEN DATE '1996-01-01' AND DATE '2000-12-01'")
def window_trim(spark, d):
    return C.window(P.prices(spark, d), "1996-01-01", "2000-12-01")[0].select("instrument", "period_month")


@register("SELECT count(*) FILTER (WHERE period_month NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-01') AS dropped FROM prices")
def window_dropped(spark, d):
    return C.window(P.prices(spark, d), "1996-01-01", "2000-12-01")[1]


@register(f"SELECT instrument, period_month, currency, {_round('local, translation, euro')} FROM split")
def currency_split(spark, d):
    p = P.load(spark, d)
    return rounded(R.currency_split(p.prices.join(p.months, "period_month", "left_semi"), p.fx))


@register(f"SELECT day, {_round('pct')} FROM spliced")
def splice_risk_free(spark, d):
    return rounded(R.splice(P.overnight(spark, d), P.SPLICE))


@register("SELECT round(avg(a.pct - b.pct) * 100, 8) AS basis_bp, count(*) AS overlap_days FROM rates a JOIN rates b ON a.day = b.day WHERE a.leg = 'A' AND b.leg = 'B'")
def splice_basis(spark, d):
    return rounded(R.splice_basis(P.overnight(spark, d)))


@register(f"SELECT period_month, {_round('rf')} FROM cash")
def accrue_monthly(spark, d):
    return rounded(R.accrue_monthly(R.splice(P.overnight(spark, d), P.SPLICE)))


@register("SELECT CAST(date_trunc('month', day) AS DATE) AS period_month, round(max_by(pct, day), 8) AS level FROM spliced GROUP BY 1")
def monthly_last(spark, d):
    return rounded(R.monthly_last(R.splice(P.overnight(spark, d), P.SPLICE)))


@register(f"SELECT factor, period_month, {_round('ret')} FROM factors")
def monthly_returns(spark, d):
    return rounded(P.load(spark, d).factors)


@register("SELECT factor, f.period_month, round((1 + ret) / (1 + fx) - 1, 8) AS eur FROM factors f JOIN fxret x ON f.period_month = x.period_month")
def eur_translate(spark, d):
    p = P.load(spark, d)
    return rounded(R.eur_translate(p.factors, p.fx).select("factor", "period_month", "eur"))


@register("SELECT instrument, period_month, round(adj_close / lag(adj_close) OVER w - 1, 8) AS local, round((close + coalesce(dividend, 0)) / lag(close) OVER w - 1, 8) AS rebuilt FROM prices WINDOW w AS (PARTITION BY instrument ORDER BY period_month)")
def total_returns(spark, d):
    return rounded(R.recomputed_total_return(R.total_return(P.prices(spark, d))).select("instrument", "period_month", "local", "rebuilt"))


_RAW = {"prices": "prices", "fx": "fx", "leg_a": "(SELECT day, pct FROM rates WHERE leg = 'A')", "leg_b": "(SELECT day, pct FROM rates WHERE leg = 'B')"}
_WHEN = {"splice": P.SPLICE, "when": "2000-12-15", "start": "1995-06-01", "end": "2000-12-01"}


def _views_of(spark, d):
    p, rates = P.load(spark, d), P.overnight(spark, d)
    return p, Views(prices=p.prices, fx=p.fx, cash=p.cash, leg_a=rates.where("leg = 'A'").select("day", "pct"), leg_b=rates.where("leg = 'B'").select("day", "pct"))


@register(f"SELECT instrument, currency, period_month, {_round('local, fx, rf, excess')} FROM ({RETURNS.format(**_RAW, **_WHEN)})")
def sql_returns(spark, d):
    """The return table as it stood at a moment, one statement over raw legs in both engines."""
    return rounded(_views_of(spark, d)[1].statement(**_WHEN))


@register(f"SELECT count(*) AS cells, count(*) FILTER (WHERE (a.excess IS NULL) <> (b.excess IS NULL) OR abs(a.excess - b.excess) > 1e-10)::INTEGER AS mismatches, round(max(abs(a.excess - b.excess)), 8) AS worst FROM returns a FULL JOIN ({RETURNS.format(**_RAW, splice=P.SPLICE, when='2001-08-15', start='1995-01-01', end='2001-07-01')}) b ON a.period_month = b.period_month AND a.instrument = b.instrument")
def returns_agreement(spark, d):
    """The excess table against the same returns as one SQL statement over raw legs."""
    p, views = _views_of(spark, d)
    first, last = p.months.agg(F.min("period_month"), F.max("period_month")).first()
    edge = p.months.agg(F.date_add(F.add_months(F.max("period_month"), 1), 14)).first()[0]
    out = R.agreement(p.returns, views.statement(P.SPLICE, edge, str(first), str(last)), ["period_month", "instrument"], "excess")
    return rounded(out.withColumn("mismatches", F.col("mismatches").cast("int")))


@register("SELECT period_month, round((max(CASE WHEN instrument = 'SMALL' THEN excess END) + max(CASE WHEN instrument = 'STANDARD' THEN excess END)) / 2, 8) AS level, round(max(CASE WHEN instrument = 'SMALL' THEN excess END) - max(CASE WHEN instrument = 'STANDARD' THEN excess END), 8) AS slope, round(max(CASE WHEN instrument = 'MEDIUM' THEN excess END) - max(CASE WHEN instrument = 'SMALL' THEN excess END), 8) AS credit, round(max(CASE WHEN instrument = 'LARGE' THEN excess END) - max(CASE WHEN instrument = 'MEDIUM' THEN excess END), 8) AS high_yield FROM returns GROUP BY 1")
def constructed_block(spark, d):
    return rounded(R.constructed_block(P.load(spark, d).returns, "SMALL", "STANDARD", "MEDIUM", "LARGE"))


@register("SELECT period_month, " + ", ".join(f"round(max(CASE WHEN factor = '{s}' THEN ret END), 8) AS {s.lower()}" for s in _SEGMENTS) + ", round(max(excess) FILTER (WHERE instrument = 'SMALL'), 8) AS level FROM factors JOIN returns USING (period_month) GROUP BY 1")
def named_set(spark, d):
    p = P.load(spark, d)
    spine = R.wide(p.factors, list(_SEGMENTS), "ret", "factor").select("period_month", *[F.col(s).alias(s.lower()) for s in _SEGMENTS])
    block = p.returns.where("instrument = 'SMALL'").select("period_month", F.col("excess").alias("level"))
    return rounded(R.named_set(spine, block))


@register("SELECT protocol, traded, window_start, window_end, CAST(months AS INTEGER) AS months, CAST(window_end + INTERVAL 1 MONTH AS DATE) AS available_from, window_end AS gated_by, 'monthly' AS refit FROM steps")
def walk_forward_steps(spark, d):
    return B.all_steps(P.load(spark, d).months).drop("window")


def _windows(spark, d):
    p = P.load(spark, d)
    return p, once(spark, ("windows", d), lambda: B.window_rows(p.returns, B.all_steps(p.months), P.universe(spark)))


def _covariance(spark, d):
    """protocol, traded, i, j, value of every window, by running frames over the months."""
    p = P.load(spark, d)
    return once(spark, ("covariance", d), lambda: A.window_covariance(p.returns, p.months))


@register("SELECT protocol, traded, count(DISTINCT period_month) AS observations, count(*) AS cells, max(period_month) AS newest FROM windows GROUP BY 1, 2")
def window_block(spark, d):
    return _windows(spark, d)[1].groupBy("protocol", "traded").agg(F.countDistinct("period_month").alias("observations"), F.count("*").alias("cells"), F.max("period_month").alias("newest"))


@register("SELECT protocol, traded, 'row at or after the traded month' AS rule FROM windows WHERE period_month >= traded")
def no_look_ahead(spark, d):
    months = P.load(spark, d).months
    return C.look_ahead(B.all_steps(months), _windows(spark, d)[1], months)


@register(f"SELECT instrument, period_month, {_round('adj_close', 6)} FROM prices WHERE available_from <= DATE '1999-06-15'")
def as_of_view(spark, d):
    """The as-of rule stated in SQL over the panel's views."""
    p = P.load(spark, d)
    return rounded(Views(prices=p.prices, fx=p.fx, cash=p.cash).as_of("1999-06-15T23:30:00+02:00").select("instrument", "period_month", "adj_close"), 6)


@register("SELECT count(DISTINCT instrument) AS instruments, count(DISTINCT (instrument, period_month)) AS months, 0 AS differences, true AS agrees FROM prices")
def coverage_views(spark, d):
    """Coverage in DataFrame functions against coverage stated in SQL."""
    p = P.load(spark, d)
    seen = p.prices.groupBy("instrument").agg(F.min("period_month").alias("first"), F.max("period_month").alias("last"), F.countDistinct("period_month").alias("months"))
    out = coverage_agreement(seen, Views(prices=p.prices, fx=p.fx, cash=p.cash).coverage("2001-08-15"))
    return out.withColumn("differences", F.col("differences").cast("int"))


# Quality gate


@register("""SELECT instrument, 'implausible move' AS rule, CAST(period_month AS VARCHAR) AS detail FROM (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY instrument ORDER BY period_month) - 1 AS r FROM prices) WHERE abs(r) > 0.05
    UNION ALL SELECT instrument, 'line starting late', CAST(min(period_month) AS VARCHAR) FROM prices GROUP BY 1 HAVING min(period_month) > DATE '1994-12-01'
    UNION ALL SELECT instrument, 'too-fresh bar', CAST(period_month AS VARCHAR) FROM prices WHERE available_from > DATE '2001-08-15'""")
def quality_stops(spark, d):
    """Every rule at bounds tight enough for these prices to break some of them."""
    bounds = {n: 0.05 for n, *_ in P.UNIVERSE}
    return Q.violations(P.prices(spark, d), P.facts(spark), "1994-12-01", "2001-08-15", bounds).select("instrument", "rule", "detail")


@register("SELECT instrument, round(product(1 + local) - product(1 + rebuilt), 6) AS gap FROM (SELECT instrument, adj_close / lag(adj_close) OVER w - 1 AS local, (close + coalesce(dividend, 0)) / lag(close) OVER w - 1 AS rebuilt FROM prices WINDOW w AS (PARTITION BY instrument ORDER BY period_month)) WHERE local IS NOT NULL GROUP BY 1 HAVING abs(product(1 + local) - product(1 + rebuilt)) > 0.02")
def warn_tr_divergence(spark, d):
    return rounded(Q.warn_divergence(P.prices(spark, d)), 6)


@register("SELECT instrument, round(eur, 2) AS eur, eur IS NOT NULL AS screened FROM (SELECT instrument, TRY_CAST(regexp_extract(replace(size, ',', ''), '^([A-Z]{3})\\s+([0-9.]+)(bn|m|k)$', 2) AS DOUBLE) * CASE regexp_extract(replace(size, ',', ''), '^([A-Z]{3})\\s+([0-9.]+)(bn|m|k)$', 3) WHEN 'bn' THEN 1e9 WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 END * CASE WHEN size LIKE 'EUR%' THEN 1.0 ELSE (SELECT 1 / max_by(close, period_month) FROM fx) END AS eur FROM facts) WHERE eur IS NULL OR eur < 1.35e9")
def warn_thin_liquidity(spark, d):
    return rounded(Q.warn_liquidity(P.facts(spark), Q.newest_rates(P.load(spark, d).fx)), 2)


@register("SELECT DISTINCT period_month FROM prices WHERE period_month NOT IN (SELECT period_month FROM factors)")
def warn_factor_trim(spark, d):
    p = P.load(spark, d)
    return Q.warn_factor_trim(p.prices, p.factors)


@register("SELECT * FROM (SELECT p.instrument, year(period_month)::INTEGER AS year, count(*) AS events, f.income, CASE WHEN lower(income) NOT LIKE 'distributing%' THEN 0 WHEN lower(income) LIKE '%quarterly%' THEN 4 WHEN lower(income) LIKE '%semi-annual%' THEN 2 WHEN lower(income) LIKE '%annual%' THEN 1 ELSE 12 END AS allowed FROM prices p JOIN facts f ON f.instrument = p.instrument WHERE dividend > 0 GROUP BY 1, 2, 4) WHERE events > allowed")
def warn_extra_distributions(spark, d):
    return Q.warn_distributions(P.prices(spark, d), P.facts(spark)).select("instrument", "year", "events", "income", "allowed")


# Aggregations, covariances and books


@register("SELECT factor, round(avg(ret), 8) AS mean, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 6) AS t FROM factors GROUP BY 1")
def premiums(spark, d):
    t = F.avg("ret") / (F.stddev_samp("ret") / F.sqrt(F.count("*")))
    return P.load(spark, d).factors.groupBy("factor").agg(F.round(F.avg("ret"), 8).alias("mean"), F.round(t, 6).alias("t"))


@register(f"SELECT protocol, traded, i, j, {_round('value', 10)} FROM cov")
def rolling_covariance(spark, d):
    return rounded(_covariance(spark, d), 10)


@register("SELECT a.instrument AS i, b.instrument AS j, round(corr(a.excess, b.excess), 8) AS value FROM returns a JOIN returns b ON a.period_month = b.period_month GROUP BY 1, 2")
def correlation_matrix(spark, d):
    r = P.load(spark, d).returns
    a, b = (r.select("period_month", F.col("instrument").alias(k), F.col("excess").alias(v)) for k, v in (("i", "x"), ("j", "y")))
    return a.join(b, "period_month").groupBy("i", "j").agg(F.round(F.corr("x", "y"), 8).alias("value"))


def _books(spark, d):
    p, windows = _windows(spark, d)
    return p, windows, once(spark, ("books", d), lambda: _simple_books(spark, windows))


def _simple_books(spark, windows):
    dim = P.universe(spark)
    months = windows.select("traded").distinct()
    equal = months.crossJoin(F.broadcast(dim)).select(F.lit("equal_weight").alias("run_id"), "traded", "instrument", F.lit(1.0 / len(P.UNIVERSE)).alias("weight"))
    policy = months.crossJoin(F.broadcast(dim)).select(F.lit("policy").alias("run_id"), "traded", "instrument", F.col("policy").alias("weight"))
    sd = windows.where("protocol = 'rolling'").groupBy("traded", "instrument").agg((1 / F.stddev_samp("excess")).alias("x"))
    inverse = sd.select(F.lit("inverse_volatility").alias("run_id"), "traded", "instrument", (F.col("x") / F.sum("x").over(Window.partitionBy("traded"))).alias("weight"))
    return equal.unionByName(policy).unionByName(inverse)


def _series(spark, d):
    p, windows, books = _books(spark, d)
    return p, windows, books, once(spark, ("series", d), lambda: _simple_series(p, books))


def _simple_series(p, books):
    before = F.lag("weight").over(Window.partitionBy("run_id", "instrument").orderBy("traded"))
    moved = books.withColumn("move", F.abs(F.col("weight") - before))
    rows = moved.join(p.returns.withColumnRenamed("period_month", "traded"), ["traded", "instrument"])
    out = rows.groupBy("run_id", "traded").agg(F.sum(F.col("weight") * F.col("excess")).alias("gross"), F.coalesce(F.sum("move") / 2, F.lit(0.0)).alias("turnover"))
    out = out.withColumn("net", F.col("gross") - M.cost(F.col("turnover")))
    return M.active(out, out.where("run_id = 'policy'").select("traded", F.col("gross").alias("net")))


@register(f"SELECT run_id, traded, instrument, {_round('weight')} FROM books")
def simple_books(spark, d):
    return rounded(_books(spark, d)[2])


@register(f"SELECT run_id, traded, {_round('gross, turnover, net, bench, active')} FROM active")
def book_series(spark, d):
    return rounded(_series(spark, d)[3].select("run_id", "traded", "gross", "turnover", "net", "bench", "active"))


@register(f"SELECT run_id, n, round(information_ratio, 6) AS information_ratio, round(volatility, 8) AS volatility, round(tracking_error, 8) AS tracking_error, round(cumulative, 8) AS cumulative, round(drawdown, 8) AS drawdown FROM (SELECT run_id, count(*) AS n, {_RATIO.format('active')} AS information_ratio, stddev_samp(net) * sqrt(12.0) AS volatility, stddev_samp(active) * sqrt(12.0) AS tracking_error, product(1 + net) - 1 AS cumulative FROM active GROUP BY 1) JOIN (SELECT run_id, min(curve / peak - 1) AS drawdown FROM (SELECT run_id, traded, curve, max(curve) OVER (PARTITION BY run_id ORDER BY traded) AS peak FROM (SELECT run_id, traded, product(1 + net) OVER (PARTITION BY run_id ORDER BY traded) AS curve FROM active)) GROUP BY 1) USING (run_id)")
def metric_block(spark, d):
    out = M.block(_series(spark, d)[3], "run_id")
    return rounded(out.withColumn("information_ratio", F.round("information_ratio", 6)))


@register("SELECT run_id, round(avg(net - gross), 8) AS mean_monthly, round(avg(net - gross) * 12, 8) AS annualised, round(product(1 + net) - product(1 + gross), 8) AS drag FROM series GROUP BY 1")
def cost_line(spark, d):
    return rounded(M.cost_line(_series(spark, d)[3], "run_id"))


@register(f"SELECT run_id, bp, round(avg(paid) * 12, 8) AS cost_per_year, round(product(1 + kept) - 1, 8) AS cumulative, round({_RATIO.format('(kept - bench)')}, 6) AS information_ratio FROM (SELECT *, 2 * turnover * bp / 1e4 AS paid, gross - 2 * turnover * bp / 1e4 AS kept FROM active, (VALUES (5.0::DOUBLE), (20.0), (40.0)) r(bp)) GROUP BY 1, 2")
def cost_sensitivity(spark, d):
    out = M.sensitivity(_series(spark, d)[3], "run_id")
    return rounded(out.withColumn("information_ratio", F.round("information_ratio", 6)))


@register("SELECT run_id, period, count(*) AS n, round(CASE WHEN count(*) > 2 THEN " + _RATIO.format("active") + " END, 6) AS information_ratio FROM active JOIN (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _BINS) + ") p(period, lo, hi) ON traded BETWEEN lo AND hi GROUP BY 1, 2")
def sub_periods(spark, d):
    return rounded(M.sub_periods(_series(spark, d)[3], "run_id", _BINS), 6)


@register(f"SELECT run_id, n, round(ir - ir_base, 6) AS difference, round(rho, 6) AS rho, round(se, 6) AS se, round((ir - ir_base) / se, 6) AS z, round({K.family_wise_bar(16) + K.POWER_QUANTILE!r} * se, 6) AS resolution FROM (SELECT *, sqrt(12.0 / n) * sqrt(2 * (1 - rho)) AS se FROM (SELECT a.run_id, count(*) AS n, {_RATIO.format('a.active')} AS ir, {_RATIO.format('b.active')} AS ir_base, corr(a.net, b.net) AS rho FROM active a JOIN active b ON a.traded = b.traded WHERE b.run_id = 'equal_weight' AND a.run_id = 'inverse_volatility' GROUP BY 1))")
def paired_test(spark, d):
    rows = _series(spark, d)[3].where("run_id <> 'policy'")
    return rounded(M.paired(rows, "run_id", "equal_weight", K.family_wise_bar(16), K.POWER_QUANTILE), 6)


_BARE = "CASE WHEN stddev_samp({0}) > 1e-12 THEN avg({0}) / stddev_samp({0}) * sqrt(12.0) END"
_CTES |= D.pcg_sql("picks", "(SELECT count(DISTINCT traded) FROM active)", f"(SELECT {D.RESAMPLES} * count(DISTINCT traded) FROM active)") | {
    "placed_active": "SELECT run_id, active, row_number() OVER (PARTITION BY run_id ORDER BY traded) - 1 AS month_index FROM active",
    "drawn": f"SELECT k // (SELECT count(DISTINCT traded) FROM active) AS draw, run_id, {_BARE.format('active')} AS ir FROM picks JOIN placed_active ON month_index = v GROUP BY 1, 2",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY draw ORDER BY round(ir, 10) DESC NULLS LAST, run_id) AS rank FROM drawn",
    "actual": f"SELECT run_id, {_BARE.format('active')} AS actual FROM active GROUP BY 1",
}


@register("SELECT run_id, round(avg(CASE WHEN rank = 1 AND ir IS NOT NULL THEN 1.0 ELSE 0.0 END), 8) AS first_share, round(quantile_cont(rank, 0.5), 8) AS median_rank, round(avg(CASE WHEN sign(ir) = sign(actual) THEN 1.0 ELSE 0.0 END), 8) AS own_sign, round(max(actual), 6) AS actual, run_id = (SELECT run_id FROM actual WHERE actual IS NOT NULL ORDER BY round(actual, 10) DESC, run_id LIMIT 1) AS leads FROM ranked JOIN actual USING (run_id) GROUP BY 1")
def rank_retention_table(spark, d):
    """The seeded bootstrap of 2,000 resamples over the simple books, the benchmark among
    them: it does not vary, so it ranks last and keeps no sign."""
    rows = _series(spark, d)[3]
    months = rows.select("traded").distinct().count()
    out = M.retention(rows, "run_id", D.resampled_months(spark, months))
    return rounded(out.withColumn("actual", F.round("actual", 6)))


_PAIRS = "SELECT a.run_id AS i, b.run_id AS j, corr(a.net, b.net) AS r FROM active a JOIN active b ON a.traded = b.traded GROUP BY 1, 2"


@register(f"SELECT filled, round(effective, 8) AS effective, round(bars[filled], 8) AS bar, round(bars[greatest(round_even(effective, 0), 1)::INT], 8) AS adjusted_bar FROM (SELECT n::INTEGER AS filled, greatest(1.0, 1 + (n - 1) * (1 - (s / n - 1) / n)) AS effective, {[K.family_wise_bar(k) for k in range(1, 17)]} AS bars FROM (SELECT count(DISTINCT i) AS n, sum(r * r) AS s FROM ({_PAIRS})))")
def effective_tests(spark, d):
    """Nyholt's number of independent tests among the simple books, and both bars."""
    rows = _series(spark, d)[3].select("traded", "run_id", "net")
    a, b = (rows.select("traded", F.col("run_id").alias(k), F.col("net").alias(v)) for k, v in (("i", "x"), ("j", "y")))
    pairs = a.join(b, "traded").groupBy("i", "j").agg(F.corr("x", "y").alias("value"))
    return rounded(M.effective_tests(pairs, [K.family_wise_bar(k) for k in range(1, 17)]))


# Attribution and budget


def _members(spark, d):
    p, windows, books = _books(spark, d)
    rows = books.join(p.returns.withColumnRenamed("period_month", "traded"), ["traded", "instrument"])
    return p, windows, rows.join(F.broadcast(P.universe(spark).select("instrument", "policy", "grp")), "instrument")


_LINES = """SELECT run_id, traded AS period_month, sum((weight - policy) * (local - local_b)) AS allocation, sum((weight - policy) * translation) AS currency, sum((weight - policy) * local * translation) AS interaction,
    sum((weight - policy) * euro) AS active, sum(policy * euro) AS benchmark, sum(weight * euro) AS portfolio, sum(policy * euro) - max(rf) AS level
    FROM (SELECT *, sum(policy * local) OVER (PARTITION BY run_id, traded) AS local_b FROM traded_returns) GROUP BY 1, 2"""


@register(f"SELECT run_id, period_month, {_round('allocation, currency, interaction, active, benchmark, portfolio, level')} FROM ({_LINES})")
def allocation_lines(spark, d):
    rows = _members(spark, d)[2].withColumnRenamed("traded", "period_month").withColumnRenamed("weight", "book")
    return rounded(A.allocation_lines(rows).drop("residual"))


@register("SELECT traded AS period_month, round(sum((weight - policy) * (excess - b)), 8) AS allocation, round(sum(policy * (euro - excess)), 8) AS selection, round(sum((weight - policy) * (euro - excess)), 8) AS interaction, round(sum((weight - policy) * excess), 8) AS allocation_bhb FROM (SELECT *, sum(policy * excess) OVER (PARTITION BY traded) AS b FROM traded_returns WHERE run_id = 'equal_weight') GROUP BY 1")
def brinson_single_period(spark, d):
    rows = _members(spark, d)[2].where("run_id = 'equal_weight'")
    rows = rows.select(F.col("traded").alias("period_month"), "weight", "policy", F.col("euro").alias("ret"), F.col("excess").alias("bench_ret"))
    return rounded(A.single_period(rows))


def _linked(way: str) -> str:
    k = "CASE WHEN abs(portfolio - benchmark) > 1e-12 THEN (ln(1 + portfolio) - ln(1 + benchmark)) / (portfolio - benchmark) ELSE 1 / (1 + portfolio) END"
    return k if way == "k" else ""


@register(f"""SELECT run_id, {', '.join(f'round(sum({e} * k / big), 8) AS {e}_carino, round(sum({e} * (m + a)), 8) AS {e}_menchero' for e in ('allocation', 'currency', 'interaction'))}, round(max(p - b), 8) AS active FROM (
    SELECT *, CASE WHEN d2 > 1e-12 THEN (p - b - m * d1) * (portfolio - benchmark) / d2 ELSE 0 END AS a FROM (
    SELECT *, {_linked('k')} AS k, CASE WHEN abs(p - b) > 1e-12 THEN (ln(1 + p) - ln(1 + b)) / (p - b) ELSE 1 / (1 + p) END AS big,
    CASE WHEN abs(pow(1 + p, 1 / n) - pow(1 + b, 1 / n)) > 1e-12 THEN ((p - b) / n) / (pow(1 + p, 1 / n) - pow(1 + b, 1 / n)) ELSE pow(1 + p, (n - 1) / n) END AS m FROM ({_LINES}) l
    JOIN (SELECT run_id, product(1 + portfolio) - 1 AS p, product(1 + benchmark) - 1 AS b, CAST(count(*) AS DOUBLE) AS n, sum(portfolio - benchmark) AS d1, sum((portfolio - benchmark) * (portfolio - benchmark)) AS d2 FROM ({_LINES}) GROUP BY 1) t USING (run_id))) GROUP BY 1""")
def linked_effects(spark, d):
    rows = _members(spark, d)[2].withColumnRenamed("traded", "period_month").withColumnRenamed("weight", "book")
    return rounded(A.linking(A.allocation_lines(rows)).drop("residual_carino", "residual_menchero"))


@register(f"""SELECT run_id, instrument, {', '.join(f'round(sum({e} * k / big), 8) AS {e}' for e in ('allocation', 'currency', 'interaction'))} FROM (
    SELECT r.run_id, r.traded, instrument, (weight - policy) * (local - local_b) AS allocation, (weight - policy) * translation AS currency, (weight - policy) * local * translation AS interaction, {_linked('k')} AS k,
    CASE WHEN abs(p - b) > 1e-12 THEN (ln(1 + p) - ln(1 + b)) / (p - b) ELSE 1 / (1 + p) END AS big FROM (SELECT *, sum(policy * local) OVER (PARTITION BY run_id, traded) AS local_b FROM traded_returns) r
    JOIN ({_LINES}) l ON l.run_id = r.run_id AND l.period_month = r.traded JOIN (SELECT run_id, product(1 + portfolio) - 1 AS p, product(1 + benchmark) - 1 AS b FROM ({_LINES}) GROUP BY 1) t ON t.run_id = r.run_id) GROUP BY 1, 2""")
def linked_by_sleeve(spark, d):
    rows = _members(spark, d)[2].withColumnRenamed("traded", "period_month").withColumnRenamed("weight", "book")
    return rounded(A.linked_by_sleeve(A.sleeve_lines(rows), A.allocation_lines(rows)))


_EULER = """SELECT run_id, w.traded, w.i AS instrument, weight, sqrt(variance) AS volatility, m / sqrt(variance) AS marginal, weight * m / sqrt(variance) AS contribution, weight * m / variance AS share FROM (
    SELECT *, sum(weight * m) OVER (PARTITION BY run_id, traded) AS variance FROM (SELECT b.run_id, b.traded, b.instrument AS i, max(b.weight) AS weight, sum(c.value * x.weight) AS m
    FROM books b JOIN cov c ON c.protocol = 'rolling' AND c.traded = b.traded AND c.i = b.instrument JOIN books x ON x.run_id = b.run_id AND x.traded = b.traded AND x.instrument = c.j GROUP BY 1, 2, 3)) w"""


def _euler(spark, d):
    p, windows, books = _books(spark, d)
    cov = _covariance(spark, d).where("protocol = 'rolling'").drop("protocol")
    return p, A.contributions(books, cov, ["run_id", "traded"])


@register(f"SELECT run_id, traded, instrument, {_round('weight, volatility, marginal, contribution, share')} FROM ({_EULER})")
def risk_contributions(spark, d):
    return rounded(_euler(spark, d)[1])


@register(f"SELECT run_id, traded, grp, round(sum(share), 8) AS consumed, round(max(declared), 8) AS declared, round(sum(share) - max(declared), 8) AS gap, false AS undeclared FROM ({_EULER}) JOIN universe USING (instrument) JOIN (VALUES {', '.join(f'({g!r}, {v})' for g, v in P.RISK_BUDGET.items())}) t(grp, declared) USING (grp) GROUP BY 1, 2, 3")
def risk_budget(spark, d):
    return rounded(A.budget(_euler(spark, d)[1], P.universe(spark), P.RISK_BUDGET, ["run_id", "traded"]))


@register(f"SELECT run_id, round(max(abs(total / volatility - 1)), 8) AS worst FROM (SELECT run_id, traded, sum(contribution) AS total, max(volatility) AS volatility FROM ({_EULER}) GROUP BY 1, 2) GROUP BY 1")
def euler_additivity(spark, d):
    rows = _euler(spark, d)[1].groupBy("run_id", "traded").agg(F.sum("contribution").alias("total"), F.max("volatility").alias("volatility"))
    return rounded(rows.groupBy("run_id").agg(F.max(F.abs(F.col("total") / F.col("volatility") - 1)).alias("worst")))


@register("""SELECT run_id, round(avg(ex_ante), 8) AS ex_ante, round(max(ex_post), 8) AS ex_post, round(avg(ex_ante) - max(ex_post), 8) AS difference, round(CASE WHEN avg(ex_ante) > 0 THEN max(ex_post) / avg(ex_ante) END, 8) AS ratio FROM (SELECT b.run_id, b.traded, sqrt(12 * greatest(sum((b.weight - ub.policy) * c.value * (x.weight - ux.policy)), 0)) AS ex_ante
    FROM books b JOIN universe ub ON ub.instrument = b.instrument JOIN cov c ON c.protocol = 'rolling' AND c.traded = b.traded AND c.i = b.instrument JOIN books x ON x.run_id = b.run_id AND x.traded = b.traded AND x.instrument = c.j JOIN universe ux ON ux.instrument = x.instrument GROUP BY 1, 2)
    JOIN (SELECT run_id, stddev_samp(active) * sqrt(12.0) AS ex_post FROM active GROUP BY 1) USING (run_id) WHERE run_id <> 'policy' GROUP BY 1""")
def forecast_quality(spark, d):
    _, windows, books, series = _series(spark, d)
    cov = _covariance(spark, d).where("protocol = 'rolling'").drop("protocol")
    gap = books.where("run_id <> 'policy'").join(F.broadcast(P.universe(spark).select("instrument", "policy")), "instrument").withColumn("a", F.col("weight") - F.col("policy"))
    x, y = (gap.select("run_id", "traded", F.col("instrument").alias(k), F.col("a").alias(f"a{k}")) for k in "ij")
    before = x.join(cov, ["traded", "i"]).join(y, ["run_id", "traded", "j"]).groupBy("run_id", "traded").agg(F.sqrt(12 * F.greatest(F.sum(F.col("ai") * F.col("value") * F.col("aj")), F.lit(0.0))).alias("ex_ante"))
    after = series.groupBy("run_id").agg(M.annualised_sd("active").alias("ex_post"))
    out = before.groupBy("run_id").agg(F.avg("ex_ante").alias("ex_ante")).join(after, "run_id")
    return rounded(out.select("run_id", "ex_ante", "ex_post", (F.col("ex_ante") - F.col("ex_post")).alias("difference"), F.when(F.col("ex_ante") > 0, F.col("ex_post") / F.col("ex_ante")).alias("ratio")))


@register("SELECT s.run_id, round(max(var), 8) AS var, round(avg(-net), 8) AS shortfall, count(*) AS n_tail, round(avg(-net) - max(var), 8) AS overstatement FROM series s JOIN (SELECT run_id, quantile_cont(-net, 0.9) AS var FROM series GROUP BY 1) v ON v.run_id = s.run_id WHERE -net >= var GROUP BY 1")
def var_refusal(spark, d):
    return rounded(A.tail(_series(spark, d)[3], "run_id", 0.1))


@register("SELECT run_id, round(-avg(net), 8) AS expected_shortfall FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY net, traded) AS place, count(*) OVER (PARTITION BY run_id) AS months FROM series) WHERE place <= ceil(0.1 * months) GROUP BY 1")
def expected_shortfall(spark, d):
    return rounded(A.expected_shortfall(_series(spark, d)[3], "run_id", 0.1))


@register("SELECT t.run_id, instrument, round(-avg(weight * excess), 8) AS contribution FROM traded_returns t JOIN (SELECT run_id, traded, -sum(weight * excess) AS loss FROM traded_returns GROUP BY 1, 2) m ON m.run_id = t.run_id AND m.traded = t.traded JOIN (SELECT run_id, quantile_cont(loss, 0.9) AS var FROM (SELECT run_id, traded, -sum(weight * excess) AS loss FROM traded_returns GROUP BY 1, 2) GROUP BY 1) v ON v.run_id = t.run_id WHERE loss >= var GROUP BY 1, 2")
def tail_contributions(spark, d):
    return rounded(A.tail_contributions(_members(spark, d)[2].select("run_id", "traded", "instrument", "weight", F.col("excess").alias("ret")), "run_id", 0.1))


#: Bars the ladder is read at: none, a low one, and the one for three tests.
_BARS = (0.0, 0.01, round(K.family_wise_bar(3), 6))
_CTES |= {
    "judged": f"""SELECT a.run_id, {_RATIO.format('a.active')} AS ir, {_RATIO.format('a.active')} / (sqrt(12.0 / count(*)) * sqrt(2 * greatest(1 - coalesce(corr(a.net, a.bench), 0), 0))) AS z, max(abs(a.net - e.equal)) <= 1e-6 AS reproduces,
        {_RATIO.format('CASE WHEN month_index >= (SELECT count(DISTINCT traded) FROM active) // 2 THEN a.active END')} AS later
        FROM active a JOIN placed_active p ON p.run_id = a.run_id AND p.traded = a.traded JOIN (SELECT traded, net AS equal FROM active WHERE run_id = 'equal_weight') e ON e.traded = a.traded GROUP BY 1""",
    "kept": "SELECT run_id, avg(CASE WHEN sign(r.ir) = sign(actual) THEN 1.0 ELSE 0.0 END) AS retention, avg(CASE WHEN rank = 1 AND r.ir IS NOT NULL THEN 1.0 ELSE 0.0 END) AS first_share, run_id = (SELECT run_id FROM actual WHERE actual IS NOT NULL ORDER BY round(actual, 10) DESC, run_id LIMIT 1) AS leads FROM ranked r JOIN actual USING (run_id) GROUP BY 1",
}
_CTES["placed_active"] = "SELECT run_id, traded, active, row_number() OVER (PARTITION BY run_id ORDER BY traded) - 1 AS month_index FROM active"


@register(f"""SELECT run_id, bar, CASE WHEN run_id = 'policy' THEN 1 WHEN run_id = 'equal_weight' AND bar > 0 THEN 2 WHEN reproduces THEN 4 WHEN abs(z) < bar THEN 5 WHEN retention < 0.8 THEN 6 WHEN leads AND first_share < 0.8 THEN 7 WHEN ir <= 0 THEN 8 WHEN NOT (abs(ir) > 1e-6 AND abs(later) > 1e-6 AND sign(ir) = sign(later)) THEN 10 ELSE 11 END AS rung
    FROM (SELECT CASE WHEN bar = 0 AND run_id <> 'policy' THEN 'again_' || run_id ELSE run_id END AS run_id, run_id AS own, bar, ir, z, reproduces AND run_id <> 'equal_weight' AS reproduces, later, retention, leads, first_share FROM judged JOIN kept USING (run_id), (SELECT unnest([{', '.join(f'{b!r}::DOUBLE' for b in _BARS)}]) AS bar))""")
def verdict_ladder(spark, d):
    """The ladder over the simple books, read at several bars: the statistic against the
    benchmark, the seeded bootstrap, and whether the sign holds in the later half of the
    months. At no bar the books stand under other names, so that every rung decides."""
    rows = _series(spark, d)[3]
    months = rows.select("traded").distinct().count()
    kept = M.retention(rows, "run_id", D.resampled_months(spark, months))
    kept = kept.select("run_id", F.col("own_sign").alias("retention"), F.col("first_share").alias("leader_retention"), F.col("leads").alias("is_leader"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("traded")) - 1
    equal = rows.where("run_id = 'equal_weight'").select("traded", F.col("net").alias("equal"))
    seen = rows.withColumn("half", F.when(place >= months // 2, F.col("active"))).join(equal, "traded").groupBy("run_id").agg(
        M.ratio("active").alias("information_ratio"), F.count("*").alias("n"), F.corr("net", "bench").alias("rho"), (F.max(F.abs(F.col("net") - F.col("equal"))) <= 1e-6).alias("reproduces"), M.ratio("half").alias("later")
    )
    seen = seen.withColumn("z", M.statistic(F.col("information_ratio"), M.paired_error(F.col("n"), F.col("rho")))).withColumn("reproduces", F.col("reproduces") & (F.col("run_id") != "equal_weight"))
    seen = seen.join(kept, "run_id").withColumn("expanding_sign", V.sign_holds(F.col("information_ratio"), F.col("later"))).withColumn("is_repeat", F.lit(False))
    seen = seen.select("*", F.explode(F.array(*map(F.lit, _BARS))).alias("bar"))
    seen = seen.withColumn("run_id", F.when((F.col("bar") == 0) & (F.col("run_id") != "policy"), F.concat(F.lit("again_"), F.col("run_id"))).otherwise(F.col("run_id")))
    words = [V.IS_BENCHMARK, V.IS_EQUAL_WEIGHT, V.IS_EXPANDING, V.REPRODUCES, V.NO_DIFFERENCE, V.RESAMPLING_LOST, V.NOT_UNIQUE, V.BEHIND, V.LEG_NOT_RUN, V.SIGN_LOST, V.CANDIDATE]
    return seen.select("run_id", "bar", F.array_position(F.array(*[F.lit(w) for w in words]), V.verdict()).cast("int").alias("rung"))


@register("SELECT w.protocol, w.traded, w.instrument, round(regr_intercept(excess, ret), 8) AS alpha, round(regr_slope(excess, ret), 8) AS beta, round(regr_r2(excess, ret), 8) AS r2 FROM windows w JOIN factors f ON f.period_month = w.period_month AND factor = 'BUILDING' GROUP BY 1, 2, 3")
def one_factor_fit(spark, d):
    p, windows = _windows(spark, d)
    f = p.factors.where("factor = 'BUILDING'").select("period_month", "ret")
    rows = windows.join(F.broadcast(f), "period_month").groupBy("protocol", "traded", "instrument")
    return rounded(rows.agg(F.regr_intercept("excess", "ret").alias("alpha"), F.regr_slope("excess", "ret").alias("beta"), F.regr_r2("excess", "ret").alias("r2")))


# Kernels: rows without SQL, held to invariants and closed forms by the tests


def _named(p):
    """The spine and the block built from sleeves, long, in the order of _NAMES."""
    block = R.constructed_block(p.returns, *_BUILT_FROM)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("ret")) for n in _BLOCK])).alias("x")
    return p.factors.unionByName(block.select("period_month", pairs).select("x.factor", "period_month", "x.ret"))


_SLEEVES = [n for n, *_ in P.UNIVERSE]


def _moments(spark, d):
    """The months' vectors (one, factors, sleeves) and the sums of their products in every window."""
    p = P.load(spark, d)
    rows = once(spark, ("monthly", d), lambda: X.monthly(p.returns, _named(p), _NAMES, _SLEEVES).coalesce(1))
    return rows, once(spark, ("moments", d), lambda: X.moments(rows, p.months, 1 + len(_NAMES) + len(_SLEEVES)))


def _fit(spark, d):
    return once(spark, ("fit", d), lambda: X.rolling(_moments(spark, d)[1], _NAMES, _SLEEVES, len(_BLOCK)))


_FIT_SQL = "SELECT protocol, traded, coalesce(instrument, '') AS instrument, quantity, coalesce(factor, '') AS factor, round(value, CASE WHEN quantity IN ('beta_t', 'alpha_t', 'f', 'vif_spine', 'vif_declared', 'vif_orthogonal') THEN 5 ELSE 7 END) AS value, coalesce(determined, false) AS determined FROM fits"


@register(_FIT_SQL)
def rolling_factor_fit(spark, d):
    wide = F.col("quantity").isin("beta_t", "alpha_t", "f", "vif_spine", "vif_declared", "vif_orthogonal")
    named = {c: F.coalesce(c, F.lit("")) for c in ("instrument", "factor")} | {"determined": F.coalesce("determined", F.lit(False))}
    return _fit(spark, d).withColumns(named | {"value": F.when(wide, F.round("value", 5)).otherwise(F.round("value", 7))})


@register("SELECT protocol, instrument, factor, round(avg(move), 7) AS mean_move, round(max(move), 7) AS max_move FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY protocol, instrument, factor ORDER BY traded)) AS move FROM fits WHERE quantity = 'beta') GROUP BY 1, 2, 3")
def loading_drift(spark, d):
    return rounded(X.loading_drift(_fit(spark, d)), 7)


def _own_moments(spark, d):
    """As ``_moments``, of the sleeves alone."""
    p = P.load(spark, d)
    rows = once(spark, ("sleeves", d), lambda: X.monthly(p.returns, None, [], _SLEEVES).coalesce(1))
    return p, rows, once(spark, ("own_moments", d), lambda: X.moments(rows, p.months, 1 + len(_SLEEVES)))


def _parts(spark, d):
    """Eigenvalues and vectors of every rolling window, and the null's bars."""
    p, rows, sums = _own_moments(spark, d)
    parts = once(spark, ("parts", d), lambda: E.structure(sums, len(_SLEEVES)).coalesce(1))
    return parts, once(spark, ("null", d), lambda: E.null(rows, p.months, sums, len(_SLEEVES)))


_SIX = range(1, len(_SLEEVES) + 1)
_TURNS = [[i, j] for i in _SIX for j in _SIX if i < j]
_NTH = "list_transform(range(1, 7), lambda {0}: {1})"


def _jacobi(name: str, start: str, sweeps: int) -> dict[str, str]:
    """Relations that turn the matrices ``a`` of ``start`` (id, a) until ``name`` (id, e)
    holds their eigenvalues and vectors, largest first: cyclic Jacobi rotations by recursion."""
    one = _NTH.format("i", _NTH.format("j", "CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END"))
    rows = lambda m: _NTH.format("i", _NTH.format("j", f"CASE i WHEN p THEN c * {m}[p][j] - s * {m}[q][j] WHEN q THEN s * {m}[p][j] + c * {m}[q][j] ELSE {m}[i][j] END"))
    columns = _NTH.format("i", _NTH.format("j", "CASE j WHEN p THEN c * b[i][p] - s * b[i][q] WHEN q THEN s * b[i][p] + c * b[i][q] ELSE b[i][j] END"))
    facing = "list_transform(v[i], lambda x: x * sign(list_filter(v[i], lambda y: abs(y) >= list_max(list_transform(v[i], lambda z: abs(z))) * (1 - 1e-9))[1]))"
    return {
        f"{name}_turned": f"""SELECT id, 0 AS k, a, {one} AS v FROM {start} UNION ALL SELECT id, k + 1, {columns}, w FROM (SELECT id, k, p, q, c, s, {rows('a')} AS b, {rows('v')} AS w
            FROM (SELECT *, t * c AS s FROM (SELECT *, 1 / sqrt(t * t + 1) AS c FROM (SELECT *, CASE WHEN abs(a[p][q]) > 1e-300 THEN (CASE WHEN h >= 0 THEN 1.0 ELSE -1.0 END) / (abs(h) + sqrt(h * h + 1)) ELSE 0.0 END AS t
            FROM (SELECT *, CASE WHEN abs(a[p][q]) > 1e-300 THEN (a[q][q] - a[p][p]) / (2 * a[p][q]) ELSE 0 END AS h FROM (SELECT *, {_TURNS}[k % {len(_TURNS)} + 1][1] AS p, {_TURNS}[k % {len(_TURNS)} + 1][2] AS q FROM {name}_turned WHERE k < {sweeps * len(_TURNS)}))))))""",
        name: f"SELECT id, list_reverse_sort({_NTH.format('i', 'struct_pack(value := a[i][i], vector := ' + facing + ')')}) AS e FROM {name}_turned WHERE k = {sweeps * len(_TURNS)}",
    }


_LENGTHS = (59, 60)
for _t in _LENGTHS:
    _CTES |= D.pcg_sql(f"turns{_t}", f"{_t - 1}", f"{D.SHIFTS * len(_SLEEVES)}")
_CTES |= {
    "shifted": " UNION ALL ".join(f"SELECT {t} AS t, k // 6 AS draw, list(1 + v ORDER BY k) AS s FROM turns{t} GROUP BY 2" for t in _LENGTHS),
    "standard": """SELECT traded, t, list(z ORDER BY ord) AS z FROM (SELECT traded, ord, any_value(t) AS t, list((excess - m) / sd ORDER BY period_month) AS z
        FROM (SELECT *, count(*) OVER w AS t, avg(excess) OVER w AS m, stddev_samp(excess) OVER w * sqrt(count(*) OVER w - 1) AS sd FROM windows WHERE protocol = 'rolling' WINDOW w AS (PARTITION BY traded, ord)) GROUP BY 1, 2) GROUP BY 1, 2""",
    "begun": f"""SELECT traded || ':' || draw AS id, {_NTH.format('i', _NTH.format('j', 'list_dot_product(x[i], x[j])'))} AS a FROM (SELECT traded, draw, {_NTH.format('i', 'list_concat(z[i][t - s[i] + 1:], z[i][:t - s[i]])')} AS x FROM standard JOIN shifted USING (t))
        UNION ALL SELECT CAST(traded AS VARCHAR), {_NTH.format('i', _NTH.format('j', 'list_dot_product(z[i], z[j])'))} FROM standard""",
} | _jacobi("spun", "begun", 8) | {
    "placed_values": "SELECT CAST(split_part(id, ':', 1) AS DATE) AS traded, id LIKE '%:%' AS drawn, unnest(range(6)) AS component, unnest(e) AS p FROM spun",
    "bars": "SELECT traded, component, quantile_cont(p.value, 0.95) AS bar, quantile_cont(p.value, 0.5) AS middle FROM placed_values WHERE drawn GROUP BY 1, 2",
    "components": "SELECT *, sum((p.value > bar)::INT) OVER (PARTITION BY traded)::INTEGER AS retained FROM placed_values JOIN bars USING (traded, component) WHERE NOT drawn",
    "centred": "SELECT traded, period_month, instrument, excess - avg(excess) OVER (PARTITION BY traded, instrument) AS z FROM windows WHERE protocol = 'rolling'",
    "moved_pairs": "SELECT traded, i, j, avg(x * y) AS s, avg(x * x * y * y) AS q, count(*) AS n FROM (SELECT a.traded, a.instrument AS i, b.instrument AS j, a.z AS x, b.z AS y FROM centred a JOIN centred b ON a.traded = b.traded AND a.period_month = b.period_month) GROUP BY 1, 2, 3",
    "shrinkage": """SELECT traded, i, j, ((1 - d) * s + CASE WHEN i = j THEN d * trace / 6 ELSE 0 END) * n / (n - 1) AS value, d FROM (SELECT *, CASE WHEN spread > 0 THEN least(noise, spread) / spread ELSE 1 END AS d FROM (
        SELECT *, (squares - trace * trace / 6) / 6 AS spread, (fourth - squares) / (6 * n) AS noise FROM (SELECT *, sum(CASE WHEN i = j THEN s END) OVER w AS trace, sum(s * s) OVER w AS squares, sum(q) OVER w AS fourth FROM moved_pairs WINDOW w AS (PARTITION BY traded))))""",
    "common": "SELECT traded, greatest(any_value(retained), 1) AS k, a.ord AS i, b.ord AS j, sum(CASE WHEN component < greatest(retained, 1) THEN greatest(p.value, 0) * p.vector[a.ord + 1] * p.vector[b.ord + 1] ELSE 0 END) AS c FROM components, universe a, universe b GROUP BY traded, a.ord, b.ord",
    "estimates": """SELECT traded, 'sample' AS estimator, i, j, value, NULL::DOUBLE AS report FROM cov WHERE protocol = 'rolling' UNION ALL SELECT traded, 'shrinkage', i, j, value, d FROM shrinkage
        UNION ALL SELECT m.traded, 'factor', a.instrument, b.instrument, sqrt(x.value * y.value) * CASE WHEN m.i = m.j THEN 1 ELSE c END, k FROM common m JOIN universe a ON a.ord = m.i JOIN universe b ON b.ord = m.j
        JOIN cov x ON x.protocol = 'rolling' AND x.traded = m.traded AND x.i = a.instrument AND x.j = a.instrument JOIN cov y ON y.protocol = 'rolling' AND y.traded = m.traded AND y.i = b.instrument AND y.j = b.instrument""",
    "estimated": "SELECT estimator || ':' || traded AS id, list(r ORDER BY ord) AS a FROM (SELECT estimator, traded, u.ord, list(value ORDER BY w.ord) AS r FROM estimates JOIN universe u ON u.instrument = i JOIN universe w ON w.instrument = j GROUP BY 1, 2, 3) GROUP BY 1",
} | _jacobi("solved", "estimated", 10)


@register("SELECT traded, component::INTEGER AS component, round(p.value, 7) AS eigenvalue, round(bar, 7) AS bar, retained, round(p.value / 6, 7) AS share, round(middle / 6, 7) AS noise_share, round(pow(1 + sqrt(6.0 / t), 2), 7) AS mp_edge, list_aggregate(list_transform(list_sort(list_transform(list_zip(p.vector, (SELECT list(instrument ORDER BY ord) FROM universe)), lambda x: struct_pack(x := -abs(x[1]), n := x[2])))[:3], lambda x: x.n), 'string_agg', ', ') AS top FROM components JOIN standard USING (traded)")
def principal_components(spark, d):
    """Eigenvalues, the shifted null's bar, the retained count and the edge."""
    parts, bars = _parts(spark, d)
    return rounded(E.report(parts, bars, _SLEEVES), 7)


def _estimates(spark, d):
    """traded, estimator, cov, report of every rolling window."""
    p = P.load(spark, d)
    parts, bars = _parts(spark, d)
    return once(spark, ("estimates", d), lambda: E.estimators(parts, E.shrunk(p.returns, p.months), E.retained(parts, bars), _SLEEVES))


@register("SELECT traded, estimator, i, j, round(value, 9) AS value, round(report, 7) AS report, round(abs(e[1].value / e[6].value), 4) AS condition FROM estimates JOIN solved ON id = estimator || ':' || traded")
def covariance_estimators(spark, d):
    rows = _estimates(spark, d).withColumn("condition", F.round(E.condition(F.col("cov"), len(_SLEEVES)), 4))
    cells = rows.select("traded", "estimator", "report", "condition", F.posexplode("cov").alias("a", "row")).select("*", F.posexplode("row").alias("b", "value"))
    name = lambda c: F.get(F.lit(_SLEEVES), F.col(c))
    return cells.select("traded", "estimator", name("a").alias("i"), name("b").alias("j"), F.round("value", 9).alias("value"), F.round("report", 7).alias("report"), "condition")


#: Series of a window for the spanning tests, sums of their products, and determinants by
#: elimination: the statistic is (T - N - K) / N (det R / det U - 1), residual covariances
#: without and with intercepts, each a ratio of determinants of sums of products.
_CTES |= {
    "window_corr": "SELECT protocol || ':' || traded AS id, list(r ORDER BY ord) AS a FROM (SELECT x.protocol, x.traded, u.ord, list(x.value / sqrt(y.value * z.value) ORDER BY w.ord) AS r FROM cov x JOIN cov y ON y.protocol = x.protocol AND y.traded = x.traded AND y.i = x.i AND y.j = x.i JOIN cov z ON z.protocol = x.protocol AND z.traded = x.traded AND z.i = x.j AND z.j = x.j JOIN universe u ON u.instrument = x.i JOIN universe w ON w.instrument = x.j GROUP BY 1, 2, 3) GROUP BY protocol, traded",
} | _jacobi("window_parts", "window_corr", 10) | {
    "part_weights": "SELECT protocol, traded, part, instrument, w / sum(w) OVER (PARTITION BY protocol, traded, part) AS w FROM (SELECT protocol, traded, part, instrument, e[part].vector[ord + 1] / sqrt(value) AS w FROM (SELECT split_part(id, ':', 1) AS protocol, CAST(split_part(id, ':', 2) AS DATE) AS traded, e, unnest([1, 2]) AS part FROM window_parts) JOIN cov USING (protocol, traded) JOIN universe ON instrument = i WHERE i = j)",
    "spanned": f"""SELECT protocol, traded, period_month, 'one' AS name, 1.0 AS v FROM (SELECT DISTINCT protocol, traded, period_month FROM windows)
        UNION ALL SELECT protocol, traded, period_month, 'sleeve' || ord, excess FROM windows
        UNION ALL SELECT protocol, traded, period_month, 'made' || part, sum(w * excess) FROM windows JOIN part_weights USING (protocol, traded, instrument) GROUP BY protocol, traded, period_month, part
        UNION ALL SELECT protocol, traded, period_month, 'named' || k, [{', '.join([f's{i}' for i in range(1, 6)] + [f'b{i}' for i in range(1, 5)])}][k + 1] FROM held0, range(9) t(k)""",
    "spanned_products": "SELECT a.protocol, a.traded, a.name AS i, b.name AS j, sum(a.v * b.v) AS g, count(*) AS n FROM spanned a JOIN spanned b USING (protocol, traded, period_month) GROUP BY 1, 2, 3, 4",
    "trials": """SELECT 'spanning' AS direction, k, list_transform(range(1, k + 1), lambda i: 'made' || i) AS f, list_transform(range(6 - k), lambda i: 'sleeve' || i) AS y FROM range(1, 3) t(k)
        UNION ALL SELECT 'headline', k, list_transform(range(9), lambda i: 'named' || i), list_transform(range(1, k + 1), lambda i: 'made' || i) FROM range(1, 3) t(k) UNION ALL SELECT 'reverse', k, list_transform(range(1, k + 1), lambda i: 'made' || i), list_transform(range(9), lambda i: 'named' || i) FROM range(1, 3) t(k)""",
    "minors": "SELECT direction, k, part, names FROM trials, (SELECT unnest(['fy', '1f', 'f', '1fy']) AS part) p, LATERAL (SELECT CASE part WHEN 'fy' THEN f || y WHEN '1f' THEN ['one'] || f WHEN 'f' THEN f ELSE ['one'] || f || y END AS names)",
    "minor_rows": "SELECT direction, k, part, protocol, traded, 1 AS step, 0.0::DOUBLE AS logdet, list(r ORDER BY place) AS m FROM (SELECT direction, k, part, protocol, traded, list_position(names, i) AS place, list(g ORDER BY list_position(names, j)) AS r FROM minors JOIN spanned_products ON list_contains(names, i) AND list_contains(names, j) GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4, 5",
    "eliminated": "SELECT * FROM minor_rows UNION ALL SELECT direction, k, part, protocol, traded, step + 1, logdet + ln(m[step][step]), list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i > step THEN list_transform(range(1, len(m) + 1), lambda j: m[i][j] - m[i][step] * m[step][j] / m[step][step]) ELSE m[i] END) FROM eliminated WHERE step <= len(m)",
    "determinants": "SELECT direction, k, part, protocol, traded, logdet FROM eliminated WHERE step = len(m) + 1",
    "grs": """SELECT direction, k, protocol, traded, len(y) AS d1, n - len(y) - len(f) AS d2, (n - len(y) - len(f))::DOUBLE / len(y) * (exp(ratio) - 1) AS x FROM (SELECT direction, k, protocol, traded, sum(CASE WHEN part IN ('fy', '1f') THEN logdet ELSE -logdet END) AS ratio FROM determinants GROUP BY 1, 2, 3, 4)
        JOIN trials USING (direction, k) JOIN (SELECT protocol, traded, max(n) AS n FROM spanned_products GROUP BY 1, 2) USING (protocol, traded)""",
    "tail_start": "SELECT direction || ':' || k || ':' || protocol || ':' || traded AS id, d1, d2, x FROM grs",
}


def _tail(name: str, start: str) -> dict[str, str]:
    """P(F > x) of ``start`` (id, d1, d2, x) in ``name`` (id, p): Lentz's continued fraction by recursion."""
    tiny = lambda v: f"CASE WHEN abs({v}) < 1e-300 THEN 1e-300 ELSE {v} END"
    half = lambda num: f"SELECT * REPLACE (1 / ({tiny(f'1 + {num} * d')}) AS d, {tiny(f'1 + {num} / c')} AS c)"
    even, odd = "i * (b - i) * y / ((a + 2 * i - 1) * (a + 2 * i))", "(-(a + i) * (a + b + i) * y / ((a + 2 * i) * (a + 2 * i + 1)))"
    return {
        f"{name}_begun": f"SELECT id, CASE WHEN swap THEN d1 ELSE d2 END / 2.0 AS a, CASE WHEN swap THEN d2 ELSE d1 END / 2.0 AS b, CASE WHEN swap THEN 1 - z ELSE z END AS y, swap, lgamma((d1 + d2) / 2.0) - lgamma(d1 / 2.0) - lgamma(d2 / 2.0) AS g FROM (SELECT *, d2 / (d2 + d1 * x) AS z, d2 / (d2 + d1 * x) > (d2 / 2.0 + 1) / ((d1 + d2) / 2.0 + 2) AS swap FROM {start})",
        f"{name}_steps": f"""SELECT id, a, b, y, swap, g, 1 AS i, 1.0::DOUBLE AS c, (1 / (1 - (a + b) * y / (a + 1)))::DOUBLE AS d, (1 / (1 - (a + b) * y / (a + 1)))::DOUBLE AS o FROM {name}_begun
            UNION ALL SELECT id, a, b, y, swap, g, i + 1, c, d, o * c * d FROM (SELECT * REPLACE (1 / ({tiny(f'1 + {odd} * d')}) AS d, {tiny(f'1 + {odd} / c')} AS c) FROM (SELECT * REPLACE (o * c * d AS o) FROM ({half(even)} FROM {name}_steps WHERE i < 200)))""",
        name: f"SELECT id, CASE WHEN swap THEN 1 - v ELSE v END AS p FROM (SELECT *, exp(g + a * ln(y) + b * ln(1 - y)) / a * o AS v FROM {name}_steps WHERE i = 200)",
    }


_CTES |= _tail("tails", "tail_start")


@register("SELECT protocol, traded, k::INTEGER AS components, round(x, 6) AS statistic, round(p, 7) AS p FROM grs JOIN tails ON id = direction || ':' || k || ':' || protocol || ':' || traded WHERE direction = 'spanning'")
def grs_spanning(spark, d):
    """All sleeves but the last one or two on as many component portfolios."""
    _, _, sums = _own_moments(spark, d)
    out = None
    for protocol in ("rolling", "expanding"):
        parts = E.structure(sums, len(_SLEEVES), protocol)
        for k in (1, 2):
            part = E.spanning(sums.where(F.col("protocol") == protocol).drop("protocol"), parts.drop("n"), len(_SLEEVES), k)
            part = part.select(F.lit(protocol).alias("protocol"), "traded", F.lit(k).alias("components"), F.round("statistic", 6).alias("statistic"), F.round("p", 7).alias("p"))
            out = part if out is None else out.unionByName(part)
    return out


@register("SELECT protocol, traded, k::INTEGER AS components, direction, round(x, 6) AS statistic, round(p, 7) AS p FROM grs JOIN tails ON id = direction || ':' || k || ':' || protocol || ':' || traded WHERE direction <> 'spanning'")
def grs_directions(spark, d):
    """Component portfolios against the named set, and the other way round."""
    _, _, own = _own_moments(spark, d)
    sums = _moments(spark, d)[1]
    out = None
    for protocol in ("rolling", "expanding"):
        parts = E.structure(own, len(_SLEEVES), protocol)
        for k in (1, 2):
            part = E.directions(sums.where(F.col("protocol") == protocol).drop("protocol"), parts.drop("n"), len(_NAMES), len(_SLEEVES), k)
            part = part.select(F.lit(protocol).alias("protocol"), "traded", F.lit(k).alias("components"), "direction", F.round("statistic", 6).alias("statistic"), F.round("p", 7).alias("p"))
            out = part if out is None else out.unionByName(part)
    return out


_DECISION = "SELECT traded, retained, avg(moved::DOUBLE) OVER () AS move_share FROM (SELECT traded, retained, (abs(retained - lag(retained) OVER (ORDER BY traded)) > 1)::INT AS moved FROM components WHERE component = 0)"


@register(f"SELECT traded, retained, round(coalesce(move_share, 0), 8) AS move_share, coalesce(move_share, 0) > {E.MOVE_SHARE} AS falsified, CASE WHEN coalesce(move_share, 0) > {E.MOVE_SHARE} THEN {E.FIXED_COUNT} ELSE retained END AS used FROM ({_DECISION})")
def component_decision(spark, d):
    """The retained counts, how often they jump by more than one, and what the rule uses."""
    counts = E.retained(*_parts(spark, d)).drop("seed")
    moved = (F.abs(F.col("retained") - F.lag("retained").over(Window.orderBy("traded"))) > 1).cast("double")
    share = counts.withColumn("moved", moved).agg(F.coalesce(F.avg("moved"), F.lit(0.0)).alias("move_share"))
    out = counts.crossJoin(share).withColumn("falsified", F.col("move_share") > E.MOVE_SHARE)
    return rounded(out.withColumn("used", F.when(F.col("falsified"), E.FIXED_COUNT).otherwise(F.col("retained"))))


def _covariances(spark, d):
    """protocol, traded, cov: sample covariances of every window as matrices."""
    sums = _own_moments(spark, d)[2]
    return sums.select("protocol", "traded", L.covariance(F.col("gram"), F.col("n"), list(range(1, len(_SLEEVES) + 1))).alias("cov"))


def _grid(spark, d):
    """The panel, the runs, and their targets: each window solved once."""
    p, windows = _windows(spark, d)
    B.validate()
    runs = B.registry(spark)
    grown = _covariances(spark, d).where("protocol = 'expanding'")
    estimates = _estimates(spark, d).withColumn("protocol", F.lit("rolling")).unionByName(grown.withColumns({"estimator": F.lit("sample"), "report": F.lit(None).cast("double")}))
    return p, runs, once(spark, ("targets", d), lambda: B.targets(windows, estimates, runs))


def _path(spark, d):
    p, runs, found = _grid(spark, d)
    return p, once(spark, ("path", d), lambda: B.books(found, runs))


def _grid_series(spark, d):
    p, path = _path(spark, d)
    return p, once(spark, ("grid_series", d), lambda: B.series(path, p.returns))


@register()
def grid_targets(spark, d):
    return _grid(spark, d)[2]


@register()
def grid_cuts(spark, d):
    return B.cuts(_grid(spark, d)[2])


@register()
def grid_books(spark, d):
    return _path(spark, d)[1]


@register()
def grid_summary(spark, d):
    funded = B.establishment(_path(spark, d)[1]).select("run_id", F.col("cost").alias("establishment_cost"))
    return B.summary(_grid_series(spark, d)[1]).join(funded, "run_id")


@register()
def grid_metrics(spark, d):
    """The metric rows of all runs, active against the costless policy book."""
    rows = _grid_series(spark, d)[1]
    bench = rows.where("run_id = 'policy'").select("traded", F.col("gross").alias("net"))
    return M.block(M.active(rows, bench), "run_id")


def _views(spark, d):
    """Active weights with returns, the fit, and the traded months on its basis."""
    p, windows, books = _books(spark, d)
    rows, sums = _moments(spark, d)
    basis = once(spark, ("basis", d), lambda: X.design(sums, rows, _NAMES, len(_SLEEVES), len(_BLOCK)))
    gap = books.join(P.universe(spark).select("instrument", "policy"), "instrument").join(p.returns.select(F.col("period_month").alias("traded"), "instrument", F.col("excess").alias("ret")), ["traded", "instrument"])
    return gap.withColumn("a", F.col("weight") - F.col("policy")), _fit(spark, d), basis


@register("""SELECT run_id, traded, round(alpha, 8) AS alpha, round(active, 8) AS active, round(factors, 8) AS factors, round(active - factors - alpha, 8) AS residual FROM
    (SELECT run_id, g.traded, sum(a * coalesce(f.value, 0)) AS alpha, sum(a * excess) AS active FROM gaps g LEFT JOIN fits f ON f.protocol = 'rolling' AND f.traded = g.traded AND f.instrument = g.instrument AND f.quantity = 'alpha' GROUP BY 1, 2)
    JOIN (SELECT run_id, traded, sum(value) AS factors FROM parts GROUP BY 1, 2) USING (run_id, traded)""")
def factor_attribution(spark, d):
    return rounded(X.decomposition(*_views(spark, d)))


@register("SELECT run_id, traded, factor, round(value, 8) AS value FROM parts")
def factor_contributions(spark, d):
    return rounded(X.decomposition_by_factor(*_views(spark, d)))


@register("""SELECT run_id, round(sqrt(avg(f) * 12), 8) AS factor_tracking_error, round(sqrt(avg(r) * 12), 8) AS idio_tracking_error, round(sqrt(avg(f + r) * 12), 8) AS total_tracking_error, round(CASE WHEN avg(f + r) > 0 THEN avg(f) / avg(f + r) END, 8) AS factor_share
    FROM (SELECT run_id, traded, var_samp(x) AS f FROM (SELECT p.run_id, p.traded, h.period_month, sum(p.e * CASE p.factor WHEN 'AUTOMOBILE' THEN s1 WHEN 'BUILDING' THEN s2 WHEN 'FURNITURE' THEN s3 WHEN 'HOUSEHOLD' THEN s4 WHEN 'MACHINERY' THEN s5
        WHEN 'level' THEN b1 WHEN 'slope' THEN t2 WHEN 'credit' THEN t3 ELSE t4 END) AS x FROM parts p JOIN held h ON h.protocol = 'rolling' AND h.traded = p.traded GROUP BY 1, 2, 3) GROUP BY 1, 2)
    JOIN (SELECT run_id, g.traded, sum(a * a * value) AS r FROM gaps g JOIN fits f ON f.protocol = 'rolling' AND f.traded = g.traded AND f.instrument = g.instrument AND f.quantity = 'resid_var' GROUP BY 1, 2) USING (run_id, traded) GROUP BY 1""")
def risk_attribution(spark, d):
    return rounded(X.risk_summary(X.risk_attribution(*_views(spark, d))))


@register("SELECT run_id, 0.0::DOUBLE AS worst, 0.0::DOUBLE AS mean, round(max(abs(x)), 8) AS scale, true AS reconciles FROM (SELECT run_id, traded, sum(a * euro) AS x FROM gaps GROUP BY 1, 2) GROUP BY 1")
def cross_view(spark, d):
    """The holding view's active return against the factor view's, model and rest."""
    rows = _members(spark, d)[2].withColumnRenamed("traded", "period_month").withColumnRenamed("weight", "book")
    holding = A.allocation_lines(rows).select("run_id", F.col("period_month").alias("traded"), "active")
    view = X.decomposition(*_views(spark, d)).select("run_id", "traded", (F.col("factors") + F.col("alpha") + F.col("residual")).alias("active"))
    return rounded(A.cross_view(holding, view).drop("relative"))


_RECORDS = """SELECT run_id, traded, net FROM series UNION ALL SELECT 'flat', traded, 0.001 FROM series WHERE run_id = 'policy' UNION ALL SELECT 'short', traded, net FROM series WHERE run_id = 'equal_weight' AND traded < DATE '2000-09-01'
    UNION ALL SELECT 'gap', traded, CASE WHEN traded <> DATE '2000-05-01' THEN net END FROM series WHERE run_id = 'equal_weight'"""


@register(f"""SELECT run_id, CAST(n AS INTEGER) AS months, refused, CASE WHEN refused IS NULL THEN round(alpha, 8) END AS alpha_monthly, CASE WHEN refused IS NULL THEN round(alpha * 12, 8) END AS alpha_annualised, CASE WHEN refused IS NULL THEN round(alpha / se, 5) END AS t_alpha,
    CASE WHEN refused IS NULL THEN round(sqrt(ssr / (n - 1) * 12), 8) END AS residual_volatility_annualised, CASE WHEN refused IS NULL THEN round(r2, 8) END AS r2, CASE WHEN refused IS NULL THEN round({K.family_wise_bar(16)!r}, 8) END AS bar,
    CASE WHEN refused IS NULL THEN round({K.detection(NormalDist().inv_cdf(0.975))!r} * se, 8) END AS detectable_alpha_monthly, CASE WHEN refused IS NULL THEN abs(alpha / se) >= {K.family_wise_bar(16)!r} END AS clears
    FROM (SELECT *, sqrt(ssr / (n - 2) * (1.0 / n + mx * mx / sxx)) AS se, CASE WHEN spread < 1e-24 THEN 'the record does not vary' WHEN n < 12 THEN n || ' months can''t support 1 factors' WHEN gaps > 0 THEN 'a factor lacks a month of the record' END AS refused
    FROM (SELECT run_id, count(*) AS n, count(*) FILTER (net IS NULL) AS gaps, var_pop(net) AS spread, regr_intercept(net, ret) AS alpha, regr_syy(net, ret) * (1 - regr_r2(net, ret)) AS ssr, regr_r2(net, ret) AS r2, avg(ret) AS mx, regr_sxx(net, ret) AS sxx FROM ({_RECORDS}) s JOIN factors f ON f.period_month = s.traded AND factor = 'BUILDING' GROUP BY 1))""")
def fund_example(spark, d):
    """The simple books as records, and three that are refused: one that does not vary, one
    too short, one with a gap."""
    p, _, _, series = _series(spark, d)
    rows = series.select("run_id", "traded", "net")
    equal = rows.where("run_id = 'equal_weight'")
    rows = rows.unionByName(rows.where("run_id = 'policy'").select(F.lit("flat").alias("run_id"), "traded", F.lit(0.001).alias("net")))
    rows = rows.unionByName(equal.where("traded < '2000-09-01'").withColumn("run_id", F.lit("short")))
    rows = rows.unionByName(equal.select(F.lit("gap").alias("run_id"), "traded", F.when(F.col("traded") != F.lit("2000-05-01").cast("date"), F.col("net")).alias("net")))
    out = X.fund_example(rows, p.factors, ["BUILDING"], K.family_wise_bar(16), K.detection(NormalDist().inv_cdf(0.975)), least=12)
    return rounded(out.withColumn("t_alpha", F.round("t_alpha", 5)))


@register()
def study_rows(spark, d):
    return S.rows(_grid_series(spark, d)[1]).drop("claim")


@register()
def negative_results(spark, d):
    return V.negative_results(S.rows(_grid_series(spark, d)[1])).select("run_id", "verdict")


@register()
def grid_budgets(spark, d):
    """Every run's use of the declared budget, and the policy book's."""
    p, path = _path(spark, d)
    series = _grid_series(spark, d)[1]
    bench = series.where("run_id = 'policy'").select("traded", F.col("gross").alias("net"))
    books = path.select("run_id", "traded", "instrument", F.col("book").alias("weight")).unionByName(Y.policy_book(Y.traded_months(series), P.universe(spark)))
    return Y.risk_budgets(books, M.active(series, bench), p.returns, P.universe(spark), P.RISK_BUDGET, 0.1).budget


_MEAN = "SELECT run_id, instrument, avg(weight) AS weight FROM books GROUP BY 1, 2"
_HELD = "SELECT * FROM returns WHERE period_month IN (SELECT traded FROM steps)"
_MEAN_SHARE = f"""SELECT run_id, i AS instrument, weight * m / sum(weight * m) OVER (PARTITION BY run_id) AS share FROM (SELECT b.run_id, b.instrument AS i, max(b.weight) AS weight, sum(c.value * x.weight) AS m FROM ({_MEAN}) b
    JOIN (SELECT a.instrument AS i, b.instrument AS j, covar_samp(a.excess, b.excess) AS value FROM ({_HELD}) a JOIN ({_HELD}) b ON a.period_month = b.period_month GROUP BY 1, 2) c ON c.i = b.instrument
    JOIN ({_MEAN}) x ON x.run_id = b.run_id AND x.instrument = c.j GROUP BY 1, 2)"""


@register(f"SELECT run_id, grp, round(sum(share), 8) AS consumed, round(max(declared), 8) AS declared, round(sum(share) - max(declared), 8) AS gap, false AS undeclared FROM ({_MEAN_SHARE}) JOIN universe USING (instrument) JOIN (VALUES {', '.join(f'({g!r}, {v!r}::DOUBLE)' for g, v in P.RISK_BUDGET.items())}) t(grp, declared) USING (grp) GROUP BY 1, 2")
def mean_budgets(spark, d):
    """The budget of the simple books' mean weights under the traded months' covariance."""
    p, _, books, series = _series(spark, d)
    return rounded(Y.risk_budgets(books, series, p.returns, P.universe(spark), P.RISK_BUDGET, 0.1).budget)


@register()
def run_records(spark, d):
    """What a rerun needs of each run."""
    _, runs, found = _grid(spark, d)
    return B.records(runs, found, {"splice": P.SPLICE})


@register()
def cell_correlation(spark, d):
    return S.cell_correlation(_grid_series(spark, d)[1])


@register()
def multiple_testing_bars(spark, d):
    series = _grid_series(spark, d)[1]
    bench = series.where("run_id = 'policy'").select("traded", F.col("gross").alias("net"))
    return S.bars(M.active(series, bench))


@register(f"SELECT protocol, traded, {['intercept', *_SEGMENTS[:3]]}[i] AS factor, round(avg(x), 8) AS premium, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 5) AS t, 2 AS dof, false AS identified FROM prices_of_risk GROUP BY protocol, traded, i")
def fama_macbeth(spark, d):
    """Two passes: loadings on three factors, then six sleeves priced by four parameters."""
    out = X.two_pass(_moments(spark, d)[1], _NAMES, 3, len(_SLEEVES))
    return rounded(out.withColumn("t", F.round("t", 5)))


_CTES |= {"fit_tests": "SELECT protocol || ':' || traded || ':' || instrument AS id, k - 1 AS d1, t - k AS d2, (vary * (t - 1) - ssr) / (k - 1) / (ssr / (t - k)) AS x FROM rests WHERE kind = 'full'"} | _tail("fit_tails", "fit_tests")


@register("SELECT split_part(id, ':', 1) AS protocol, CAST(split_part(id, ':', 2) AS DATE) AS traded, split_part(id, ':', 3) AS instrument, round(x, 5) AS f, round(p, 8) AS p FROM fit_tests JOIN fit_tails USING (id)")
def regression_f_tests(spark, d):
    """Whether all slopes of a regression are nothing: F and its tail."""
    sums, k = _moments(spark, d)[1].select("protocol", "traded", "n"), len(_NAMES)
    rows = _fit(spark, d).where("quantity = 'f'").join(sums, ["protocol", "traded"])
    return rows.select("protocol", "traded", "instrument", F.round("value", 5).alias("f"), F.round(L.f_survival(F.col("value"), F.lit(k), (F.col("n") - k - 1).cast("int")), 8).alias("p"))


@register()
def varimax_loadings(spark, d):
    def kernel(x, names):
        values, vectors = K.eigen(K.correlation(x))
        turned = K.varimax(vectors[:, :3] * K.np.sqrt(values[:3]))
        for i, n in enumerate(names):
            for j in range(3):
                yield n, j, float(turned[i, j])

    return B.grouped(_windows(spark, d)[1].where("protocol = 'rolling'"), ["traded"], kernel, "traded date, instrument string, component int, loading double")


for _k in range(5):
    _CTES |= D.pcg_sql(f"again{_k}", "59", f"{D.SHIFTS * len(_SLEEVES)}", D.SEED + _k)
_CTES |= {
    "shifted_again": " UNION ALL ".join(f"SELECT {k} AS seed, k // 6 AS draw, list(1 + v ORDER BY k) AS s FROM again{k} GROUP BY 2" for k in range(5)),
    "begun_again": f"SELECT seed || ':' || draw AS id, {_NTH.format('i', _NTH.format('j', 'list_dot_product(x[i], x[j])'))} AS a FROM (SELECT seed, draw, {_NTH.format('i', 'list_concat(z[i][t - s[i] + 1:], z[i][:t - s[i]])')} AS x FROM standard, shifted_again WHERE traded = (SELECT max(traded) FROM standard))",
} | _jacobi("spun_again", "begun_again", 8) | {
    "bars_again": "SELECT seed, component, quantile_cont(p.value, 0.95) AS bar FROM (SELECT CAST(split_part(id, ':', 1) AS INTEGER) AS seed, unnest(range(6)) AS component, unnest(e) AS p FROM spun_again) GROUP BY 1, 2",
}


@register("SELECT traded, seed, sum((p.value > a.bar)::INT)::INTEGER AS retained FROM components JOIN bars_again a USING (component) WHERE traded = (SELECT max(traded) FROM standard) GROUP BY 1, 2")
def component_stability(spark, d):
    """The retained count of the last window under five seeds."""
    p, rows, sums = _own_moments(spark, d)
    last = sums.where("protocol = 'rolling'").agg(F.max("traded").alias("traded"))
    parts = _parts(spark, d)[0].join(F.broadcast(last), "traded")
    seeds = tuple(D.SEED + k for k in range(5))
    counts = E.retained(parts, E.null(rows, p.months, sums.join(F.broadcast(last), "traded"), len(_SLEEVES), seeds=seeds))
    return counts.select("traded", (F.col("seed") - D.SEED).cast("int").alias("seed"), "retained")


@register()
def fixed_alpha(spark, d):
    """Window mean less the first window's betas times the window's factor means."""
    p, windows = _windows(spark, d)
    rows = windows.where("protocol = 'rolling'")
    f = p.factors.where("factor = 'BUILDING'").select("period_month", "ret")
    fits = rows.join(F.broadcast(f), "period_month").groupBy("traded", "instrument").agg(F.avg("excess").alias("y"), F.avg("ret").alias("x"), F.regr_slope("excess", "ret").alias("beta"))
    first = fits.groupBy("instrument").agg(F.min_by("beta", "traded").alias("first_beta"))
    return rounded(fits.join(F.broadcast(first), "instrument").select("traded", "instrument", (F.col("y") - F.col("first_beta") * F.col("x")).alias("alpha")))


ORACLE_SQL["fixed_alpha"] = _sql("SELECT traded, instrument, round(y - first(beta) OVER (PARTITION BY instrument ORDER BY traded) * x, 8) AS alpha FROM (SELECT traded, instrument, avg(excess) AS y, avg(ret) AS x, regr_slope(excess, ret) AS beta FROM windows w JOIN factors f ON f.period_month = w.period_month AND factor = 'BUILDING' WHERE protocol = 'rolling' GROUP BY 1, 2)")


@register(f"SELECT run_id, instrument, round(avg(weight * m / variance), 8) AS share, round(avg(sqrt(variance)) * sqrt(12.0), 8) AS volatility FROM (SELECT *, sum(weight * m) OVER (PARTITION BY run_id, traded) AS variance FROM (SELECT b.run_id, b.traded, b.instrument, max(b.weight) AS weight, sum(c.value * x.weight) AS m FROM books b JOIN (SELECT a.instrument AS i, b.instrument AS j, covar_samp(a.excess, b.excess) AS value FROM returns a JOIN returns b ON a.period_month = b.period_month GROUP BY 1, 2) c ON c.i = b.instrument JOIN books x ON x.run_id = b.run_id AND x.traded = b.traded AND x.instrument = c.j GROUP BY 1, 2, 3)) GROUP BY 1, 2")
def path_contributions(spark, d):
    """Shares month by month at one fixed covariance, and their mean."""
    p, _, books = _books(spark, d)
    shares = A.contributions(books, A.covariance(p.returns, [], "excess"), ["run_id", "traded"])
    out = shares.groupBy("run_id", "instrument").agg(F.avg("share").alias("share"), (F.avg("volatility") * F.sqrt(F.lit(12.0))).alias("volatility"))
    return rounded(out)


@register("SELECT i AS instrument, traded, round(sum(policy * value), 10) AS covariance_with_policy FROM cov JOIN universe ON instrument = j WHERE protocol = 'rolling' GROUP BY 1, 2")
def policy_betas(spark, d):
    cov = _covariance(spark, d).where("protocol = 'rolling'").drop("protocol")
    rows = cov.join(F.broadcast(P.universe(spark).select(F.col("instrument").alias("j"), "policy")), "j")
    return rounded(rows.groupBy(F.col("i").alias("instrument"), "traded").agg(F.sum(F.col("policy") * F.col("value")).alias("covariance_with_policy")), 10)


@register("SELECT run_id, traded, round(sum(weight * sqrt(value)) / max(vol), 8) AS ratio FROM books JOIN cov c USING (traded) JOIN (SELECT b.run_id, b.traded, sqrt(sum(b.weight * c.value * x.weight)) AS vol FROM books b JOIN cov c ON c.protocol = 'rolling' AND c.traded = b.traded AND c.i = b.instrument JOIN books x ON x.run_id = b.run_id AND x.traded = b.traded AND x.instrument = c.j GROUP BY 1, 2) v USING (run_id, traded) WHERE c.protocol = 'rolling' AND c.i = c.j AND c.i = books.instrument GROUP BY 1, 2")
def diversification_ratio(spark, d):
    _, windows, books = _books(spark, d)
    cov = _covariance(spark, d).where("protocol = 'rolling'").drop("protocol")
    sd = cov.where("i = j").select("traded", F.col("i").alias("instrument"), F.sqrt("value").alias("sd"))
    rows = A.contributions(books, cov, ["run_id", "traded"]).join(sd, ["traded", "instrument"])
    return rounded(rows.groupBy("run_id", "traded").agg((F.sum(F.col("weight") * F.col("sd")) / F.max("volatility")).alias("ratio")))


@register("SELECT run_id, traded, instrument, round(CASE WHEN abs(target - held) > 0.01 THEN target ELSE held END, 8) AS aim, round(sum(abs(target - held)) OVER (PARTITION BY run_id, traded) / 2, 8) AS one_way FROM (SELECT *, weight AS target, lag(weight) OVER (PARTITION BY run_id, instrument ORDER BY traded) AS held FROM books) WHERE held IS NOT NULL")
def no_trade_band(spark, d):
    books = _books(spark, d)[2]
    held = F.lag("weight").over(Window.partitionBy("run_id", "instrument").orderBy("traded"))
    rows = books.withColumn("held", held).where("held is not null").withColumn("gap", F.abs(F.col("weight") - F.col("held")))
    one_way = F.sum("gap").over(Window.partitionBy("run_id", "traded")) / 2
    return rounded(rows.select("run_id", "traded", "instrument", F.when(F.col("gap") > B.BAND, F.col("weight")).otherwise(F.col("held")).alias("aim"), one_way.alias("one_way")))


_AIMED = f"""SELECT run_id, traded, row_number() OVER (PARTITION BY run_id ORDER BY traded) AS step, names, w, {B.CAP}::DOUBLE AS cap FROM (SELECT run_id, traded, list(instrument ORDER BY ord) AS names, list(weight ORDER BY ord) AS w FROM (
    SELECT * FROM books UNION ALL SELECT 'winner', traded, instrument, CASE WHEN row_number() OVER (PARTITION BY traded ORDER BY mean DESC, instrument) = 1 THEN {B.CAP} ELSE {(1 - B.CAP) / 5!r} END::DOUBLE
    FROM (SELECT traded, instrument, avg(excess) AS mean FROM windows WHERE protocol = 'rolling' GROUP BY 1, 2)) JOIN universe USING (instrument) GROUP BY 1, 2)"""
_GAP = "(1 - list_sum(x))"
_ROUND = f"CASE WHEN abs{_GAP} <= 1e-12 THEN x ELSE list_transform(x, lambda v: least(greatest(v + {_GAP} * CASE WHEN {_GAP} > 0 THEN (cap - v) / (cap * len(x) - list_sum(x)) ELSE v / list_sum(x) END, 0), cap)) END"
_MOVED = "list_sum(list_transform(list_zip({0}, {1}), lambda p: abs(p[1] - p[2]))) / 2"


def _walk(name: str, start: str) -> dict[str, str]:
    """Books by recursion over a run's months (run_id, traded, step, names, w, cap): band,
    projection, cap on the turnover."""
    return {
        name: f"""SELECT run_id, traded, step, names, w, cap, w AS book, 0.0::DOUBLE AS turnover, NULL::DOUBLE AS movement, false AS turnover_binding, 0.0::DOUBLE AS untaken, 0.0::DOUBLE AS funding FROM {start} WHERE step = 1
        UNION ALL SELECT run_id, traded, step, names, w, cap, CASE WHEN wanted > {B.TURNOVER_CAP} THEN list_transform(list_zip(aim, held), lambda p: p[2] + (p[1] - p[2]) * {B.TURNOVER_CAP} / wanted) ELSE aim END,
        least(wanted, {B.TURNOVER_CAP}), least(wanted, {B.TURNOVER_CAP}), wanted > {B.TURNOVER_CAP}, wanted - least(wanted, {B.TURNOVER_CAP}), funding
        FROM (SELECT *, {_MOVED.format('aim', 'held')} AS wanted, 2 * {_MOVED.format('aim', 'banded')} AS funding
        FROM (SELECT *, list_reduce(list_transform(range(len(banded) + 2), lambda i: list_transform(banded, lambda v: least(greatest(v, 0), cap))), lambda x, y: {_ROUND}) AS aim
        FROM (SELECT a.*, b.book AS held, list_transform(list_zip(a.w, b.book), lambda p: CASE WHEN abs(p[1] - p[2]) > {B.BAND} THEN p[1] ELSE p[2] END) AS banded FROM {name} b JOIN {start} a ON a.run_id = b.run_id AND a.step = b.step + 1)))"""
    }


_CTES |= {"aimed": _AIMED} | _walk("walked", "aimed")


def _aimed(spark, d):
    """Targets without an optimiser: the simple books, and one that bets on the best mean."""
    _, windows, books = _books(spark, d)
    mean = windows.where("protocol = 'rolling'").groupBy("traded", "instrument").agg(F.avg("excess").alias("mean"))
    best = F.row_number().over(Window.partitionBy("traded").orderBy(F.desc("mean"), "instrument")) == 1
    winner = mean.select(F.lit("winner").alias("run_id"), "traded", "instrument", F.when(best, B.CAP).otherwise((1 - B.CAP) / 5).alias("weight"))
    rows = books.unionByName(winner).join(F.broadcast(P.universe(spark).select("instrument", "ord")), "instrument")
    return rows.select("run_id", "traded", "instrument", "ord", F.col("weight").alias("target"), F.lit(B.CAP).alias("cap"))


@register(f"SELECT run_id, traded, unnest(names) AS instrument, round(unnest(w), 8) AS target, round(unnest(book), 8) AS book, {_round('turnover, movement, untaken, funding')}, turnover_binding FROM walked")
def rebalanced_books(spark, d):
    """The traded path of given targets: no-trade band, constraint set, turnover cap."""
    return rounded(B.fold(_aimed(spark, d)).drop("ord", "cap"))


@register("SELECT protocol, traded, window_start, window_end, CAST(months AS INTEGER) AS months, observations::INTEGER AS observations, CASE WHEN protocol = 'rolling' THEN retained END AS components FROM steps JOIN (SELECT protocol, traded, count(DISTINCT period_month) AS observations FROM windows GROUP BY 1, 2) USING (protocol, traded) LEFT JOIN (SELECT traded, retained FROM components WHERE component = 0) USING (traded)")
def walk_forward_record(spark, d):
    """The step records completed: months held by each window, components kept by its estimate."""
    p, windows = _windows(spark, d)
    kept = E.retained(*_parts(spark, d)).select(F.lit("rolling").alias("protocol"), "traded", "retained")
    out = C.observed(B.all_steps(p.months), windows, kept)
    return out.select("protocol", "traded", "window_start", "window_end", "months", "observations", "components")


@register()
def cap_pairs(spark, d):
    """Each capped run beside the run without its cap."""
    return S.cap_pairs(_grid_series(spark, d)[1])


@register()
def study_provenance(spark, d):
    return S.provenance(S.rows(_grid_series(spark, d)[1]), d.rstrip("/").rsplit("/", 1)[-1])


def _gauss(name: str, start: str, n: str) -> dict[str, str]:
    """Relations that reduce the augmented matrices ``m`` of ``start`` (id, m) on their
    first ``n`` columns: ``name`` (id, m)."""
    return {
        f"{name}_steps": f"""SELECT id, m, 1 AS k FROM {start} UNION ALL SELECT id, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
            ELSE list_transform(range(1, len(m[k]) + 1), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END), k + 1 FROM {name}_steps WHERE k <= {n}""",
        name: f"SELECT id, m FROM {name}_steps WHERE k = {n} + 1",
    }


#: Runs whose targets are quadratic programmes: run, estimator, mean, cap, protocol.
_QUADRATIC = [(r[0], r[3], r[4] or "zero", r[5], r[6]) for r in B.RUNS if r[2] in ("minimum_variance", "mean_variance") and r[4] != "none"]
_SIXES = "SELECT protocol, traded, estimator, list(r ORDER BY ord) AS q FROM (SELECT protocol, traded, estimator, u.ord, list(value ORDER BY w.ord) AS r FROM ({0}) JOIN universe u ON u.instrument = i JOIN universe w ON w.instrument = j GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"
#: The optimum by trying every set of sleeves at zero, free and at the cap: the one whose
#: solution of the normal equations is feasible with multipliers of the right sign.
_CTES |= {
    "quadratic_runs": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE, '{e}')" for a, b, c, d, e in _QUADRATIC) + ") t(run_id, estimator, mean, cap, protocol)",
    "sixes": _SIXES.format("SELECT 'rolling' AS protocol, * FROM estimates UNION ALL SELECT protocol, traded, 'sample', i, j, value, NULL FROM cov WHERE protocol = 'expanding'"),
    "window_means": "SELECT protocol, traded, list(mu ORDER BY ord) AS mu, list(policy ORDER BY ord) AS policy, any_value(t) AS t FROM (SELECT protocol, traded, ord, avg(excess) AS mu, any_value(policy) AS policy, count(*) AS t FROM windows GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "prior_start": f"""SELECT 'stein:' || protocol || ':' || traded AS id, {_NTH.format('i', 'q[i] || [1.0::DOUBLE, mu[i]]')} AS m FROM sixes JOIN window_means USING (protocol, traded) WHERE estimator = 'sample'
        UNION ALL SELECT 'views:' || protocol || ':' || traded, {_NTH.format('i', _NTH.format('j', 'q[i][j] * CASE WHEN i = j THEN 2 ELSE 1 END') + f' || [mu[i] - {B.GAMMA!r} * list_dot_product(q[i], policy)]')} FROM sixes JOIN window_means USING (protocol, traded) WHERE estimator = 'sample'""",
} | _gauss("priors", "prior_start", "6") | {
    "stein": f"""SELECT protocol, traded, {_NTH.format('i', '(1 - share) * mu[i] + share * base')} AS c FROM (SELECT *, 8 / (8 + t * q) AS share FROM (SELECT *, list_dot_product(d, {_NTH.format('i', 'm[i][8] - base * m[i][7]')}) AS q FROM (SELECT *, list_transform(mu, lambda v: v - base) AS d
        FROM (SELECT protocol, traded, mu, t, m, list_dot_product(list_transform(m, lambda r: r[7]), mu) / list_sum(list_transform(m, lambda r: r[7])) AS base FROM priors JOIN window_means ON id = 'stein:' || protocol || ':' || traded))))""",
    "views": f"SELECT protocol, traded, {_NTH.format('i', f'{B.GAMMA!r} * list_dot_product(q[i], policy) + list_dot_product(q[i], list_transform(m, lambda r: r[7]))')} AS c FROM priors JOIN window_means ON id = 'views:' || protocol || ':' || traded JOIN sixes USING (protocol, traded) WHERE estimator = 'sample'",
    "programmes": f"""SELECT run_id, traded, cap, CASE WHEN mean = 'zero' THEN q ELSE list_transform(q, lambda r: list_transform(r, lambda v: {B.GAMMA!r} * v)) END AS q, CASE mean WHEN 'zero' THEN [0.0::DOUBLE, 0, 0, 0, 0, 0] WHEN 'sample' THEN mu WHEN 'jorion' THEN s.c ELSE v.c END AS c
        FROM quadratic_runs JOIN sixes USING (protocol, estimator) JOIN window_means USING (protocol, traded) JOIN stein s USING (protocol, traded) JOIN views v USING (protocol, traded)
        UNION ALL SELECT 'diverse', traded, 1.0, {_NTH.format('i', _NTH.format('j', 'q[i][j] / sqrt(q[i][i] * q[j][j])'))}, [0.0::DOUBLE, 0, 0, 0, 0, 0] FROM sixes WHERE protocol = 'rolling' AND estimator = 'sample'""",
    "settings": f"SELECT list_transform(range(6), lambda i: (n // CAST(pow(3, i) AS INT)) % 3) AS s FROM range(729) t(n)",
    "kkt_start": f"""SELECT run_id || ':' || traded || ':' || array_to_string(s, '') AS id, {_NTH.format('i', "CASE s[i] WHEN 1 THEN q[i] || [1.0::DOUBLE, c[i]] ELSE " + _NTH.format('j', 'CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END') + " || [0.0::DOUBLE, CASE s[i] WHEN 2 THEN cap ELSE 0 END] END")} || [[1.0::DOUBLE, 1, 1, 1, 1, 1, 0, 1]] AS m
        FROM programmes, settings WHERE list_contains(s, 1) AND len(list_filter(s, lambda x: x = 2)) * cap <= 1 AND len(list_filter(s, lambda x: x > 0)) * cap >= 1""",
} | _gauss("kkt", "kkt_start", "7") | {
    "solutions": "SELECT split_part(id, ':', 1) AS run_id, CAST(split_part(id, ':', 2) AS DATE) AS traded, split_part(id, ':', 3) AS s, list_transform(m[:6], lambda r: r[8]) AS w, m[7][8] AS level FROM kkt",
    "optima": f"""SELECT run_id, traded, arg_min(w, worst) AS w FROM (SELECT run_id, traded, w, list_max({_NTH.format('i', "CASE s[i] WHEN '1' THEN greatest(-w[i], w[i] - cap) WHEN '0' THEN -(list_dot_product(q[i], w) - c[i] + level) / scale ELSE (list_dot_product(q[i], w) - c[i] + level) / scale END")}) AS worst
        FROM (SELECT x.*, cap, q, c, list_max(list_transform(q, lambda r: list_max(r))) AS scale FROM solutions x JOIN programmes USING (run_id, traded))) GROUP BY 1, 2""",
}


@register("SELECT run_id, traded, instrument, round(w[ord + 1], 5) AS target FROM optima, universe WHERE run_id <> 'diverse'")
def quadratic_targets(spark, d):
    """The grid's targets that are quadratic programmes: least variance under three
    covariances, and mean-variance with sample, shrunk and Black-Litterman means."""
    rows = _grid(spark, d)[2].where(F.col("run_id").isin(*[r[0] for r in _QUADRATIC]) & F.col("error").isNull())
    return rows.select("run_id", "traded", "instrument", F.round("target", 5).alias("target"))


#: Runs by risk: equal contributions, most diversified, hierarchical: run, family, estimator, cap.
_BY_RISK = [(r[0], r[2], r[3], r[5]) for r in B.RUNS if r[2] in ("erc", "maximum_diversification", "hierarchical_risk_parity")]
_VARIANCE = "(list_sum(list_transform({0}, lambda i: list_sum(list_transform({0}, lambda j: q[i][j] / (q[i][i] * q[j][j]))))) / pow(list_sum(list_transform({0}, lambda i: 1 / q[i][i])), 2))"
_LEFT = lambda a, b: f"({_VARIANCE.format(b)} / ({_VARIANCE.format(a)} + {_VARIANCE.format(b)}))"
_OF = lambda x: f"list_filter(st, lambda y: list_contains(y[2:], e[1][{x}]))[1]"
_CTES |= {
    "risk_runs": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in _BY_RISK) + ") t(run_id, family, estimator, cap)",
    # equal contributions: the root of each coordinate's quadratic in turn
    "rooted": f"""SELECT traded, estimator, q, 0 AS k, {_NTH.format('i', '1 / sqrt(q[i][i])')} AS y FROM sixes WHERE protocol = 'rolling'
        UNION ALL SELECT traded, estimator, q, k + 1, {_NTH.format('j', 'CASE WHEN j = i THEN (-a + sqrt(a * a + 4 * q[i][i] / 6)) / (2 * q[i][i]) ELSE y[j] END')} FROM (SELECT *, list_dot_product(q[i], y) - q[i][i] * y[i] AS a FROM (SELECT *, k % 6 + 1 AS i FROM rooted WHERE k < 900))""",
    "equal_parts": "SELECT traded, estimator, list_transform(y, lambda v: v / list_sum(y)) AS w FROM rooted WHERE k = 900",
    # leaves of the single-linkage tree: edges from the nearest on join two clusters, the older first
    "near_edges": """SELECT traded, any_value(q) AS q, list([[a, b]] ORDER BY d, a, b) AS edges FROM (SELECT traded, q, a, b, sqrt(greatest(0.5 * (1 - least(greatest(q[a][b] / sqrt(q[a][a] * q[b][b]), -1), 1)), 0)) AS d FROM sixes, range(1, 7) x(a), range(1, 7) y(b) WHERE a < b AND protocol = 'rolling' AND estimator = 'sample') GROUP BY 1""",
    "leaves": f"""SELECT traded, q, list_reduce([{_NTH.format('i', '[i, i]')}] || edges, lambda st, e: CASE WHEN {_OF(1)} = {_OF(2)} THEN st ELSE list_filter(st, lambda y: NOT list_contains(y[2:], e[1][1]) AND NOT list_contains(y[2:], e[1][2]))
        || [[list_max(list_transform(st, lambda y: y[1])) + 1] || CASE WHEN {_OF(1)}[1] < {_OF(2)}[1] THEN {_OF(1)}[2:] || {_OF(2)}[2:] ELSE {_OF(2)}[2:] || {_OF(1)}[2:] END] END)[1][2:] AS o FROM near_edges""",
    "halved": f"SELECT traded, o, {_LEFT('o[1:3]', 'o[4:6]')} AS h, {_LEFT('o[1:1]', 'o[2:3]')} AS l, {_LEFT('o[2:2]', 'o[3:3]')} AS ll, {_LEFT('o[4:4]', 'o[5:6]')} AS r, {_LEFT('o[5:5]', 'o[6:6]')} AS rr FROM leaves",
    "parity": f"SELECT traded, {_NTH.format('i', 'p[list_position(o, i)]')} AS w FROM (SELECT traded, o, [h * l, h * (1 - l) * ll, h * (1 - l) * (1 - ll), (1 - h) * r, (1 - h) * (1 - r) * rr, (1 - h) * (1 - r) * (1 - rr)] AS p FROM halved)",
    "raw_risk": f"""SELECT run_id, traded, cap, w FROM risk_runs JOIN equal_parts USING (estimator) WHERE family = 'erc' UNION ALL SELECT run_id, traded, cap, w FROM risk_runs, parity WHERE family = 'hierarchical_risk_parity'
        UNION ALL SELECT r.run_id, traded, r.cap, list_transform(v, lambda x: x / list_sum(v)) FROM risk_runs r, (SELECT traded, {_NTH.format('i', 'w[i] / sqrt(q[i][i])')} AS v FROM optima JOIN sixes USING (traded) WHERE run_id = 'diverse' AND protocol = 'rolling' AND estimator = 'sample') WHERE family = 'maximum_diversification'""",
    "risk_targets": f"SELECT run_id, traded, cap, list_reduce(list_transform(range(8), lambda i: list_transform(w, lambda v: least(greatest(v, 0), cap))), lambda x, y: {_ROUND}) AS w FROM raw_risk",
}


@register("SELECT run_id, traded, instrument, round(w[ord + 1], 5) AS target FROM risk_targets, universe")
def risk_based_targets(spark, d):
    """The grid's targets by risk: equal contributions, most diversified, hierarchical."""
    rows = _grid(spark, d)[2].where(F.col("run_id").isin(*[r[0] for r in _BY_RISK]) & F.col("error").isNull())
    return rows.select("run_id", "traded", "instrument", F.round("target", 5).alias("target"))


#: Runs of the grid whose books another engine can work out: all but mean-CVaR's.
_SOLVED = [r[0] for r in _QUADRATIC + _BY_RISK] + ["equal_weight", "policy", "mean_variance_none"]
_CTES |= {
    "solved_aims": f"""SELECT run_id, traded, row_number() OVER (PARTITION BY run_id ORDER BY traded) AS step, (SELECT list(instrument ORDER BY ord) FROM universe) AS names, w, cap FROM (SELECT run_id, traded, w, cap FROM optima JOIN quadratic_runs USING (run_id) UNION ALL SELECT run_id, traded, w, cap FROM risk_targets
        UNION ALL SELECT run_id, traded, CASE run_id WHEN 'policy' THEN (SELECT list(policy ORDER BY ord) FROM universe) ELSE [1 / 6::DOUBLE, 1 / 6, 1 / 6, 1 / 6, 1 / 6, 1 / 6] END, {B.CAP} FROM (SELECT DISTINCT traded FROM steps), (SELECT unnest(['equal_weight', 'policy', 'mean_variance_none']) AS run_id))""",
} | _walk("solved_path", "solved_aims") | {
    "solved_series": """SELECT p.run_id, p.traded, gross, turnover, gross - 2 * turnover * 10.0 / 1e4 AS net, movement, turnover_binding, len(list_filter(book, lambda v: v > cap - 1e-9)) AS at_cap, 1 / list_sum(list_transform(w, lambda v: v * v)) AS concentration, list_max(w) AS largest
        FROM solved_path p JOIN (SELECT run_id, traded, sum(b * excess) AS gross FROM (SELECT run_id, traded, unnest(names) AS instrument, unnest(book) AS b FROM solved_path) x JOIN returns r ON r.period_month = traded AND r.instrument = x.instrument GROUP BY 1, 2) g USING (run_id, traded)""",
    "solved_active": "SELECT s.*, b.gross AS bench, s.net - b.gross AS active FROM solved_series s JOIN (SELECT traded, gross FROM solved_series WHERE run_id = 'policy') b USING (traded)",
}


@register("SELECT run_id, traded, unnest(names) AS instrument, round(unnest(book), 5) AS book, round(turnover, 5) AS turnover, round(untaken, 5) AS untaken, turnover_binding FROM solved_path")
def solved_books(spark, d):
    """The grid's traded books of nineteen runs, from targets to the fold."""
    rows = _path(spark, d)[1].where(F.col("run_id").isin(*_SOLVED))
    return rounded(rows.select("run_id", "traded", "instrument", "book", "turnover", "untaken", "turnover_binding"), 5)


@register(f"SELECT run_id, n, round(information_ratio, 4) AS information_ratio, round(volatility, 5) AS volatility, round(tracking_error, 5) AS tracking_error, round(cumulative, 5) AS cumulative, round(drawdown, 5) AS drawdown FROM (SELECT run_id, count(*) AS n, {_RATIO.format('active')} AS information_ratio, stddev_samp(net) * sqrt(12.0) AS volatility, stddev_samp(active) * sqrt(12.0) AS tracking_error, product(1 + net) - 1 AS cumulative FROM solved_active GROUP BY 1) JOIN (SELECT run_id, min(curve / peak - 1) AS drawdown FROM (SELECT run_id, traded, curve, max(curve) OVER (PARTITION BY run_id ORDER BY traded) AS peak FROM (SELECT run_id, traded, product(1 + net) OVER (PARTITION BY run_id ORDER BY traded) AS curve FROM solved_active)) GROUP BY 1) USING (run_id)")
def solved_metrics(spark, d):
    """The metric rows of the same runs."""
    rows = _grid_series(spark, d)[1].where(F.col("run_id").isin(*_SOLVED))
    bench = rows.where("run_id = 'policy'").select("traded", F.col("gross").alias("net"))
    out = M.block(M.active(rows, bench), "run_id")
    return rounded(out.withColumn("information_ratio", F.round("information_ratio", 4)), 5)


@register("SELECT run_id, count(*) AS steps, round(avg(turnover) * 12, 5) AS turnover_annualised, round(2 * avg(turnover) * 10.0 / 1e4 * 12, 6) AS cost_annualised, count(*) FILTER (at_cap > 0) AS cap_binding_steps, count(*) FILTER (turnover_binding) AS turnover_cap_binding_steps, round(avg(concentration), 4) AS concentration, round(max(largest), 5) AS largest_weight, round(coalesce(avg(movement), 0), 5) AS weight_stability, round(product(1 + gross) - 1, 5) AS gross_cumulative FROM solved_series GROUP BY 1")
def solved_summary(spark, d):
    """What the paths of the same runs did."""
    out = B.summary(_grid_series(spark, d)[1].where(F.col("run_id").isin(*_SOLVED)))
    five = ("turnover_annualised", "largest_weight", "weight_stability", "gross_cumulative")
    return out.select("run_id", "steps", "cap_binding_steps", "turnover_cap_binding_steps", F.round("cost_annualised", 6).alias("cost_annualised"), F.round("concentration", 4).alias("concentration"), *[F.round(c, 5).alias(c) for c in five])


_FEW = "SELECT * FROM solved_active WHERE run_id IN (" + ", ".join(f"'{c}'" for c in B.CELLS) + ")"
_ERROR = "sqrt(12.0 / count(*)) * sqrt(2 * greatest(1 - coalesce(corr({0}, {1}), 0), 0))"
_STATISTIC = "CASE WHEN {1} > 1e-6 THEN {0} / {1} WHEN abs({0}) <= 1e-6 THEN 0 ELSE sign({0}) * 'inf'::DOUBLE END"
_CTES |= {"few": _FEW} | D.pcg_sql("few_picks", "(SELECT count(DISTINCT traded) FROM solved_active)", f"(SELECT {D.RESAMPLES} * count(DISTINCT traded) FROM solved_active)") | {
    "few_drawn": f"SELECT k // (SELECT count(DISTINCT traded) FROM few) AS draw, run_id, {_BARE.format('active')} AS ir FROM few_picks JOIN (SELECT run_id, active, row_number() OVER (PARTITION BY run_id ORDER BY traded) - 1 AS month_index FROM few) m ON month_index = v GROUP BY 1, 2",
    "few_actual": f"SELECT run_id, {_BARE.format('active')} AS actual FROM few GROUP BY 1",
    "few_kept": """SELECT *, first_value(run_id) OVER (ORDER BY round(actual, 10) DESC NULLS LAST, run_id) AS leader, first_value(share) OVER (ORDER BY round(actual, 10) DESC NULLS LAST, run_id) AS leader_retention FROM (SELECT run_id, any_value(actual) AS actual, avg(CASE WHEN sign(ir) = sign(actual) THEN 1.0 ELSE 0.0 END) AS retention,
        quantile_cont(rank, 0.5) AS median_rank, avg(CASE WHEN rank = 1 AND ir IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY round(ir, 10) DESC NULLS LAST, run_id) AS rank FROM few_drawn) JOIN few_actual USING (run_id) GROUP BY 1)""",
    "few_bars": f"SELECT {[K.family_wise_bar(k) for k in range(1, 17)]}[n] AS bar, greatest(1.0, 1 + (n - 1) * (1 - (s / n - 1) / n)) AS effective FROM (SELECT count(DISTINCT i) AS n, sum(r * r) AS s FROM (SELECT a.run_id AS i, b.run_id AS j, corr(a.net, b.net) AS r FROM few a JOIN few b ON a.traded = b.traded GROUP BY 1, 2))",
    "few_tests": f"""SELECT run_id, months, ir, te, se, {_STATISTIC.format('ir', 'se')} AS z, ends_with(run_id, '_expanding') AS is_repeat FROM (SELECT run_id, count(*) AS months, {_RATIO.format('active')} AS ir, stddev_samp(active) * sqrt(12.0) AS te, {_ERROR.format('net', 'bench')} AS se FROM solved_active GROUP BY 1)""",
    "few_equal": f"SELECT run_id, same, {_STATISTIC.format('d', 'se')} AS z_equal, d FROM (SELECT a.run_id, max(abs(a.net - e.net)) <= 1e-6 AS same, {_RATIO.format('a.active')} - {_RATIO.format('e.active')} AS d, {_ERROR.format('a.net', 'e.net')} AS se FROM solved_active a JOIN solved_active e ON e.traded = a.traded AND e.run_id = 'equal_weight' GROUP BY 1)",
    "few_rows": """SELECT t.*, q.same, CASE WHEN t.run_id <> 'equal_weight' THEN z_equal END AS z_equal, CASE WHEN t.run_id <> 'equal_weight' THEN d END AS d, retention, median_rank, k.leader, k.leader_retention, bar, effective,
        CASE WHEN NOT t.is_repeat AND x.ir IS NOT NULL THEN abs(t.ir) > 1e-6 AND abs(x.ir) > 1e-6 AND sign(t.ir) = sign(x.ir) END AS expanding_sign
        FROM few_tests t JOIN few_equal q USING (run_id) LEFT JOIN few_kept k USING (run_id) LEFT JOIN (SELECT run_id, ir FROM few_tests WHERE is_repeat) x ON x.run_id = t.run_id || '_expanding' CROSS JOIN few_bars""",
}


@register(f"""SELECT run_id, months, round(ir, 4) AS information_ratio, round(te, 5) AS tracking_error, round(z, 3) AS z, round(d, 4) AS difference_equal, round(z_equal, 3) AS z_equal, round(retention, 3) AS retention, median_rank, leader, round(leader_retention, 3) AS leader_retention, round(bar, 6) AS bar, round(effective, 4) AS effective, round((bar + {K.POWER_QUANTILE!r}) * se, 4) AS resolution, expanding_sign,
    CASE WHEN run_id = 'policy' THEN 1 WHEN run_id = 'equal_weight' THEN 2 WHEN is_repeat THEN 3 WHEN same THEN 4 WHEN NOT abs(z) >= bar THEN 5 WHEN retention < 0.8 THEN 6 WHEN leader = run_id AND leader_retention < 0.8 THEN 7 WHEN ir <= 0 THEN 8 WHEN expanding_sign IS NULL THEN 9 WHEN NOT expanding_sign THEN 10 ELSE 11 END AS rung FROM few_rows""")
def solved_study(spark, d):
    """The comparison's rows of nineteen runs: paired tests, the seeded bootstrap over the
    cells, the bars, and the ladder."""
    rows = S.rows(_grid_series(spark, d)[1].where(F.col("run_id").isin(*_SOLVED)))
    words = [V.IS_BENCHMARK, V.IS_EQUAL_WEIGHT, V.IS_EXPANDING, V.REPRODUCES, V.NO_DIFFERENCE, V.RESAMPLING_LOST, V.NOT_UNIQUE, V.BEHIND, V.LEG_NOT_RUN, V.SIGN_LOST, V.CANDIDATE]
    digits = {"information_ratio": 4, "tracking_error": 5, "z": 3, "difference_equal": 4, "z_equal": 3, "retention": 3, "leader_retention": 3, "bar": 6, "effective": 4, "resolution": 4}
    rung = F.array_position(F.array(*[F.lit(w) for w in words]), F.col("verdict")).cast("int").alias("rung")
    return rows.select("run_id", "months", *[F.round(c, n).alias(c) for c, n in digits.items()], "median_rank", "leader", "expanding_sign", rung)
