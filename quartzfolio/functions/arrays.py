"""Small dense algebra as column expressions: vectors are arrays of doubles, matrices
arrays of rows. Nothing leaves the JVM, so a row's matrix is worked out where it lies.

Loops are ordered folds over arrays; sizes are given as numbers, since they are known
when a plan is made (sleeves, factors). Cells are named by places in arrays, so an
expression's size does not grow with its matrix. A value that an expression uses more
than once goes through ``let``, or it would be worked out at each use.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATRIX, VECTOR = "array<array<double>>", "array<double>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def times(m: Column, v: Column) -> Column:
    """Matrix times vector."""
    return F.transform(m, lambda row: dot(row, v))


def numbers(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})") if values else F.expr("cast(array() as array<int>)")


def cell(m: Column, i: Column, j: Column) -> Column:
    return F.get(F.get(m, i), j)


def identity(n: int) -> Column:
    every = f"sequence(0, {n - 1})"
    return F.expr(f"transform({every}, i -> transform({every}, j -> if(i = j, 1D, 0D)))")


def part(m: Column, rows: list[int], columns: list[int]) -> Column:
    """The matrix of some rows and columns, in the order given."""
    return F.transform(numbers(rows), lambda i: let(F.get(m, i), lambda row: F.transform(numbers(columns), lambda j: F.get(row, j))))


def transposed(m: Column, n: int) -> Column:
    """The ``n`` columns as rows."""
    return F.transform(numbers(list(range(n))), lambda j: F.transform(m, lambda row: F.get(row, j)))


def beside(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.concat(x, y))


def reduced(m: Column, n: int) -> Column:
    """Gauss-Jordan elimination of the first ``n`` columns: [A | B] becomes [I | B / A].
    A pivot that is nothing gives nulls."""

    def step(acc: Column, k: Column) -> Column:
        pivot = let(F.get(acc, k), lambda row: let(F.get(row, k), lambda p: F.transform(row, lambda v: v / F.when(F.abs(p) > 0, p))))
        clear = lambda row: F.transform(acc, lambda r, i: F.when(i == k, row).otherwise(let(F.get(r, k), lambda f: F.zip_with(r, row, lambda x, y: x - f * y))))
        return let(pivot, clear)

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), m.cast(MATRIX), step)


def inverse(m: Column, n: int) -> Column:
    return F.transform(reduced(beside(m, identity(n)), n), lambda row: F.slice(row, n + 1, n))


def solve(m: Column, v: Column, n: int) -> Column:
    """x with m x = v."""
    return F.transform(reduced(F.zip_with(m, v, lambda row, y: F.concat(row, F.array(y))), n), lambda row: F.element_at(row, n + 1))


def orthogonaliser(m: Column, n: int) -> Column:
    """Unit lower-triangular L with L m L' diagonal, m a positive Gram matrix: forward
    elimination of [m | I]. Rows of L turn a block so that each net of those before it."""

    def step(acc: Column, k: Column) -> Column:
        def below(row: Column) -> Column:
            factor = lambda r: F.get(r, k) / F.when(F.abs(F.get(row, k)) > 0, F.get(row, k))
            return F.transform(acc, lambda r, i: F.when(i <= k, r).otherwise(let(factor(r), lambda f: F.zip_with(r, row, lambda x, y: x - f * y))))

        return let(F.get(acc, k), below)

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), beside(m, identity(n)).cast(MATRIX), step), lambda row: F.slice(row, n + 1, n))


def sandwich(w: Column, m: Column) -> Column:
    """w m w' for a symmetric m."""
    return let(w, lambda v: F.transform(F.transform(v, lambda row: times(m, row)), lambda a: F.transform(v, lambda row: dot(a, row))))


def covariance(gram: Column, n: Column, columns: list[int], ddof: int = 1) -> Column:
    """Covariances of some columns from the sums of products of all, column 0 being ones."""
    at = numbers(columns)
    sums = F.get(gram, F.lit(0))
    centred = lambda row, i: F.transform(at, lambda j: (F.get(row, j) - F.get(sums, i) * F.get(sums, j) / n) / (n - ddof))
    return F.transform(at, lambda i: let(F.get(gram, i), lambda row: centred(row, i)))


def variance_inflation(covariance: Column, n: int) -> Column:
    """The largest variance inflation among the series of a covariance."""
    if n < 2:
        return F.lit(1.0)
    return let(inverse(covariance, n), lambda v: F.array_max(F.transform(v, lambda row, i: F.get(row, i) * cell(covariance, i, i))))


def regression(gram: Column, n: Column, design: list[int], y: Column) -> Column:
    """Least squares of column ``y`` on the columns in ``design``, the first of them the
    ones: struct of beta, t (by coefficient), resid_var and var (ddof 1), dof, f (of all
    slopes at once). Raises on too few rows or dependent columns."""
    k = len(design)
    bad = F.raise_error(F.lit("a regression has too few rows or dependent factors")).cast(MATRIX)
    tight = lambda v: F.exists(F.transform(v, lambda row, i: F.get(row, i) * cell(gram, F.get(numbers(design), i), F.get(numbers(design), i))), lambda x: F.coalesce(x > 1e13, F.lit(True)))

    def fitted(z: Column) -> Column:
        dof = n - k
        ssr = F.greatest(z["yy"] - dot(z["beta"], z["xy"]), F.lit(0.0))
        done = F.struct(ssr.alias("ssr"), ((z["yy"] - z["y"] * z["y"] / n) / (n - 1)).alias("var"))
        t = lambda s: F.transform(z["beta"], lambda b, i: b / F.nullif(F.sqrt(s["ssr"] / dof * cell(z["inv"], i, i)), F.lit(0.0)))
        f = lambda s: (s["var"] * (n - 1) - s["ssr"]) / max(k - 1, 1) / F.nullif(s["ssr"] / dof, F.lit(0.0))
        return let(done, lambda s: F.struct(z["beta"].alias("beta"), t(s).alias("t"), (s["ssr"] / (n - 1)).alias("resid_var"), s["var"].alias("var"), dof.alias("dof"), f(s).alias("f")))

    inv = let(inverse(part(gram, design, design), k), lambda v: F.when((n - k <= 0) | tight(v), bad).otherwise(v))
    xy = F.transform(numbers(design), lambda i: cell(gram, i, y))
    start = F.struct(inv.alias("inv"), xy.alias("xy"), cell(gram, y, y).alias("yy"), cell(gram, F.lit(0), y).alias("y"))
    return let(start, lambda a: let(F.struct(a["inv"].alias("inv"), a["xy"].alias("xy"), a["yy"].alias("yy"), a["y"].alias("y"), times(a["inv"], a["xy"]).alias("beta")), fitted))


def grs(gram: Column, n: Column, factors: int, assets: int) -> Column:
    """Gibbons-Ross-Shanken statistic and p of the sums of products of ones, factors and
    assets in that order (maximum-likelihood covariances). Raises on too few months and
    where factors reproduce an asset."""
    base, tested, k = list(range(1 + factors)), list(range(1 + factors, 1 + factors + assets)), 1 + factors
    dof = n - assets - factors
    refused = F.raise_error(F.lit("the residual covariance can't be inverted")).cast("double")
    mean = F.transform(numbers(base[1:]), lambda i: cell(gram, F.lit(0), i) / n)
    sharpe = let(mean, lambda m: dot(m, solve(covariance(gram, n, base[1:], 0), m, factors)))

    def pricing(z: Column) -> Column:
        explained = F.transform(z["b"], lambda b: F.transform(z["xy"], lambda x: dot(b, x)))
        sigma = F.zip_with(part(gram, tested, tested), explained, lambda x, y: F.zip_with(x, y, lambda u, v: (u - v) / n))
        flat = lambda s: F.exists(F.transform(s, lambda row, i: F.get(row, i) <= 1e-10 * cell(gram, F.get(numbers(tested), i), F.get(numbers(tested), i)) / n), lambda x: x)
        alpha = F.transform(z["b"], lambda b: F.get(b, F.lit(0)))
        return let(sigma, lambda s: F.when(flat(s), refused).otherwise(let(alpha, lambda a: dot(a, solve(s, a, assets)))))

    def coefficients(xy: Column) -> Column:
        found = F.transform(reduced(beside(part(gram, base, base), xy), k), lambda row: F.slice(row, k + 1, assets))
        return F.struct(transposed(found, assets).alias("b"), transposed(xy, assets).alias("xy"))

    statistic = F.when(dof > 0, dof / assets * let(let(part(gram, base, tested), coefficients), pricing) / (1 + sharpe)).otherwise(refused)
    return let(statistic, lambda s: F.struct(s.alias("statistic"), f_survival(s, F.lit(assets), dof.cast("int")).alias("p")))


def eigen(m: Column, n: int, sweeps: int = 10) -> Column:
    """array<struct<value, vector>> of a symmetric matrix, largest value first, by cyclic
    Jacobi rotations. A vector's largest number (the first on ties) is positive."""
    pairs = F.expr(f"flatten(array_repeat(flatten(transform(sequence(0, {n - 2}), p -> transform(sequence(p + 1, {n - 1}), q -> named_struct('p', p, 'q', q)))), {sweeps}))")
    start = F.struct(m.cast(MATRIX).alias("a"), identity(n).cast(MATRIX).alias("v"))

    def turned(rows: Column, p: Column, q: Column, c: Column, s: Column) -> Column:
        """Rows p and q, turned in their plane."""
        both = lambda x, y: F.transform(rows, lambda r, i: F.when(i == p, F.zip_with(x, y, lambda u, w: c * u - s * w)).when(i == q, F.zip_with(x, y, lambda u, w: s * u + c * w)).otherwise(r))
        return let(F.struct(F.get(rows, p).alias("x"), F.get(rows, q).alias("y")), lambda z: both(z["x"], z["y"]))

    def across(rows: Column, p: Column, q: Column, c: Column, s: Column) -> Column:
        """Columns p and q, turned in their plane."""
        def row(r: Column) -> Column:
            return let(F.struct(F.get(r, p).alias("x"), F.get(r, q).alias("y")), lambda z: F.transform(r, lambda v, j: F.when(j == p, c * z["x"] - s * z["y"]).when(j == q, s * z["x"] + c * z["y"]).otherwise(v)))

        return F.transform(rows, row)

    def step(acc: Column, k: Column) -> Column:
        p, q = k["p"], k["q"]

        def rotate(x: Column) -> Column:
            theta = (x["qq"] - x["pp"]) / (2 * x["pq"])
            t = let(theta, lambda h: F.when(h >= 0, 1.0).otherwise(-1.0) / (F.abs(h) + F.sqrt(h * h + 1)))
            angle = let(t, lambda v: let(1 / F.sqrt(v * v + 1), lambda c: F.struct(c.alias("c"), (v * c).alias("s"))))
            return let(angle, lambda g: F.struct(across(turned(acc["a"], p, q, g["c"], g["s"]), p, q, g["c"], g["s"]).alias("a"), turned(acc["v"], p, q, g["c"], g["s"]).alias("v")))

        corner = F.struct(cell(acc["a"], p, p).alias("pp"), cell(acc["a"], p, q).alias("pq"), cell(acc["a"], q, q).alias("qq"))
        return let(corner, lambda x: F.when(F.abs(x["pq"]) > 1e-300, rotate(x)).otherwise(acc))

    def facing(v: Column) -> Column:
        top = F.array_max(F.transform(v, lambda x: F.abs(x)))
        sign = let(top, lambda h: F.signum(F.element_at(F.filter(v, lambda x: F.abs(x) >= h * (1 - 1e-9)), 1)))
        return let(sign, lambda s: F.transform(v, lambda x: s * x))

    def listed(acc: Column) -> Column:
        found = F.zip_with(acc["a"], F.sequence(F.lit(0), F.lit(n - 1)), lambda row, i: F.struct(F.get(row, i).alias("value"), facing(F.get(acc["v"], i)).alias("vector")))
        return F.reverse(F.array_sort(found))

    return F.aggregate(pairs, start, step, listed)


def capped_simplex(v: Column, cap: Column, tolerance: float = 1e-12) -> Column:
    """Clipped to [0, cap] and brought to sum one in a round more than it has numbers: what
    is missing is shared by room, what is over is taken by holding. Raises where that is
    no vector of sum one."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), cap)

    def round_(w: Column) -> Column:
        def shared(gap: Column) -> Column:
            share = F.transform(w, lambda x: F.when(gap > 0, cap - x).otherwise(x))
            return F.when(F.abs(gap) <= tolerance, w).otherwise(let(share, lambda s: let(total(s), lambda all_: F.zip_with(w, s, lambda x, y: clip(x + gap * y / F.when(all_ > 0, all_))))))

        return let(1 - total(w), shared)

    def whole(w: Column) -> Column:
        return F.when(F.abs(1 - total(w)) <= 1e-9, w).otherwise(F.raise_error(F.lit("the cap leaves no full investment")).cast(VECTOR))

    return let(F.transform(v, clip).cast(VECTOR), lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c)), c, lambda w, _: round_(w), whole))


# Distributions


def log_gamma_half(n: Column) -> Column:
    """ln of Gamma(n / 2) for a whole n >= 1: a sum of logarithms."""
    terms = F.when(n >= 3, F.sequence(F.lit(1), ((n - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(n % 2 == 1, 0.5 * math.log(math.pi)).otherwise(0.0) + F.aggregate(terms, F.lit(0.0), lambda s, i: s + F.log((n - 2 * i) / 2))


def f_survival(x: Column, d1: Column, d2: Column, terms: int = 200) -> Column:
    """P(F > x) for whole degrees of freedom: the regularised incomplete beta at
    d2 / (d2 + d1 x), by ``terms`` steps of its continued fraction (Lentz)."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def fraction(z: Column) -> Column:
        a, b, y = z["a"], z["b"], z["y"]

        def update(acc: Column, num: Column) -> Column:
            d, c = 1 / tiny(1 + num * acc["d"]), tiny(1 + num / acc["c"])
            return let(F.struct(c.alias("c"), d.alias("d")), lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (acc["out"] * s["c"] * s["d"]).alias("out")))

        def step(acc: Column, m: Column) -> Column:
            even = m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))
            return let(update(acc, even), lambda s: update(s, odd))

        first = 1 / tiny(1 - (a + b) * y / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("out"))
        front = F.exp(z["g"] + a * F.log(y) + b * F.log1p(-y)) / a
        return front * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["out"])

    a, b = d2 / 2.0, d1 / 2.0
    y = d2 / (d2 + d1 * x)
    swap = y > (a + 1) / (a + b + 2)
    scale = log_gamma_half(d1 + d2) - log_gamma_half(d1) - log_gamma_half(d2)
    z = F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), F.when(swap, 1 - y).otherwise(y).alias("y"), scale.alias("g"), swap.alias("swap"))
    tail = let(z, lambda w: let(fraction(w), lambda v: F.when(w["swap"], 1 - v).otherwise(v)))
    return F.when(x <= 0, 1.0).otherwise(tail)
