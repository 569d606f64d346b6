"""Seeded random numbers as rows, and the SQL that draws the same ones.

All draws come from one documented seed. A table of draws is made in one task, by one
generator, since a generator's numbers follow on each other; its size is given by
parameters and the panel's months. What uses the draws is joins and groups.

The generator is PCG64 (O'Neill, 2014): a linear congruence in 128 bits, its output the
xor of the state's halves turned by its six highest bits. Whole numbers below a bound
come from 32-bit halves, low half first, as the upper half of their product with the
bound, where a half is passed over if the product's lower half falls in the surplus
(Lemire, 2019). ``pcg_sql`` states just that: the first 2**k states by doubling, each
step with the squared congruence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SEED = 20260912
#: Resamples of the months for the leader's rank, and shifts for the components' null (fixed values).
RESAMPLES, SHIFTS = 2000, 200
#: The multiplier of the generator (fixed value).
_MULTIPLIER = 47026247687942121848144207491837523525


def _one_task(spark: SparkSession, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            arrays = make()
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), pa.int32()) for a in arrays], [c.split()[0] for c in schema.split(", ")])

    return spark.range(1, numPartitions=1).mapInArrow(run, schema)


def resampled_months(spark: SparkSession, months: int, draws: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """draw, pos, month_index: for each draw as many months as there are, with replacement."""

    def make():
        pick = np.random.default_rng(seed).integers(0, months, size=(draws, months))
        return (*np.indices(pick.shape), pick)

    return _one_task(spark, make, "draw int, pos int, month_index int")


def shifts(spark: SparkSession, months: int, series: int, draws: int = SHIFTS, seed: int = SEED) -> DataFrame:
    """draw, ord, shift: a circular shift of 1 to ``months`` - 1 for each series and draw."""

    def make():
        rng = np.random.default_rng(seed)
        move = np.array([[rng.integers(1, months) for _ in range(series)] for _ in range(draws)]).reshape(draws, series)
        return (*np.indices(move.shape), move)

    return _one_task(spark, make, "draw int, ord int, shift int")


def pcg_sql(name: str, bound: str, count: str, seed: int = SEED) -> dict[str, str]:
    """Named relations whose last, ``name``, holds (k, v): the first ``count`` whole numbers
    below ``bound`` (both SQL scalars) that the generator of ``seed`` gives."""
    begin, half = np.random.default_rng(seed).bit_generator.state["state"], 1 << 64
    first = ((begin["state"] * _MULTIPLIER + begin["inc"]) % half**2, _MULTIPLIER, begin["inc"])
    sh, sl, mh, ml, ch, cl = (f"{p}::UHUGEINT" for x in first for p in divmod(x, half))

    def product(a: str, b: str, plus: str | None = None) -> tuple[str, str]:
        """Halves of a * b + plus modulo 2**128, of values named by their halves h and l."""
        upper = f"{a}l * {b}l // {half} + {a}h * {b}l % {half} + {a}l * {b}h % {half}"
        if plus is None:
            return f"({upper}) % {half}", f"{a}l * {b}l % {half}"
        return f"({upper} + {plus}h + ({a}l * {b}l % {half} + {plus}l) // {half}) % {half}", f"({a}l * {b}l % {half} + {plus}l) % {half}"

    (nh, nl), (qh, ql), (dh, dl) = product("m", "s", "c"), product("m", "m"), product("m", "c", "c")
    return {
        f"{name}_need": f"SELECT CAST({bound} AS UBIGINT) AS b, CAST({count} AS BIGINT) AS n",
        f"{name}_states": f"""SELECT 0 AS level, CAST(0 AS BIGINT) AS i, {sh} AS sh, {sl} AS sl, {mh} AS mh, {ml} AS ml, {ch} AS ch, {cl} AS cl
            UNION ALL SELECT level + 1, i + later * (1::BIGINT << level), CASE later WHEN 1 THEN {nh} ELSE sh END, CASE later WHEN 1 THEN {nl} ELSE sl END, {qh}, {ql}, {dh}, {dl}
            FROM {name}_states, (VALUES (0), (1)) t(later), {name}_need WHERE (1::BIGINT << level) * 2 < n + n * b::BIGINT // {1 << 31} + 64""",
        f"{name}_words": f"SELECT i, (x >> sh // {1 << 58}) + (x << 64 - sh // {1 << 58}) % {half} AS w FROM (SELECT *, xor(sh, sl) AS x FROM {name}_states WHERE level = (SELECT max(level) FROM {name}_states))",
        f"{name}_halves": f"SELECT 2 * i AS j, (w % {1 << 32})::UBIGINT AS u FROM {name}_words UNION ALL SELECT 2 * i + 1, (w // {1 << 32})::UBIGINT FROM {name}_words",
        f"{name}": f"SELECT k, v FROM (SELECT row_number() OVER (ORDER BY j) - 1 AS k, (u * b // {1 << 32})::BIGINT AS v, n FROM {name}_halves, {name}_need WHERE u * b % {1 << 32} >= ({1 << 32} - b) % b) WHERE k < n",
    }
