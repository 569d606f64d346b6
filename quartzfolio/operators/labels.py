"""Names that have to match before numbers meet: each rule refuses instead of dropping.

A join on names loses what one side lacks and still gives a number. These checks stand
where books meet covariances, vectors meet names and series meet a declared set. All
but ``need`` are part of a plan and raise when the rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions import arrays as L


def need(rows: DataFrame, names: list[str], column: str = "instrument") -> DataFrame:
    """``rows`` if they hold each of ``names``; refuses at once and says which are missing."""
    found = {r[0] for r in rows.where(F.col(column).isin(*names)).select(column).distinct().collect()}  # of the declared names
    missing = [n for n in names if n not in found]
    if missing:
        raise Refusal(f"no rows of {', '.join(missing)}")
    return rows


def covered(weights: DataFrame, cov: DataFrame, keys: list[str], name: str = "instrument", value: str = "weight") -> DataFrame:
    """``weights`` (keys, name, value) where each book and the covariance it meets (some
    of the keys, i, j, value) name the same sleeves, each once; raises otherwise."""
    shared = [k for k in keys if k in cov.columns]
    books = weights.groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias("_held"))
    known = cov.groupBy(*shared).agg(F.array_sort(F.collect_set("i")).alias("_known"), F.count("*").alias("_cells"))
    met = books.join(known, shared, "left") if shared else books.crossJoin(F.broadcast(known))
    say = lambda text: F.raise_error(F.lit(text)).cast("boolean")
    fine = (
        F.when(F.col("_known").isNull(), say("a book meets no covariance"))
        .when(F.size(F.array_distinct("_held")) != F.size("_held"), say("a book holds a sleeve twice"))
        .when(F.size(F.array_except("_known", "_held")) > 0, say("the book lacks a sleeve of the covariance"))
        .when(F.size(F.array_except("_held", "_known")) > 0, say("the covariance does not cover every sleeve the book holds"))
        .when(F.col("_cells") != F.size("_known") * F.size("_known"), say("the covariance is not one value for each pair"))
        .otherwise(True)
    )
    checked = met.select(*keys, fine.alias("_fine")).where("_fine")  # stands before any later join can drop a book
    rows = weights.join(checked, keys) if keys else weights.crossJoin(F.broadcast(checked))
    return rows.withColumn(value, F.when(F.col("_fine"), F.col(value))).drop("_fine")


def labelled(values: Column, names: Column, cap: Column) -> Column:
    """map<name, weight>: a vector brought to the constraint set under its names; raises
    where names repeat or are not as many as the weights."""
    bad = lambda text: F.raise_error(F.lit(text)).cast(L.VECTOR)
    checked = F.when(F.size(values) != F.size(names), bad("weights and names differ in number")).when(F.size(F.array_distinct(names)) != F.size(names), bad("a name stands twice")).otherwise(values)
    return F.map_from_arrays(names, L.capped_simplex(checked, cap))


def one_value(value: str, key: str, wanted: str) -> Column:
    """The value of ``wanted`` in a group, as an aggregate; null if there is none, raises
    if there are two."""
    mine = F.when(F.col(key) == wanted, F.col(value))
    return F.when(F.count(mine) <= 1, F.max(mine)).otherwise(F.raise_error(F.lit(f"two values of {wanted} in a month")).cast("double"))
