"""The grid's rows, and the spanning and stability queries, on the whole small panel."""

import math

from quartzfolio import queries as q
from quartzfolio.functions import kernels as K
from quartzfolio.operators import verdicts as V
from quartzfolio.plans import factors as X
from quartzfolio.plans import study as S

D = "/root/testdata/sf0.01"


def test_rows_bars_and_reruns(spark):
    rows = q.study_rows(spark, D).cache()
    by_id = {r.run_id: r for r in rows.collect()}
    assert len(by_id) == 20
    assert by_id["policy"].verdict == V.IS_BENCHMARK and by_id["equal_weight"].verdict == V.IS_EQUAL_WEIGHT
    assert by_id["mean_variance_none"].verdict == V.REPRODUCES
    assert by_id["minimum_variance_expanding"].verdict == V.IS_EXPANDING
    assert all(math.isclose(r.bar, K.family_wise_bar(16)) for r in by_id.values())
    table = S.metric_table(rows)
    assert S.reproduces(table, table).count() == 0
    moved = table.withColumn("value", q.F.when(q.F.col("run_id") == "policy", q.F.col("value") + 1).otherwise(q.F.col("value")))
    assert S.reproduces(table, moved).count() > 0


def test_fit_splits_the_variance(spark):
    fit = q._fit(spark, D).toPandas()
    wide = fit[fit.quantity.isin(["resid_var", "explained_var", "r2"])].pivot_table(index=["protocol", "traded", "instrument"], columns="quantity", values="value")
    assert abs(wide.explained_var / (wide.explained_var + wide.resid_var) - wide.r2).max() < 1e-9
    vif = fit[fit.quantity == "vif_orthogonal"].value
    assert (vif < fit[fit.quantity == "vif_declared"].value.max() + 1e-9).all() and (vif >= 1 - 1e-9).all()


def test_attribution_adds_up(spark):
    rows = X.decomposition(*q._views(spark, D)).toPandas()
    assert abs(rows.factors + rows.alpha + rows.residual - rows.active).max() < 1e-12


def test_components(spark):
    rows = q.principal_components(spark, D).toPandas()
    for _, part in rows.groupby("traded"):
        assert abs(part.eigenvalue.sum() - 6) < 1e-6 and abs(part.share.sum() - 1) < 1e-6  # seven digits each
        assert part.retained.iloc[0] == (part.eigenvalue > part.bar).sum()
    assert (q.grs_spanning(spark, D).toPandas().p.between(0, 1)).all()
