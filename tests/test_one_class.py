"""Tables of which every row has the same label, and routing tables without rows."""

import pandas as pd
import pytest

from pyspark.sql import functions as F

from hourpanel.operators import calibrate, checks, models


def labelled(make, label):
    rows = [(s, day, day.date(), float(i % 7), label(s, i)) for s in (0, 1) for i, day in enumerate(pd.date_range("2024-01-01", periods=30))]
    return make(pd.DataFrame(rows, columns=["series_id", "ds", "business_day", "x", "label"]))


@pytest.mark.parametrize("only", [0, 1])
def test_out_of_fold_probability_of_one_class(make, only):
    got = models.out_of_fold_probability(labelled(make, lambda s, i: only), ["series_id"], ["x"], "label", k=3, trees=2, depth=2).collect()
    assert len(got) == 60 and {r.oof_prob for r in got} == {float(only)}


def test_recall_without_positives(make):
    rows = [(0, 0.2, 0), (0, 0.6, 0), (0, 0.2, 0), (1, 0.1, 0), (1, 0.9, 1)]
    df = make(pd.DataFrame(rows, columns=["series_id", "prob", "label"]))
    got = {r.series_id: r for r in calibrate.best_recall_at_precision(df, ["series_id"], 0.25).collect()}
    assert (got[0].threshold, got[0].precision, got[0].recall, got[0].reached) == (0.2, 0.0, None, False)
    assert (got[1].threshold, got[1].precision, got[1].recall, got[1].reached) == (0.1, 0.5, 1.0, True)


def test_risk_forest_of_one_class(make):
    df = labelled(make, lambda s, i: int(i > 20))
    model = models.fit_risk(df.where("label = 0"), ["x"], "label", trees=2, depth=2)
    got = models.risk_probability(model, df, ["x"]).collect()
    assert len(got) == 60 and {r.risk for r in got} == {0.0}


def test_risk_forest_without_history(make):
    df = labelled(make, lambda s, i: int(i > 20))
    for history in (df.where("label > 1"), df.withColumn("label", F.lit(None).cast("bigint"))):
        got = models.risk_probability(models.fit_risk(history, ["x"], "label", trees=2, depth=2), df, ["x"]).collect()
        assert len(got) == 60 and {r.risk for r in got} == {None}


def test_features_without_values(make):
    df = labelled(make, lambda s, i: int(i % 7 > 3)).withColumn("none", F.lit(None).cast("double"))
    one, both, none = (models.risk_probability(models.fit_risk(df, f, "label", trees=1, depth=2), df, f).collect() for f in (["x"], ["x", "none"], ["none"]))
    assert len(one) == len(both) == len(none) == 60 and len({r.risk for r in none}) == 1
    assert all((r.risk > 0.5) == (r.label == 1) for r in one + both)


def test_regressions_without_history(make):
    df = labelled(make, lambda s, i: int(i > 20)).withColumns({"period": F.lit("1_8"), "da": F.lit(1.0), "delta_target": F.lit(0.0), "hour_business": F.lit(1)})
    nothing = df.where("label > 1")
    assert {r.rt_hat for r in models.delta_regression(nothing, df, ["x"], iterations=1).collect()} == {None}
    assert {r.spike_prob for r in models.spike_detector(nothing, df, ["x"], "label", iterations=1).collect()} == {None}
    assert len(models.segment_regression(nothing, df, ["x"], "label", ["series_id"], iterations=1).collect()) == 60


def test_routing_of_series_without_entries(make, spark):
    routing = make(pd.DataFrame([(0, "dayahead", "1_8")], columns=["series_id", "task", "period"]))
    everyone = spark.range(2).select(F.col("id").alias("series_id"))
    got = checks.routing_checks(routing, ["series_id"], expected=everyone).where("check_name = 'routing_present'").collect()
    assert len(got) == 12 and [(r.series_id, r.task, r.period) for r in got if r.passed] == [(0, "dayahead", "1_8")]
    nothing = checks.routing_checks(routing.where("series_id = 9"), expected=None).where("check_name = 'routing_present'").collect()
    assert len(nothing) == 6 and not any(r.passed for r in nothing)
