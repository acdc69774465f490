import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourpanel.functions import clock, scores
from hourpanel.operators import normalize

STAMPS = ["2024-01-01 00:00:00", "2024-01-01 00:30:00", "2024-01-01 01:00:00", "2024-01-01 01:30:00", "2024-02-29 23:59:00", "2024-12-31 00:00:00"]
WANT = {
    "hour0": [("2023-12-31", 24), ("2023-12-31", 24), ("2024-01-01", 1), ("2024-01-01", 1), ("2024-02-29", 23), ("2024-12-30", 24)],
    "exact_midnight": [("2023-12-31", 24), ("2024-01-01", 1), ("2024-01-01", 1), ("2024-01-01", 1), ("2024-02-29", 23), ("2024-12-30", 24)],
    "one_second": [("2023-12-31", 24), ("2024-01-01", 1), ("2024-01-01", 1), ("2024-01-01", 2), ("2024-02-29", 24), ("2024-12-30", 24)],
    "plain_plus1": [("2024-01-01", 1), ("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-01", 2), ("2024-02-29", 24), ("2024-12-31", 1)],
}


@pytest.mark.parametrize("mode", clock.MODES)
def test_clock_modes(make, mode):
    df = make(pd.DataFrame({"i": range(len(STAMPS)), "ds": pd.to_datetime(STAMPS)}))
    got = clock.with_business_clock(df, "ds", mode).orderBy("i").collect()
    assert [(str(r.business_day), r.hour_business) for r in got] == WANT[mode]


def test_round_trip_and_periods(make):
    df = make(pd.DataFrame({"ds": pd.date_range("2024-03-30 00:00:00", periods=60, freq="h")}))
    out = clock.with_business_clock(df).withColumn("back", clock.business_timestamp("business_day", "hour_business"))
    assert out.where("back != ds").count() == 0
    assert {r[0] for r in out.select(clock.period_of("hour_business")).collect()} == {"1_8", "9_16", "17_24"}
    assert make(pd.DataFrame({"h": [0, 25]})).select(clock.period_of("h").alias("p")).distinct().collect()[0].p == "unknown"


def ref(v, t, p):
    f = lambda x: max(x, 50.0)
    a = lambda x: max(abs(x), 50.0)
    fl = abs(f(p) - f(t)) / max((f(p) + f(t)) / 2, 1e-6)
    half = (abs(t) + abs(p)) / 2
    return {
        "floor50": 100 * fl,
        "raw": 200 * abs(p - t) / (abs(t) + abs(p) + 1e-6),
        "capped": 200 * abs(f(p) - f(t)) / (f(t) + f(p) + 1e-6),
        "denom50": 100 * abs(t - p) / max(half, 50),
        "eval_raw": 200 * abs(p - t) / max(abs(t) + abs(p), 1e-6),
        "eval_clip50": 200 * abs(f(p) - f(t)) / max(f(t) + f(p), 1e-6),
        "fraction": fl,
        "row_capped": min(100 * fl, 50),
        "regime": 200 * abs(p - t) / (abs(p) + abs(t) + 1e-10),
        "absfloor_capped": min(100 * abs(a(t) - a(p)) / ((a(t) + a(p)) / 2), 50),
        "raw_capped": min(100 * abs(t - p) / half if half > 1e-10 else 0, 50),
        "denom_absfloor": 2 * abs(t - p) / (a(t) + a(p)),
    }[v]


def test_smape_rows(make):
    pairs = [(50.0, 49.999), (0.0, 0.0), (-80.0, 80.0), (120.0, 60.0), (900.0, 100.0), (-5.0, 300.0)]
    df = make(pd.DataFrame(pairs, columns=["t", "p"]))
    for v in scores.SMAPE_VARIANTS:
        for r in df.select("t", "p", scores.smape_row(v, "t", "p").alias("s")).collect():
            assert r.s == pytest.approx(ref(v, r.t, r.p), abs=1e-9), (v, r)
    none = make(pd.DataFrame({"t": [None, 1.0], "p": [2.0, 2.0]})).where("t is null")
    assert none.select(scores.smape_row("row_capped", "t", "p").alias("s")).first().s == 50.0
    assert none.select(scores.smape_row("floor50", "t", "p").alias("s")).first().s is None


def test_minus_eighty_counts_as_plus_eighty(make):
    df = make(pd.DataFrame({"t": [-80.0], "p": [80.0]}))
    assert df.select(scores.smape("absfloor_capped", "t", "p").alias("s")).first().s == 0.0


def test_aliases_and_tasks(make):
    df = make(pd.DataFrame({" 时刻 ": ["x"], "realtime_price": [1.0], "rt_price": [2.0]}))
    assert normalize.rename_aliases(df, {"时刻": "ds", "realtime_price": "rt_price"}).columns == ["ds", "realtime_price", "rt_price"]
    w = make(pd.DataFrame({"w": ["DA", " 实时 ", "what", None]}))
    assert [r[0] for r in w.select(normalize.task_of("w")).collect()] == ["dayahead", "realtime", None, None]
    with pytest.raises(Exception, match="unsupported task"):
        w.select(normalize.task_of("w", strict=True)).collect()


def test_leaking_columns_are_dropped(make):
    df = make(pd.DataFrame({"wind_actual": [1.0], "风电总加实际值": [1.0], "label": [1], "target_x": [1], "load_forecast": [2.0]}))
    assert normalize.drop_leaking_columns(df).columns == ["load_forecast"]


def test_strict_contract_raises(make):
    row = {"task": ["rt"], "model_name": ["m"], "target_day": ["2024-01-01"], "ds": ["2024-01-01 01:00:00"], "period": [""], "hour_business": [1], "y_true": ["nan"], "y_pred": [1.0]}
    ok, bad = normalize.standardise_predictions(make(pd.DataFrame(row)))
    assert ok.count() == 0 and bad.first().check_name == "missing_y_true"
    with pytest.raises(ValueError, match="missing_y_true"):
        normalize.standardise_predictions(make(pd.DataFrame(row)), strict=True)
