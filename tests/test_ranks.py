"""Ranks that stay on their rows, and the correlations built on them, against pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hourpanel.operators import quantile, reports


def frame(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, n)
    a = rng.normal(0, 1, n).round(2)
    a[rng.random(n) < 0.35] = 0.0  # one value holds a third of the rows
    b = a * 0.5 + rng.normal(0, 1, n)
    b[rng.random(n) < 0.2] = np.nan
    c = rng.integers(0, 4, n).astype(float)
    c[g == 2] = 7.0  # a constant column in one group
    return pd.DataFrame({"g": g, "i": np.arange(n), "a": a, "b": b, "c": c})


def test_ranks_equal_pandas(make, spark):
    pdf = frame()
    df = make(pdf)
    wanted = {"ra": F.col("a"), "rb": F.col("b"), "ra_with_b": F.when(F.col("b").isNotNull(), F.col("a"))}
    got = quantile.with_ranks(df, ["g"], wanted).toPandas().sort_values("i").reset_index(drop=True)
    assert list(got.columns) == ["g", "i", "a", "b", "c", "ra", "rb", "ra_with_b"] and len(got) == len(pdf)
    np.testing.assert_allclose(got.ra, pdf.groupby("g").a.rank())
    np.testing.assert_allclose(got.rb, pdf.groupby("g").b.rank())
    np.testing.assert_allclose(got.ra_with_b, pdf.assign(x=pdf.a.where(pdf.b.notna())).groupby("g").x.rank())
    assert quantile.with_ranks(df.limit(0), ["g"], wanted).count() == 0


def test_association_equals_pandas(make):
    pdf = frame(seed=2)
    got = {(r.g, r.feature, r.target): r for r in reports.association(make(pdf), ["a", "b", "c"], ["a", "b"], ["g"]).collect()}
    for (g, f, t), r in got.items():
        part = pdf[pdf.g == g][list(dict.fromkeys([f, t]))].dropna()
        assert r.n_pairs == len(part)
        x, y = part[f], part[t]
        if x.nunique() == 1:
            assert r.pearson is None or np.isnan(r.pearson)
            continue
        np.testing.assert_allclose([r.pearson, r.spearman], [x.corr(y), x.rank().corr(y.rank())], atol=1e-9)
    assert len(got) == 18
    whole = {(r.feature, r.target): r.n_pairs for r in reports.association(make(pdf), ["c"], ["a", "b"]).collect()}
    assert whole == {("c", "a"): len(pdf), ("c", "b"): int(pdf.b.notna().sum())}


def test_no_exchange_is_keyed_by_a_value(make):
    plan = quantile.with_ranks(make(frame(200)), ["g"], {"ra": F.col("a"), "rc": F.col("c")})._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and not any("_v_" in line.split("hashpartitioning(")[1].split("ENSURE")[0] for line in keys)
