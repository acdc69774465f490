"""Cuts of the rank sketch: found by halving, joined without gathering a key's rows, windows only where order is needed."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hourpanel.operators import quantile


def test_cuts_below_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.integers(0, 50, n)).astype(float).tolist(), float(v)) for n in (0, 1, 2, 128, 254, 255) for v in (-1, 0, 7, 24.5, 49, 60)]
    df = spark.createDataFrame(rows, "cuts array<double>, v double")
    got = quantile._cuts_below(df, {"below": ("cuts", "v")}).collect()
    assert [r.below for r in got] == [int(np.searchsorted(c, v)) for c, v in rows]


def test_rows_are_not_gathered_by_key(make):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 4000), "few": rng.integers(0, 9, 4000).astype(float), "many": rng.normal(0, 1, 4000)})
    got = quantile.with_ranks(make(pdf), ["g"], {"r_many": F.col("many"), "r_few": F.col("few")})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the window of the column that needs one
    pdf = pdf.sort_values(["g", "many"]).reset_index(drop=True)
    got = got.toPandas().sort_values(["g", "many"])
    np.testing.assert_allclose(got.r_few, pdf.groupby("g").few.rank())
    np.testing.assert_allclose(got.r_many, pdf.groupby("g").many.rank())


def test_running_counts_join_cuts_without_sorting_by_key(make):
    df = make(pd.DataFrame({"g": [0, 0, 1], "x": [1.0, 2.0, 2.0], "n": [1, 2, 3]}))
    got = quantile.cumulative_counts(df, ["g"], "x", {"n": F.col("n")}, distinct=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [g" in plan and sorted((r.g, r.x, r.cum_n) for r in got.collect()) == [(0, 1.0, 1), (0, 2.0, 3), (1, 2.0, 3)]
