import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourpanel.operators import fusion, learners, solve

BY = ["series_id", "task", "period"]
POINT = ["series_id", *fusion.POINT]
MODELS = ["a", "b", "c"]


def v1(y, p):
    y, p = np.maximum(y, 50), np.maximum(p, 50)
    return float(np.mean(np.abs(p - y) / ((y + p) / 2)) * 100)


def point(make, preds, weights):
    rows = [(0, "realtime", m, pd.Timestamp("2024-01-01").date(), pd.Timestamp("2024-01-01 09:00:00"), "9_16", 9, 10.0, v) for m, v in preds.items()]
    df = make(pd.DataFrame(rows, columns=["series_id", "task", "model_name", "target_day", "ds", "period", "hour_business", "y_true", "y_pred"]))
    w = make(pd.DataFrame([(0, "realtime", "9_16", m, x) for m, x in weights.items()], columns=[*BY, "model_name", "weight"]))
    return df, w


@pytest.mark.parametrize(
    "rule,want",
    [("propagate", None), ("renorm_tol", (0.5 * 10 + 0.3 * 20) / 0.8), ("renorm_group", (0.5 * 10 + 0.3 * 20) / 0.8), ("renorm_row", 11 / 0.8), ("zero", 11.0), ("renorm_used", 11 / 0.8)],
)
def test_missing_rules(make, rule, want):
    df, w = point(make, {"a": 10.0, "b": 20.0}, {"a": 0.5, "b": 0.3, "c": 0.2})
    got = fusion.fuse(df, w, BY, POINT, rule).first().y_fused
    assert got is None if want is None else got == pytest.approx(want)


def test_tolerance_and_vanishing_weights(make):
    df, w = point(make, {"a": 10.0, "b": 20.0}, {"a": 0.5, "b": 0.495})
    assert fusion.fuse(df, w, BY, POINT, "renorm_tol").first().y_fused == pytest.approx(14.9)
    df, w = point(make, {"a": 10.0, "b": 20.0}, {"a": 0.0, "b": 0.0})
    assert fusion.fuse(df, w, BY, POINT, "renorm_row").first().y_fused == pytest.approx(15.0)
    assert fusion.fuse(df, w, BY, POINT, "renorm_used").first().y_fused is None
    df, w = point(make, {"a": 10.0, "b": 20.0}, {"a": 1.0})
    assert fusion.fuse(df, w.where("period = 'none'"), BY, POINT).first().regime == "fallback_mean"


def sums_to_one(weights):
    return np.allclose([r.s for r in weights.groupBy(*BY).agg(F.sum("weight").alias("s")).collect()], 1.0)


def test_weight_invariants(panel):
    _, df = panel
    for w in (fusion.inverse_mae(df, BY), fusion.softmax_rmse(df, BY, POINT), fusion.equal_weights(df, BY), learners.bgew(df, BY, 3)):
        assert sums_to_one(w)
    best = fusion.inverse_mae(df, BY).toPandas().sort_values("weight").groupby(BY).tail(1)
    assert set(best.model_name) == {"c"}


def test_projection_equals_numpy(make):
    rng = np.random.default_rng(0)
    rows = [(g, f"m{i}", float(v)) for g in range(20) for i, v in enumerate(rng.normal(0.3, 0.8, 4))]
    pdf = pd.DataFrame(rows, columns=["g", "model_name", "weight"])
    got = fusion.project_weights(make(pdf), ["g"], strict_fix=True).toPandas().sort_values(["g", "model_name"])
    for g, part in pdf.groupby("g"):
        want = solve.project_box(part.weight.to_numpy(), -0.5, 1.2)
        np.testing.assert_allclose(got[got.g == g].weight, want, atol=1e-6)
        assert abs(want.sum() - 1) < 1e-6 and want.min() >= -0.5 - 1e-9 and want.max() <= 1.2 + 1e-9


@pytest.mark.parametrize(("given", "want"), [
    ([0.5, 0.7], [0.4, 0.6]), ([3.0, 0.1, 0.3], [1.0, -0.1, 0.1]), ([1.2, 0.9, -0.5], [0.75, 0.75, -0.5]), ([0.2, 0.3, 0.5], [0.2, 0.3, 0.5]), ([7.0], [1.0]), ([2.0, 0.0, 0.0, 0.0], [1.15, -0.05, -0.05, -0.05]),
])
def test_published_projection(make, given, want):
    pdf = pd.DataFrame([(1, f"m{i}", v) for i, v in enumerate(given)], columns=["g", "model_name", "weight"])
    got = fusion.project_weights(make(pdf), ["g"]).toPandas().sort_values("model_name").weight
    assert abs(got.sum() - 1) < 1e-9 and got.min() >= -0.5 and got.max() <= 1.2
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_convex_solution_beats_lattice(panel):
    pdf, df = panel
    wide = fusion.wide_frame(df, POINT, MODELS)
    got = solve.solve(solve.gram(wide, BY, MODELS), BY, MODELS, "convex").toPandas()
    w = pdf.pivot_table(index=[*BY, "ds", "y_true"], columns="model_name", values="y_pred").reset_index()
    for key, part in w.groupby(BY):
        sel = got[(got[BY] == list(key)).all(axis=1)].set_index("model_name").weight[MODELS].to_numpy()
        assert sel.min() >= 0 and abs(sel.sum() - 1) < 1e-9
        loss = lambda v: np.mean((part.y_true - part[MODELS].to_numpy() @ np.asarray(v)) ** 2)
        assert loss(sel) <= min(loss(c) for c in simplex_grid(3, 20)) + 1e-6


def simplex_grid(k, steps):
    return [tuple((b - a - 1) / steps for a, b in zip((-1, *c), (*c, steps + k - 1))) for c in itertools.combinations(range(steps + k - 1), k - 1)]


def test_search_is_not_above_a_fine_lattice(panel):
    pdf, df = panel
    got = fusion.convex_search(fusion.wide_frame(df, POINT, MODELS), BY, MODELS).toPandas()
    w = pdf.pivot_table(index=[*BY, "ds", "y_true"], columns="model_name", values="y_pred").reset_index()
    for key, part in w.groupby(BY):
        row = got[(got[BY] == list(key)).all(axis=1)].iloc[0]
        best = min(v1(part.y_true.to_numpy(), part[MODELS].to_numpy() @ np.asarray(c)) for c in simplex_grid(3, 40))
        assert row.loss <= best + 2e-4 * abs(best)
        assert row.loss == pytest.approx(v1(part.y_true.to_numpy(), part[MODELS].to_numpy() @ np.asarray(row.weights)))


@pytest.mark.parametrize(("truth", "bounds", "loss"), [
    ((1.0, -0.4, 0.4), (-0.5, 1.2), "floor50"), ((0.53, 0.34, 0.13), (0.0, 1.0), "mae"), ((0.6, 0.1, 0.1, 0.1, 0.1), (0.03, 1.0), "composite"), ((0.02, 0.9, 0.08), (0.0, 1.0), "floor50"),
])
def test_search_finds_the_truth(make, truth, bounds, loss):
    rng = np.random.default_rng(5)
    x = rng.normal(100, 60, (400, len(truth)))
    names = [f"m{i}" for i in range(len(truth))]
    pdf = pd.DataFrame(x, columns=names).assign(g=1, y_true=x @ np.array(truth))
    row = fusion.convex_search(make(pdf), ["g"], names, loss, bounds=bounds).toPandas().iloc[0]
    assert row.loss < 1e-3 and np.allclose(row.weights, truth, atol=1e-3) and abs(sum(row.weights) - 1) < 1e-9


def test_small_solves_equal_trying_all_supports():
    rng = np.random.default_rng(6)
    for trial in range(200):
        k = int(rng.integers(1, 6))
        m = rng.normal(size=(k + 2, k))
        a, b = m.T @ m, rng.normal(size=k) * 3
        total, lo, hi = (1.0, 0.0, np.inf) if trial % 2 else (None, 0.0, np.inf)
        w = solve.box_minimum(a, b, lo, hi, total)
        best = np.inf
        for r in range(0 if total is None else 1, k + 1):
            for sup in itertools.combinations(range(k), r):
                i, v = list(sup), np.zeros(k)
                if total is None:
                    v[i] = np.linalg.lstsq(a[np.ix_(i, i)], b[i], rcond=None)[0]
                else:
                    kkt = np.block([[a[np.ix_(i, i)], np.ones((r, 1))], [np.ones((1, r)), np.zeros((1, 1))]])
                    v[i] = np.linalg.lstsq(kkt, np.append(b[i], 1.0), rcond=None)[0][:r]
                if (v >= -1e-9).all():
                    best = min(best, 0.5 * v @ a @ v - b @ v)
        assert 0.5 * w @ a @ w - b @ w <= best + 1e-7 and w.min() >= -1e-12 and (total is None or abs(w.sum() - 1) < 1e-9)


def test_bgew_closed_form_equals_updates(panel):
    pdf, df = panel
    got = learners.bgew(df, BY, 3).toPandas().set_index([*BY, "model_name"]).weight
    for key, part in pdf.groupby(BY):
        w, last = np.ones(3) / 3, part.target_day.max()
        for day, d in part.groupby("target_day"):
            loss = np.array([v1(*d[d.model_name == m][["y_true", "y_pred"]].to_numpy().T) for m in MODELS])
            norm = np.clip(loss / np.median(loss), 0, 5)
            w = w * np.exp(-0.5 * np.exp(-(last - day).days / 30) * norm)
            w /= w.sum()
        np.testing.assert_allclose([got[(*key, m)] for m in MODELS], w, rtol=1e-9)


def test_tap_update_equals_loop(make):
    rows = []
    rng = np.random.default_rng(3)
    for f in range(10):
        for m in MODELS:
            if not (f == 4 and m == "b"):
                rows.append((0, f, 9 - f, 0.3 + 0.05 * f, m, float(rng.uniform(1, 9))))
    pdf = pd.DataFrame(rows, columns=["g", "tap_fold_id", "age_block", "mean_gate", "model_name", "loss"])
    pdf["median_loss"] = pdf.groupby("tap_fold_id").loss.transform("median")
    got = learners.tap_update(make(pdf), ["g"], MODELS).toPandas().set_index("model_name").weight
    w = {m: 1 / 3 for m in MODELS}
    for f in range(9, -1, -1):
        part = pdf[pdf.tap_fold_id == f]
        for r in part.itertuples():
            w[r.model_name] = max(w[r.model_name] * np.exp(-0.8 * r.mean_gate * np.clip(r.loss / r.median_loss, 0.25, 4)), 0.03)
        t = sum(w.values())
        w = {m: x / t for m, x in w.items()}
    for m in MODELS:
        assert got[m] == pytest.approx(w[m])


def test_rolling_weights_use_only_the_past(panel, make):
    pdf, df = panel
    later = pdf.copy()
    later.loc[later.business_day >= pd.Timestamp("2024-01-08").date(), "y_pred"] *= 3
    a, b = (fusion.rolling_weights(x, ["series_id"], MODELS, "convex", 5, 2).where("business_day <= date'2024-01-08'").orderBy("series_id", "business_day", "model_name").toPandas() for x in (df, make(later)))
    pd.testing.assert_frame_equal(a, b)
    first = a[a.business_day == a.business_day.min()]
    assert np.allclose(first.weight, 1 / 3)


def test_candidate_choice_prefers_the_simple(make):
    rows = [(0, "equal_weight", "equal_weight", 0, 10.001), (0, "static_convex", "static_convex", 1, 10.0), (0, "single_a", "single_model", 3, 10.005), (0, "single_b", "single_model", 4, 30.0)]
    df = make(pd.DataFrame(rows, columns=["g", "candidate_name", "selected_mode", "position", "score"]))
    assert learners.choose_candidate(df, ["g"]).where("chosen").first().candidate_name == "single_a"


def test_router_never_does_worse_than_its_rule(panel):
    _, df = panel
    wide = fusion.wide_frame(df, POINT, MODELS)
    report, weights = learners.router(wide, BY, MODELS)
    assert sums_to_one(weights)
    r = {tuple(x[k] for k in BY): x for x in report.collect()}
    for x in weights.collect():
        rep = r[tuple(x[k] for k in BY)]
        if not rep.use_router:
            assert x.weight == (1.0 if x.model_name == rep.best_single_model else 0.0)


def test_time_folds_match_time_series_split(make):
    pdf = pd.DataFrame({"g": 0, "ds": pd.date_range("2024-01-01", periods=23, freq="h")})
    got = learners.time_folds(make(pdf), ["g"], 3).orderBy("ds").toPandas().fold.tolist()
    size = 23 // 4
    want = [0] * (23 - 3 * size) + [1] * size + [2] * size + [3] * size
    assert got == want
