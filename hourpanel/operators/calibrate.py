"""Bias maps, affine calibrators, sample weights and threshold searches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.numeric import clip, flag
from ..session import materialise
from . import features, quantile

# Hour scopes of the bias maps.
HOUR_SCOPES = {"all": None, "risk_915": (9, 10, 15), "risk_extended": (9, 10, 11, 14, 15)}

RESID = "_resid"


def recent_rows(df: DataFrame, series: Sequence[str], days: int) -> DataFrame:
    """Rows of the last ``days`` days of each series."""
    top = df.groupBy(*series).agg(F.max("ds").alias("_top"))
    return df.join(top, list(series)).where(F.col("ds") >= F.col("_top") - F.make_dt_interval(days=F.lit(days))).drop("_top")


def reduce_bias(df: DataFrame, keys: Sequence[str], reducer: str = "median", q: float = 0.5, value: str = RESID) -> DataFrame:
    if reducer == "mean":
        return df.groupBy(*keys).agg(F.avg(value).alias("bias"))
    return quantile.quantiles(df, keys, value, {"bias": q if reducer == "quantile" else 0.5})


def with_bias_keys(df: DataFrame) -> DataFrame:
    """Columns bias maps group by: pred_sign, season."""
    season = F.element_at(F.array(*[F.lit(s) for s in features.SEASONS]), ((F.month("ds") % 12) / 3).cast("int") + 1)
    return df.withColumns({"pred_sign": (F.col("delta_hat") > 0).cast("int"), "season": season})


# Keys of each bias map, beside the series.
BIAS_KEYS = {
    "segment_bias": ("period",),
    "hour_bias": ("hour_business",),
    "segment_hour_bias": ("period", "hour_business"),
    "month_hour_bias": ("season", "hour_business"),
    "segment_sign_bias": ("period", "pred_sign"),
    "segment_hour_sign_bias": ("period", "hour_business", "pred_sign"),
}


def bias_map(val: DataFrame, series: Sequence[str], mode: str, reducer: str = "median", q: float = 0.5, scope: str = "all", segments: Sequence[str] = ()) -> DataFrame:
    """bias per key from a validation frame with delta_target and delta_hat."""
    df = with_bias_keys(val).withColumn(RESID, F.col("delta_target") - F.col("delta_hat"))
    if HOUR_SCOPES[scope]:
        df = df.where(F.col("hour_business").isin(*HOUR_SCOPES[scope]))
    if segments:
        df = df.where(F.col("period").isin(*segments))
    return reduce_bias(df, [*series, *BIAS_KEYS[mode]], reducer, q)


def apply_bias(df: DataFrame, biases: DataFrame, series: Sequence[str], mode: str) -> DataFrame:
    """delta_hat plus its bias (0 where none), rt_hat = da + delta_hat."""
    out = with_bias_keys(df).join(biases, [*series, *BIAS_KEYS[mode]], "left")
    return _shift(out.withColumn("bias", F.coalesce("bias", F.lit(0.0)))).drop("pred_sign", "season")


def _shift(df: DataFrame) -> DataFrame:
    df = df.withColumn("delta_hat", F.col("delta_hat") + F.col("bias"))
    return df.withColumn("rt_hat", F.col("da") + F.col("delta_hat"))


def threshold_bias(val: DataFrame, df: DataFrame, series: Sequence[str], q: float, reducer: str = "median") -> DataFrame:
    """Bias only where the predicted move is large for its segment."""
    keys = [*series, "period"]
    v = val.withColumns({RESID: F.col("delta_target") - F.col("delta_hat"), "_mag": F.abs("delta_hat")})
    cut = quantile.quantiles(v, keys, "_mag", {"_cut": q})
    strong = v.join(cut, keys).where(F.col("_mag") >= F.col("_cut"))
    side = reduce_bias(strong, keys, reducer).join(cut, keys)
    out = df.join(side, keys, "left")
    on = F.abs("delta_hat") >= F.col("_cut")
    return _shift(out.withColumn("bias", F.coalesce(F.when(on, F.col("bias")), F.lit(0.0)))).drop("_cut")


def error_gate_bias(val: DataFrame, df: DataFrame, series: Sequence[str], q: float = 0.8, keys: Sequence[str] = (), reducer: str = "median") -> DataFrame:
    """Bias of the hardest rows, given to rows whose predicted move reaches that error level.

    ``keys``: none, ("pred_sign",) or ("period",).
    """
    v = with_bias_keys(val).withColumn(RESID, F.col("delta_target") - F.col("delta_hat")).withColumn("_abs", F.abs(RESID))
    cut = quantile.quantiles(v, series, "_abs", {"_cut": q})
    hard = v.join(cut, list(series)).where(F.col("_abs") >= F.col("_cut"))
    out = with_bias_keys(df).join(cut, list(series), "left").join(reduce_bias(hard, [*series, *keys], reducer), [*series, *keys], "left")
    on = F.abs("delta_hat") >= F.col("_cut")
    return _shift(out.withColumn("bias", F.coalesce(F.when(on, F.col("bias")), F.lit(0.0)))).drop("_cut", "pred_sign", "season")


MIN_BIAS_ROWS = 5
SPIKE_PRICE = 400.0


def period_bias(val: DataFrame, series: Sequence[str]) -> DataFrame:
    """Median over-prediction per period; periods with under five rows are left alone."""
    out = quantile.quantiles(val, [*series, "period"], F.col("y_pred") - F.col("y_true"), {"bias": 0.5}, counts="_n")
    return out.where(F.col("_n") >= MIN_BIAS_ROWS).drop("_n")


def spike_addon(val: DataFrame, series: Sequence[str], q: float = 0.85) -> DataFrame:
    """Quantile of under-prediction per period over truths above 400."""
    high = val.where(F.col("y_true") > SPIKE_PRICE)
    out = quantile.quantiles(high, [*series, "period"], F.col("y_true") - F.col("y_pred"), {"addon": q}, counts="_n")
    return out.where(F.col("_n") >= MIN_BIAS_ROWS).drop("_n")


def posthoc(df: DataFrame, series: Sequence[str], bias: DataFrame, addon: DataFrame | None = None, prob: str | None = None, threshold: float = 0.5) -> DataFrame:
    keys = [*series, "period"]
    out = df.join(bias, keys, "left")
    shift = -F.coalesce("bias", F.lit(0.0))
    if addon is not None:
        out = out.join(addon, keys, "left")
        on = F.col(prob) > threshold if prob else F.lit(True)
        shift = shift + F.when(on, F.coalesce("addon", F.lit(0.0))).otherwise(0.0)
    return out.withColumn("y_calibrated", F.col("y_pred") + shift).drop("bias", "addon")


# Slope clip and least rows of an affine fit.
AFFINE_CLIP = (0.7, 1.3)
AFFINE_MIN_ROWS = 8


def affine_fit(val: DataFrame, keys: Sequence[str], clip_range: tuple[float, float] = AFFINE_CLIP, min_rows: int = 1) -> DataFrame:
    """slope and intercept of y_true on y_pred per key; the slope is clipped afterwards.

    One grouped pass of mergeable moments. Flat predictions get slope 1 and the
    median gap, small groups the identity.
    """
    med = quantile.quantiles(val, keys, F.col("y_true") - F.col("y_pred"), {"_med": 0.5})
    fit = val.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.stddev_pop("y_pred").alias("_sd"),
        F.regr_slope("y_true", "y_pred").alias("_a"),
        F.regr_intercept("y_true", "y_pred").alias("_b"),
    ).join(med, list(keys))
    flat = F.col("_sd") < 1e-8
    enough = F.col("rows") >= min_rows
    return fit.select(
        *keys,
        "rows",
        F.when(~enough | flat, 1.0).otherwise(clip(F.col("_a"), *clip_range)).alias("slope"),
        F.when(~enough, 0.0).when(flat, F.col("_med")).otherwise(F.col("_b")).alias("intercept"),
    )


def affine_apply(df: DataFrame, fit: DataFrame, keys: Sequence[str], out: str = "y_calibrated") -> DataFrame:
    j = df.join(fit.select(*keys, "slope", "intercept"), list(keys), "left")
    return j.withColumn(
        out, F.col("y_pred") * F.coalesce("slope", F.lit(1.0)) + F.coalesce("intercept", F.lit(0.0))
    ).drop("slope", "intercept")


def stress_mask(solar_ratio: Column, bidding_ratio: Column, space: Column, limits: Sequence[float]) -> Column:
    """Much sun, or little bidding space in relation or absolutely."""
    return (solar_ratio >= limits[0]) | (bidding_ratio <= limits[1]) | (space <= limits[2])


def peak_mask(stress: Column, da: Column, space: Column, solar_ratio: Column, limits: Sequence[float]) -> Column:
    return ~stress & (da >= limits[0]) & (space >= limits[1]) & (solar_ratio <= limits[2])


FOCUS_HOURS = (9, 10, 11, 12, 13, 16)


def regime_weights(stress: Column, peak: Column, hour: Column, peak_weight: float, focus_weight: float) -> dict[str, Column]:
    """Loss weights: peak rows; and focus hours outside both regimes."""
    return {
        "peak_weight": F.when(peak, peak_weight).otherwise(1.0),
        "focus_weight": F.when(~stress & ~peak & hour.isin(*FOCUS_HOURS), focus_weight).otherwise(1.0),
    }


def regime_affine(val: DataFrame, series: Sequence[str], regime: str = "stress") -> DataFrame:
    """Affine fit inside and outside the regime, identity under eight rows."""
    return affine_fit(val, [*series, regime], min_rows=AFFINE_MIN_ROWS)


# Quantiles searched for the day thresholds.
SOLAR_PROBS = (0.60, 0.70, 0.80)
SPACE_PROBS = (0.20, 0.30, 0.40)
DA_PROBS = (0.20, 0.30, 0.40)


def day_table(df: DataFrame, series: Sequence[str], solar: str, space: str, da: str, load: str) -> DataFrame:
    return df.groupBy(*series, "business_day").agg(
        F.avg(solar).alias("solar_mean"),
        (F.max(solar) - F.min(solar)).alias("solar_drop"),
        F.avg(space).alias("bidding_mean"),
        F.min(space).alias("bidding_min"),
        (F.max(space) - F.min(space)).alias("bidding_drop"),
        F.avg(load).alias("load_mean"),
        (F.max(load) - F.min(load)).alias("load_ramp"),
        F.avg(da).alias("da_mean"),
        F.max(da).alias("da_max"),
    )


def spike_day_affine(val: DataFrame, series: Sequence[str], days: DataFrame) -> DataFrame:
    """Best of 27 day rules (much sun, little space, low day-ahead price) with its affine fit.

    ``val`` has y_true and a base-calibrated y_pred per hour. All rules are tried
    in one pass: each row is tagged with the rules its day meets, moments are
    grouped per rule, and the score of a rule is its own rows' error plus the
    untouched error of the rest.
    """
    s, key = list(series), [*series, "business_day"]
    days = materialise(days, "days")
    val = materialise(val, "validation")
    wanted = {
        f"_{tag}{i}": (col, p)
        for col, probs, tag in (("solar_mean", SOLAR_PROBS, "s"), ("bidding_min", SPACE_PROBS, "b"), ("da_mean", DA_PROBS, "d"))
        for i, p in enumerate(probs)
    }
    cuts = quantile.column_quantiles(days, s, wanted)
    rules = F.array(
        *[
            F.struct(F.lit(i * 9 + j * 3 + k).alias("rule"), F.col(f"_s{i}").alias("solar_min"), F.col(f"_b{j}").alias("space_max"), F.col(f"_d{k}").alias("da_max"))
            for i in range(3) for j in range(3) for k in range(3)
        ]
    )
    tagged = days.join(cuts, s).select(*key, "solar_mean", "bidding_min", "da_mean", F.explode(rules).alias("_r")).select("*", "_r.*")
    hit = (F.col("solar_mean") >= F.col("solar_min")) & (F.col("bidding_min") <= F.col("space_max")) & (F.col("da_mean") <= F.col("_r.da_max"))
    sets = tagged.where(hit).select(*key, "rule", "solar_min", "space_max", F.col("_r.da_max").alias("da_limit"))
    n_days = days.groupBy(*s).agg(F.count(F.lit(1)).alias("_days"))
    size = sets.groupBy(*s, "rule").agg(F.count(F.lit(1)).alias("day_count")).join(n_days, s)
    size = size.where((F.col("day_count") >= 2) & (F.col("day_count") < F.col("_days"))).drop("_days")
    rows = val.join(sets.join(size, [*s, "rule"]), key)
    fit = affine_fit(rows, [*s, "rule"]).select(*s, "rule", "slope", "intercept")
    both = rows.join(fit, [*s, "rule"])
    new = F.col("y_pred") * F.col("slope") + F.col("intercept")
    gain = scores.smape_row("floor50", "y_true", new) - scores.smape_row("floor50", "y_true", "y_pred")
    change = both.groupBy(*s, "rule", "day_count", "slope", "intercept", "solar_min", "space_max", "da_limit").agg(
        F.sum(gain).alias("_gain"), F.sum(F.abs(F.col("y_true") - new) - F.abs(F.col("y_true") - F.col("y_pred"))).alias("_dmae"),
        F.count(F.lit(1)).alias("hour_count"),
    )
    base = val.groupBy(*s).agg(
        F.sum(scores.smape_row("floor50", "y_true", "y_pred")).alias("_sum"), F.sum(F.abs(F.col("y_true") - F.col("y_pred"))).alias("_mae"), F.count(F.lit(1)).alias("_n")
    )
    scored = change.join(base, s).withColumns(
        {"smape": (F.col("_sum") + F.col("_gain")) / F.col("_n"), "mae": (F.col("_mae") + F.col("_dmae")) / F.col("_n")}
    )
    rank = F.row_number().over(W.partitionBy(*s).orderBy("smape", "mae", "day_count", "rule"))
    return scored.withColumn("_k", rank).where("_k = 1").drop("_k", "_gain", "_dmae", "_sum", "_mae", "_n")


def choose_calibrator(val: DataFrame, series: Sequence[str], candidates: Mapping[str, str]) -> DataFrame:
    """Lowest sMAPE among calibrated columns (name -> column), first listed on ties."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("_o"), F.lit(n).alias("calibrator"), F.col(c).alias("_v")) for i, (n, c) in enumerate(candidates.items())]
    )
    g = (
        val.select(*series, "y_true", F.explode(cells).alias("_c"))
        .groupBy(*series, "_c._o", "_c.calibrator")
        .agg(scores.smape("floor50", F.col("y_true"), F.col("_c._v")).alias("smape"))
    )
    rank = F.row_number().over(W.partitionBy(*series).orderBy("smape", "_o"))
    return g.withColumn("chosen", rank == 1).drop("_o")


WEIGHT_PROFILES = ("none", "spike_weighted", "severe_underestimate_weighted", "period_spike_weighted", "low_price")


def price_weights(df: DataFrame, series: Sequence[str], y: str = "y_true", profiles: Mapping[str, str] | None = None) -> DataFrame:
    """Training weights from quantiles of the training window; ``{column: profile}``.

    Profiles: none, spike_weighted, severe_underestimate_weighted,
    period_spike_weighted, low_price (2 below 50, 5 below 0, 3 in the top
    twentieth, half more in 9_16). Quantiles are computed once for all.
    """
    profiles = dict(profiles or {"weight": "spike_weighted"})
    bad = [p for p in profiles.values() if p not in WEIGHT_PROFILES]
    if bad:
        raise ValueError(f"unknown weight profiles {bad}; known: {WEIGHT_PROFILES}")
    q = quantile.quantiles(df, series, y, {"_p90": 0.90, "_p95": 0.95})
    v, mid = F.col(y), F.col("hour_business").between(9, 16)
    spike = v > F.greatest("_p90", F.lit(150.0))
    severe = v > F.greatest("_p95", F.lit(250.0))
    low = F.when(v > F.col("_p95"), 3.0).when(v < 0, 5.0).when(v < 50, 2.0).otherwise(1.0)
    exprs = {
        "none": F.lit(1.0),
        "spike_weighted": F.when(spike & mid, 6.0).when(spike, 3.0).otherwise(1.0),
        "severe_underestimate_weighted": F.when(severe, 4.0).otherwise(1.0),
        "period_spike_weighted": F.when(spike & mid, 8.0).when(spike, 3.0).otherwise(1.0),
        "low_price": low * F.when(mid, 1.5).otherwise(1.0),
    }
    return df.join(q, list(series)).withColumns({c: exprs[p] for c, p in profiles.items()}).drop("_p90", "_p95")


def tail_weights(df: DataFrame, series: Sequence[str], tail: float, q: float, primary: Mapping[str, object], secondary: Mapping[str, object]) -> DataFrame:
    """Multiply weights for large deltas and for two sets of risk hours ({hours, weight, segments})."""
    cut = quantile.quantiles(df, series, F.abs("delta_target"), {"_cut": q})
    out = df.join(cut, list(series))
    w = F.when(F.abs("delta_target") >= F.col("_cut"), tail).otherwise(1.0)
    for rule in (primary, secondary):
        hit = F.col("hour_business").isin(*rule["hours"])
        if rule.get("segments"):
            hit = hit & F.col("period").isin(*rule["segments"])
        w = w * F.when(hit, float(rule["weight"])).otherwise(1.0)
    return out.withColumn("weight", w).drop("_cut")


def gray_zone_search(
    df: DataFrame,
    series: Sequence[str],
    lows: Sequence[float],
    highs: Sequence[float],
    minimum: Mapping[str, float],
    prob: str = "prob",
    label: str = "label",
) -> DataFrame:
    """Best (low, high) pair: rows outside are certain; constraints on precision, recall, coverage.

    Recall counts misses inside the certain zone only. Probabilities are reduced
    to one row per distinct interval between grid points first, so the grid is
    crossed with a table of fixed size.
    """
    edges = sorted(set([*lows, *highs]))
    p = F.col(prob)
    cell = sum((flag(p > e) for e in edges), F.lit(0)) * 2 + sum((flag(p == e) for e in edges), F.lit(0))
    cells = df.groupBy(*series, cell.alias("_cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"), F.min(p).alias("lo"), F.max(p).alias("hi")
    )
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("gray_low"), F.lit(float(b)).alias("gray_high")) for a in lows for b in highs if a < b])
    g = cells.withColumn("_g", F.explode(pairs)).select("*", "_g.*")
    up, down = F.col("lo") >= F.col("gray_high"), F.col("hi") <= F.col("gray_low")

    def total(cond, c):
        return F.sum(F.when(cond, F.col(c)).otherwise(0))

    m = g.groupBy(*series, "gray_low", "gray_high").agg(
        total(up, "pos").alias("tp"), (total(up, "n") - total(up, "pos")).alias("fp"), total(down, "pos").alias("fn"),
        total(up | down, "n").alias("certain"), F.sum("n").alias("n"), F.sum("pos").alias("pos"),
    )

    def ratio(a, b):
        return F.when(b != 0, a / b).otherwise(0.0)

    m = m.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "coverage": ratio(F.col("certain"), F.col("n")),
            "positive_coverage": ratio(F.col("tp"), F.col("pos")),
        }
    )
    ok = F.col("certain") > 0
    for c in ("precision", "recall", "coverage", "positive_coverage"):
        ok = ok & (F.col(c) >= minimum.get(c, 0.0))
    rank = F.row_number().over(
        W.partitionBy(*series).orderBy(
            F.col("precision").desc(), F.col("positive_coverage").desc(), F.col("coverage").desc(),
            (F.col("gray_high") - F.col("gray_low")), "gray_low", "gray_high",
        )
    )
    return m.where(ok).withColumn("_k", rank).where("_k = 1").select(
        *series, "gray_low", "gray_high", "precision", "recall", "coverage", "positive_coverage"
    )


def smooth_thresholds(
    days: DataFrame, series: Sequence[str], low0: float, high0: float, max_delta: float, alpha: float,
    low_range: tuple[float, float], high_range: tuple[float, float], min_gap: float = 0.05,
) -> DataFrame:
    """Daily thresholds limited to +-max_delta per day, smoothed, bounded, kept apart.

    Each day depends on the day before, so the days of a series (one element
    each, found thresholds or null) are folded over in order.
    """
    step = F.struct("business_day", F.col("gray_low").alias("a"), F.col("gray_high").alias("b"))
    arr = days.groupBy(*series).agg(F.array_sort(F.collect_list(step)).alias("_days"))
    state = "struct<business_day:date,a:double,b:double>"

    def move(x, prev):
        c = F.least(F.greatest(x, prev - max_delta), prev + max_delta)
        return F.lit(alpha) * c + F.lit(1 - alpha) * prev

    def bound(x, r):
        return F.least(F.greatest(x, F.lit(r[0])), F.lit(r[1]))

    def fold(acc, d):
        last = F.element_at(acc, -1)
        a, b = bound(move(d["a"], last["a"]), low_range), bound(move(d["b"], last["b"]), high_range)
        near = b - a < min_gap
        b2 = F.when(near, F.least(F.lit(high_range[1]), a + min_gap)).otherwise(b)
        a2 = F.when(near & (b2 - a < min_gap), F.greatest(F.lit(low_range[0]), b2 - min_gap)).otherwise(a)
        known = d["a"].isNotNull()
        nxt = F.struct(
            d["business_day"].alias("business_day"),
            F.when(known, F.round(a2, 4)).otherwise(last["a"]).alias("a"),
            F.when(known, F.round(b2, 4)).otherwise(last["b"]).alias("b"),
        ).cast(state)
        return F.concat(acc, F.array(nxt))

    seed = F.array(F.struct(F.lit(None).cast("date").alias("business_day"), F.lit(float(low0)).alias("a"), F.lit(float(high0)).alias("b")).cast(state))
    out = arr.select(*series, F.explode(F.slice(F.aggregate("_days", seed, fold), 2, 2147483646)).alias("_d"))
    return out.select(*series, "_d.business_day", F.col("_d.a").alias("gray_low"), F.col("_d.b").alias("gray_high"))


def best_fbeta(df: DataFrame, series: Sequence[str], thresholds: Sequence[float], beta: float = 2.0, prob: str = "prob", label: str = "label") -> DataFrame:
    """Threshold of a grid with the best F-beta, the lowest on ties; counts only cross the network."""
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold")) for t in thresholds])
    hit, pos = F.col(prob) >= F.col("_t.threshold"), F.col(label) == 1
    g = df.withColumn("_t", F.explode(cells)).groupBy(*series, F.col("_t.threshold").alias("threshold")).agg(
        F.sum(flag(hit & pos)).alias("tp"), F.sum(flag(hit & ~pos)).alias("fp"), F.sum(flag(~hit & pos)).alias("fn")
    )
    one = F.lit(1)
    g = g.withColumns(
        {
            "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one),
            "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one),
        }
    )
    b2 = beta * beta
    f = (1 + b2) * F.col("precision") * F.col("recall") / F.greatest(b2 * F.col("precision") + F.col("recall"), F.lit(1e-10))
    rank = F.row_number().over(W.partitionBy(*series).orderBy(F.col("fbeta").desc(), "threshold"))
    return g.withColumn("fbeta", f).withColumn("_k", rank).where("_k = 1").drop("_k")


def best_recall_at_precision(df: DataFrame, series: Sequence[str], min_precision: float, prob: str = "prob", label: str = "label") -> DataFrame:
    """Threshold with the highest recall among those precise enough, else the most precise one.

    The whole precision-recall curve comes from distributed running counts over
    the distinct probabilities. A series without positive labels has null recall.
    """
    curve = quantile.cumulative_counts(df, series, prob, {"n": F.count(F.lit(1)), "pos": F.sum(label)}, descending=True)
    curve = curve.withColumns({"precision": F.col("cum_pos") / F.col("cum_n"), "recall": F.col("cum_pos") / F.nullif(F.col("all_pos"), F.lit(0))})
    ok = F.col("precision") >= min_precision
    point = F.struct(F.col(prob).alias("threshold"), "precision", "recall")
    best = curve.groupBy(*series).agg(
        F.max_by(point, F.when(ok, F.struct("recall", -F.col(prob)))).alias("_ok"),
        F.max_by(point, F.struct("precision", -F.col(prob))).alias("_any"),
    )
    return best.select(*series, F.coalesce("_ok", "_any").alias("_p"), F.col("_ok").isNotNull().alias("reached")).select(*series, "_p.*", "reached")


def cascade(p1: Column, p2: Column, low: Column, high: Column, t2: float) -> Column:
    """Certain above high, certain not below low, second model between."""
    return F.when(p1 > high, 1).when(p1 < low, 0).otherwise(flag(p2 > t2))


def alarm_counts(df: DataFrame, by: Sequence[str], pred: str = "final_pred", label: str = "label") -> DataFrame:
    hit, pos = F.col(pred) == 1, F.col(label) == 1
    return df.groupBy(*by).agg(
        F.sum(flag(hit & pos)).alias("correct_alarms"),
        F.sum(flag(~hit & pos)).alias("missed_alarms"),
        F.sum(flag(hit & ~pos)).alias("false_alarms"),
        F.sum(label).alias("total_extremes"),
    )
