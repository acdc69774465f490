"""Labels, risk scores, and the upward and downward corrections behind guardrails.

A correction is a chain of column expressions. Parameters enter as columns, so
one code path serves a named profile (literals) and a whole parameter grid
(columns of an exploded grid).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, flag
from . import dedupe, features, metrics, quantile

# Thresholds of labels and flags.
NEGATIVE_PRICE = 0.0
LOW_VALLEY_PRICE = 50.0
LOW_VALLEY_PERCENTILE = 0.10
OVERESTIMATE_GAP = 30.0
SEVERE_GAP = 200.0
RISK_FLAG = 0.8


def add_labels(
    df: DataFrame, series: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred", history: DataFrame | None = None
) -> DataFrame:
    """negative, low_valley (50 or the history's p10 if higher), overestimate_low (null without both values)."""
    limit: Column = F.lit(LOW_VALLEY_PRICE)
    if history is not None:
        p10 = quantile.quantiles(history, series, y_true, {"_p10": LOW_VALLEY_PERCENTILE})
        df = df.join(p10, list(series), "left")
        limit = F.greatest(limit, F.coalesce("_p10", limit))
    t, p = F.col(y_true), F.col(y_pred)
    return df.withColumns(
        {
            "is_negative_price": flag(t < NEGATIVE_PRICE),
            "is_low_valley": flag(t <= limit),
            "is_overestimate_low": (p - t >= OVERESTIMATE_GAP).cast("int"),
        }
    ).drop("_p10")


def spike_label(da: Column, rt: Column, gap: float = 100.0, high: float = 800.0, low: float = -80.0) -> Column:
    """Wide spread or either price beyond its band."""
    return flag((F.abs(rt - da) > gap) | (da > high) | (rt > high) | (da < low) | (rt < low))


def pack_flags(df: DataFrame, y_true: str = "y_true", base: str = "base_fused_pred") -> DataFrame:
    from ..functions import scores

    r = F.col(y_true) - F.col(base)
    return df.withColumns(
        {
            "residual": r,
            "abs_error": F.abs(r),
            "smape_floor50": scores.smape_row("absfloor_capped", y_true, base),
            "high_spike_flag": flag(F.abs(r) > SEVERE_GAP),
            "severe_underestimate_flag": flag(r > SEVERE_GAP),
        }
    )


def heuristic_risk(df: DataFrame, pred: str = "base_fused_pred") -> DataFrame:
    """negative_prob and low_valley_prob from seven weighted, leakage-free factors.

    Expects the rate columns of ``features.low_price_rates`` and optionally
    ``prediction_spread`` and ``renewable_ratio``.
    """
    def have(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)

    h = F.coalesce(F.col("hour_business"), F.lit(12))
    hour = F.when(h.between(1, 8), 0.15).when(h.between(17, 24), 0.10).otherwise(0.05)
    level = clip(1.0 - have(pred) / 200.0, 0.0, 1.0)
    neg = have("recent_negative_rate_by_hour") * 0.30
    low = have("recent_low_price_rate_by_hour") * 0.25
    res = clip(-have("recent_mean_low_residual_by_hour") / 50.0, 0.0, 0.20)
    ren = have("renewable_ratio") * 0.05
    spread = clip(have("prediction_spread") / 100.0, 0.0, 0.05)
    shared = hour * 0.10 + res * 0.15 + ren * 0.10 + spread * 0.05
    return df.withColumns(
        {
            "negative_prob": clip(shared + level * 0.20 + neg * 0.25, 0.0, 1.0),
            "low_valley_prob": clip(shared + level * 0.25 + low * 0.20 + neg * 0.10, 0.0, 1.0),
            "risk_source": F.lit("heuristic_v2"),
        }
    )


RULE_WEIGHTS = {"base": 0.30, "spread": 0.15, "severe_rate": 0.20, "midday": 0.20, "residual": 0.15}


def rule_scores(df: DataFrame, series: Sequence[str]) -> DataFrame:
    """Rule spike score over base_fused_pred, prediction_spread, recent_severe_rate_by_hour,
    recent_mean_residual_by_hour and period; magnitudes are scaled by their own p5-p95."""
    by = list(series)
    df = df.withColumn("_res", F.greatest("recent_mean_residual_by_hour", F.lit(0.0)))
    cols = {"base": "base_fused_pred", "spread": "prediction_spread", "residual": "_res"}
    cuts = {f"_{tag}{n}": (c, q) for tag, c in cols.items() for n, q in (("5", 0.05), ("95", 0.95))}
    df = df.join(quantile.column_quantiles(df, by, cuts), by, "left")

    def scaled(tag: str) -> Column:
        span = F.greatest(F.col(f"_{tag}95") - F.col(f"_{tag}5"), F.lit(1e-10))
        x = clip((F.col(cols[tag]) - F.col(f"_{tag}5")) / span, 0.0, 1.0)
        return F.when(F.col(f"_{tag}95") > F.col(f"_{tag}5"), x).otherwise(0.0) if tag == "residual" else x

    w = RULE_WEIGHTS
    score = (
        w["base"] * scaled("base")
        + w["spread"] * scaled("spread")
        + w["severe_rate"] * F.col("recent_severe_rate_by_hour")
        + w["midday"] * flag(F.col("period") == "9_16")
        + w["residual"] * scaled("residual")
    )
    return df.withColumn("rule_score", clip(score, 0.0, 1.0)).select(*[c for c in df.columns if not c.startswith("_")], "rule_score")


def hybrid_score(ml: Column, rule: Column, ml_weight: float = 0.6) -> Column:
    return clip(ml_weight * ml + (1 - ml_weight) * rule, 0.0, 1.0)


@dataclass(frozen=True)
class SpikeProfile:
    """Defaults of the medium profile. ``relaxed`` is for offline diagnosis."""

    name: str = "medium"
    spike_prob_threshold: float = 0.60
    max_lift_ratio: float = 0.35
    max_absolute_lift: float = 350.0
    protect_normal_hours: bool = True
    period_9_16_boost: float = 1.15
    relaxed: bool = False
    min_lift_floor: float = 0.0
    lift_quantile: float = 0.90

    def columns(self) -> dict[str, Column]:
        p = self
        if self.relaxed and self.min_lift_floor == 0.0:
            p = replace(self, min_lift_floor=30.0)
        return {f.name: F.lit(getattr(p, f.name)) for f in fields(p)}


# Named profiles.
SPIKE_PROFILES = {
    "conservative": SpikeProfile("conservative", 0.75, 0.20, 200.0, True, 1.0),
    "medium": SpikeProfile("medium", 0.60, 0.35, 350.0, True, 1.15),
    "aggressive": SpikeProfile("aggressive", 0.45, 0.60, 600.0, True, 1.30),
}
DEFAULT_LIFT = 50.0
NORMAL_CAP_FACTOR = 1.1
RELAXED_FACTOR = 0.6
RELAXED_RATIO = 0.5
RELAXED_ABSOLUTE = 500.0
OFF_PERIOD_RATIO = 0.7
OFF_PERIOD_ABSOLUTE = 0.6
PRICE_MAX = 1500.0
PRICE_MIN = -200.0


def profiles_from_mapping(config: Mapping[str, Mapping[str, object]]) -> dict[str, SpikeProfile]:
    """Profiles from a parsed YAML or JSON mapping; unknown keys are ignored."""
    known = {f.name for f in fields(SpikeProfile)}
    return {n: SpikeProfile(name=n, **{k: v for k, v in c.items() if k in known and k != "name"}) for n, c in config.items()}


def lift_candidates(history: DataFrame, series: Sequence[str], q: float = 0.90) -> DataFrame:
    """Per period: upper quantile of y_true - base_fused_pred, at least 0 (boost is applied later)."""
    r = F.col("y_true") - F.col("base_fused_pred")
    out = quantile.quantiles(history, [*series, "period"], r, {"lift_candidate": q})
    return out.withColumn("lift_candidate", F.greatest("lift_candidate", F.lit(0.0)))


def downward_candidates(history: DataFrame, series: Sequence[str], q: float = 0.10) -> DataFrame:
    """Per period: lower quantile of y_true - base_fused_pred, at most 0."""
    r = F.col("y_true") - F.col("base_fused_pred")
    out = quantile.quantiles(history, [*series, "period"], r, {"down_candidate": q})
    return out.withColumn("down_candidate", F.least("down_candidate", F.lit(0.0)))


def lift(base: Column, prob: Column, period: Column, candidate: Column, p: Mapping[str, Column]) -> dict[str, Column]:
    """spike_corrected_pred and lift_reason for one row."""
    relaxed = p["relaxed"]
    threshold = p["spike_prob_threshold"] * F.when(relaxed, RELAXED_FACTOR).otherwise(1.0)
    normal_cap = F.when(relaxed, 0.0).otherwise(p["spike_prob_threshold"] * NORMAL_CAP_FACTOR)
    ratio = F.when(relaxed, F.greatest(p["max_lift_ratio"], F.lit(RELAXED_RATIO))).otherwise(p["max_lift_ratio"])
    ceiling = F.when(relaxed, F.greatest(p["max_absolute_lift"], F.lit(RELAXED_ABSOLUTE))).otherwise(p["max_absolute_lift"])
    raw = candidate * F.when(period == "9_16", p["period_9_16_boost"]).otherwise(1.0)
    raw = F.when(relaxed, F.greatest(raw, p["min_lift_floor"])).otherwise(raw)
    capped = F.greatest(F.lit(0.0), F.least(raw, base * ratio, ceiling))
    reason = (
        F.when(prob < threshold, "NO_CORRECTION_LOW_PROB")
        .when(p["protect_normal_hours"] & (period != "9_16") & (prob < normal_cap), "NO_CORRECTION_NORMAL_HOUR")
        .when(capped <= 0, "NO_CORRECTION_LOW_PROB")
        .when(capped < raw, "LIFT_CAPPED")
        .otherwise("LIFT_APPLIED")
    )
    return {
        "spike_corrected_pred": F.when(reason.isin("LIFT_CAPPED", "LIFT_APPLIED"), base + capped).otherwise(base),
        "lift_reason": reason,
    }


def spike_guardrail(base: Column, prob: Column, corrected: Column, period: Column, p: Mapping[str, Column]) -> dict[str, Column]:
    """final_pred and reason_code: reject on negative base, low risk or normal hours, then cap, then bound."""
    relaxed = p["relaxed"]
    mid = period == "9_16"
    least_prob = p["spike_prob_threshold"] * F.when(relaxed, RELAXED_FACTOR).otherwise(1.0)
    normal_cap = F.when(relaxed, 0.0).otherwise(p["spike_prob_threshold"] * NORMAL_CAP_FACTOR)
    off_ratio = p["max_lift_ratio"] * OFF_PERIOD_RATIO
    off_abs = p["max_absolute_lift"] * OFF_PERIOD_ABSOLUTE
    ratio = F.when(mid, p["max_lift_ratio"]).otherwise(F.when(relaxed, off_ratio * 2).otherwise(off_ratio))
    ceiling = F.when(mid, p["max_absolute_lift"]).otherwise(
        F.when(relaxed, F.greatest(off_abs, F.lit(RELAXED_ABSOLUTE))).otherwise(off_abs)
    )
    amount = corrected - base
    allowed = F.greatest(F.lit(0.0), F.least(amount, base * ratio, ceiling))
    clipped = amount > allowed
    reason = (
        F.when(base < 0, "NO_CORRECTION_NEGATIVE_BASE")
        .when(prob < least_prob, "NO_CORRECTION_LOW_PROB")
        .when(p["protect_normal_hours"] & ~mid & (prob < normal_cap), "NO_CORRECTION_NORMAL_HOUR")
        .when(clipped | (corrected > PRICE_MAX) | (corrected < PRICE_MIN), "GUARDRAIL_CLIPPED")
        .otherwise("LIFT_APPLIED")
    )
    final = (
        F.when(reason.startswith("NO_CORRECTION"), base)
        .when(clipped, base + allowed)
        .otherwise(clip(corrected, PRICE_MIN, PRICE_MAX))
    )
    return {"final_pred": final, "reason_code": reason}


def _with_candidates(df: DataFrame, cand: DataFrame | None, series: Sequence[str], column: str, default: Column) -> DataFrame:
    if cand is None:
        return df.withColumn(column, default)
    return df.join(cand, [*series, "period"], "left").withColumn(column, F.coalesce(column, F.lit(0.0)))


def apply_spike(
    df: DataFrame,
    series: Sequence[str],
    candidates: DataFrame | None = None,
    profile: SpikeProfile = SpikeProfile(),
    params: Mapping[str, Column] | None = None,
    strict_fix: bool = False,
) -> DataFrame:
    """High-spike correction of a pack with base_fused_pred, high_spike_prob and period.

    Without fitted candidates 50 is used and the 9_16 boost counts twice, as in
    the compared results; ``strict_fix`` counts it once.
    """
    p = dict(params) if params is not None else profile.columns()
    again = F.lit(1.0) if strict_fix else F.when(F.col("period") == "9_16", p["period_9_16_boost"]).otherwise(1.0)
    df = _with_candidates(df, candidates, series, "lift_candidate", F.lit(DEFAULT_LIFT) * again)
    df = df.withColumns(
        {"_b": F.coalesce("base_fused_pred", F.lit(0.0)), "_p": F.coalesce("high_spike_prob", F.lit(0.0))}
    )
    period = F.col("period")
    df = df.withColumns(lift(F.col("_b"), F.col("_p"), period, F.col("lift_candidate"), p))
    df = df.withColumns(spike_guardrail(F.col("_b"), F.col("_p"), F.col("spike_corrected_pred"), period, p))
    return df.withColumn("lift_applied", F.col("final_pred") - F.col("_b")).drop("_b", "_p", "lift_candidate")


@dataclass(frozen=True)
class NegativeProfile:
    """Defaults of the downward correction."""

    name: str = "default"
    risk_threshold: float = 0.4
    max_downward_ratio: float = 0.15
    max_absolute_downward: float = 20.0
    min_pred_floor: float = -100.0
    protect_9_16: bool = True
    relaxed: bool = False


NEGATIVE_PROFILES = {
    "conservative": NegativeProfile("conservative", 0.5, 0.10, 15.0, -50.0, True),
    "moderate": NegativeProfile("moderate", 0.35, 0.20, 30.0, -100.0, True),
    "aggressive": NegativeProfile("aggressive", 0.25, 0.30, 50.0, -200.0, False),
}
DEFAULT_DOWN = {"1_8": -15.0, "9_16": -5.0, "17_24": -10.0}
# Fixed values: (ratio, absolute) caps of the downward guardrail.
DOWN_CAPS = {"9_16": (0.10, 15.0), "1_8": (0.25, 40.0), "17_24": (0.20, 30.0)}
DOWN_NORMAL_RISK = 0.5
SPIKE_GATE = 0.5
RELAXED_DOWN = -10.0


def downward(base: Column, neg: Column, low: Column, period: Column, candidate: Column, spike_active: Column, p: NegativeProfile) -> dict[str, Column]:
    """negative_corrected_pred and downward_reason by the ordered rules."""
    risk = F.greatest(neg, low)
    mid = period == "9_16"
    raw = F.least(candidate, F.lit(RELAXED_DOWN)) if p.relaxed else candidate
    capped = F.least(F.lit(0.0), F.greatest(raw, -base * p.max_downward_ratio, F.lit(-p.max_absolute_downward)))
    target = F.greatest(base + capped, F.lit(p.min_pred_floor))
    amount = target - base
    shielded = mid & (low < p.risk_threshold * 1.5) if p.protect_9_16 else F.lit(False)
    reason = (
        F.when(spike_active, "DOWNWARD_NO_CORRECTION_HIGH_SPIKE_GATE")
        .when(risk < p.risk_threshold, "DOWNWARD_NO_CORRECTION_LOW_RISK")
        .when(base <= NEGATIVE_PRICE, "DOWNWARD_NO_CORRECTION_ALREADY_LOW")
        .when(shielded | (~mid & (risk < DOWN_NORMAL_RISK)) | (capped >= 0), "DOWNWARD_NO_CORRECTION_LOW_RISK")
        .when(F.abs(amount) < F.abs(raw), "DOWNWARD_CORRECTION_CAPPED")
        .otherwise("DOWNWARD_CORRECTION_APPLIED")
    )
    return {
        "negative_corrected_pred": F.when(reason.startswith("DOWNWARD_CORRECTION"), target).otherwise(base),
        "downward_reason": reason,
    }


def negative_guardrail(base: Column, corrected: Column, period: Column, prob: Column) -> dict[str, Column]:
    """final value and reason: closed while a spike is likely, per-period caps, price floor."""
    ratio, ceiling = F.lit(DOWN_CAPS["17_24"][0]), F.lit(DOWN_CAPS["17_24"][1])
    for name in ("1_8", "9_16"):
        ratio = F.when(period == name, DOWN_CAPS[name][0]).otherwise(ratio)
        ceiling = F.when(period == name, DOWN_CAPS[name][1]).otherwise(ceiling)
    amount = corrected - base
    allowed = -F.least(F.abs(amount), F.abs(base * ratio), ceiling)
    gate = prob > SPIKE_GATE
    final = (
        F.when(gate, base)
        .when(amount >= 0, corrected)
        .when(amount < allowed, base + allowed)
        .otherwise(F.greatest(corrected, F.lit(PRICE_MIN)))
    )
    reason = (
        F.when(gate, "GUARDRAIL_HIGH_SPIKE_GATE")
        .when(amount >= 0, "DOWNWARD_CORRECTION_APPLIED")
        .when((amount < allowed) | (corrected < PRICE_MIN), "GUARDRAIL_CAPPED")
        .otherwise("DOWNWARD_CORRECTION_APPLIED")
    )
    return {"final_pred": final, "negative_reason_code": reason}


def default_down(period: Column) -> Column:
    out = F.lit(0.0)
    for name, v in DEFAULT_DOWN.items():
        out = F.when(period == name, v).otherwise(out)
    return out


def apply_negative(
    df: DataFrame,
    series: Sequence[str],
    candidates: DataFrame | None = None,
    profile: NegativeProfile = NEGATIVE_PROFILES["conservative"],
    base: str = "base_fused_pred",
) -> DataFrame:
    """Downward correction of a pack with negative_prob, low_valley_prob, high_spike_prob and period."""
    df = _with_candidates(df, candidates, series, "down_candidate", default_down(F.col("period")))
    df = df.withColumns(
        {
            "_b": F.coalesce(base, F.lit(0.0)),
            "_n": F.coalesce("negative_prob", F.lit(0.0)),
            "_l": F.coalesce("low_valley_prob", F.lit(0.0)),
            "_p": F.coalesce("high_spike_prob", F.lit(0.0)),
        }
    )
    b, period, prob = F.col("_b"), F.col("period"), F.col("_p")
    df = df.withColumns(downward(b, F.col("_n"), F.col("_l"), period, F.col("down_candidate"), prob > SPIKE_GATE, profile))
    df = df.withColumns(negative_guardrail(b, F.col("negative_corrected_pred"), period, prob))
    return df.withColumn("downward_amount", F.col("final_pred") - b).drop("_b", "_n", "_l", "_p", "down_candidate")


STACK_FLOOR = 0.80


def residual_stack(
    df: DataFrame,
    series: Sequence[str],
    lift_history: DataFrame | None = None,
    with_spike: bool = True,
    with_negative: bool = True,
    spike: SpikeProfile = SpikeProfile(),
    negative: NegativeProfile = NegativeProfile(),
    order: Sequence[str] = (),
    keep: str = "last",
) -> DataFrame:
    """High-spike, then downward, then final guardrail, with reasons and module sequence.

    Of repeated hours the ``keep`` ("first" or "last") row by the ``order`` columns stays; values only break ties.
    An active spike blocks the downward step; the result never falls below a
    lifted value, and outside 9_16 by at most a fifth.
    """
    series = list(series)
    rest = [c for c in df.columns if c not in (*series, "business_day", "hour_business")]
    df = dedupe.keep_one(df, [*series, "business_day", "hour_business"], [*order, *[c for c in rest if c not in order]], last=keep == "last")
    up = lift_candidates(lift_history, series) if lift_history is not None else None
    down = downward_candidates(lift_history, series) if lift_history is not None else None
    base = F.coalesce("base_fused_pred", F.lit(0.0))
    prob = F.coalesce("high_spike_prob", F.lit(0.0))
    if with_spike:
        df = apply_spike(df, series, up, spike)
        df = df.withColumnsRenamed({"final_pred": "after_high_spike_pred", "reason_code": "spike_reason_code"})
        df = df.withColumn("high_spike_applied", F.col("lift_applied") > 0)
    else:
        df = df.withColumns(
            {
                "after_high_spike_pred": base,
                "spike_corrected_pred": base,
                "spike_reason_code": F.lit("no_correction"),
                "lift_applied": F.lit(0.0),
                "high_spike_applied": F.lit(False),
            }
        )
    after, lifted = F.col("after_high_spike_pred"), F.col("high_spike_applied")
    blocked = lifted | (F.col("lift_applied") > 0) | (prob >= SPIKE_GATE)
    if with_negative:
        df = df.withColumn("_blocked", blocked)
        df = apply_negative(df, series, down, negative, base="after_high_spike_pred")
        df = df.withColumn("after_negative_pred", F.when(F.col("_blocked"), after).otherwise(F.col("final_pred")))
        df = df.withColumn("negative_applied", F.col("after_negative_pred") < after)
        df = df.withColumn(
            "negative_reason_code",
            F.when(F.col("_blocked"), "spike_blocks_negative")
            .when(F.col("negative_applied"), "negative_downward")
            .otherwise("negative_blocked_by_guardrail"),
        ).drop("_blocked", "final_pred", "negative_corrected_pred", "downward_reason", "downward_amount")
    else:
        df = df.withColumns(
            {
                "after_negative_pred": after,
                "negative_applied": F.lit(False),
                "negative_reason_code": F.lit("no_correction"),
            }
        )
    x = F.col("after_negative_pred")
    x = F.when(lifted, F.greatest(x, after)).otherwise(x)
    ref = F.when(after == 0, F.lit(1.0)).otherwise(after)
    sunk = ~F.col("hour_business").between(9, 16) & ((ref - x) / F.abs(ref) > 1 - STACK_FLOOR)
    down_on = F.col("negative_applied")
    return df.withColumns(
        {
            "base_pred": F.col("base_fused_pred"),
            "final_pred": F.when(sunk, after * STACK_FLOOR).otherwise(x),
            "correction_reason": F.when(
                ~lifted & ~down_on,
                F.when(F.col("negative_reason_code") == "spike_blocks_negative", "spike_blocks_negative").otherwise("no_correction"),
            ).otherwise(F.concat_ws(" | ", F.when(lifted, "high_spike_lifted"), F.when(down_on, "negative_downward"))),
            "module_sequence": F.concat_ws("→", F.when(lifted, "high_spike"), F.when(down_on, "negative"), F.lit("guardrail")),
        }
    )


def ablation(df: DataFrame, series: Sequence[str], history: DataFrame | None = None) -> DataFrame:
    """Scorecard per config: baseline, spike only, negative only, unified. Every mode runs its own stack."""
    runs = [("baseline", False, False), ("spike_only", True, False), ("negative_only", False, True), ("unified", True, True)]
    keep = [*series, "hour_business", "y_true", "base_pred", "final_pred", "high_spike_applied"]
    out = None
    for name, up, down in runs:
        part = residual_stack(df, series, history, up, down).select(*keep).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return metrics.correction_scorecard(out, [*series, "config"])


# Hard elimination limits and score weights of the grid search.
GRID_FALSE_LIFT = 0.12
GRID_DEGRADATION = 0.5


def param_grid(**values: Sequence[object]) -> Column:
    """Array of structs, one per combination of the given parameter values."""
    import itertools

    names = list(values)
    combos = list(itertools.product(*values.values()))
    return F.array(
        *[F.struct(F.lit(i).alias("combo"), *[F.lit(v).alias(n) for n, v in zip(names, c)]) for i, c in enumerate(combos)]
    )


def grid_search(df: DataFrame, series: Sequence[str], grid: Column, candidates: DataFrame | None = None) -> DataFrame:
    """Every parameter combination in one pass: rows meet the grid as an exploded literal array.

    The rows of one task are aggregated per combination before the shuffle, so
    only combinations x series cross the network. ``best`` marks the lowest
    score among the eligible per series.
    """
    from pyspark.sql import Window as W

    base = SpikeProfile().columns()
    out = df.withColumn("_g", F.explode(grid))
    names = [f.name for f in out.schema["_g"].dataType.fields]
    params = {**base, **{n: F.col(f"_g.{n}") for n in names if n != "combo"}}
    run = apply_spike(out, series, candidates, params=params).select("*", "_g.*").drop("_g")
    card = metrics.spike_scorecard(run, [*series, *names])
    card = card.withColumns(
        {
            "eligible": (F.col("false_lift_rate") <= GRID_FALSE_LIFT) & (F.col("normal_degradation") <= GRID_DEGRADATION),
            "score": F.col("severe") * 1000 + F.col("smape") * 10 + F.col("false_lift_rate") * 100 + F.col("normal_degradation") * 50,
        }
    )
    rank = F.row_number().over(W.partitionBy(*series).orderBy(F.col("eligible").desc(), "score", "combo"))
    return card.withColumn("best", (rank == 1) & F.col("eligible"))


def collapse_risk(points: DataFrame, risk: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest risk score per hour joined to the time points, 0 where absent."""
    top = risk.groupBy(*keys).agg(F.max("spike_risk_score").alias("spike_risk_score"))
    out = points.join(top, list(keys), "left").withColumn("spike_risk_score", F.coalesce("spike_risk_score", F.lit(0.0)))
    return out.withColumns(
        {"high_spike_prob": F.col("spike_risk_score"), "spike_risk_flag": flag(F.col("spike_risk_score") > RISK_FLAG)}
    )


def fallback_risk(df: DataFrame, by: Sequence[str], pred: str = "y_pred") -> DataFrame:
    """Min-max scaled prediction as a stand-in risk score; 0 on a flat table."""
    p = F.coalesce(pred, F.lit(0.0))
    span = df.groupBy(*by).agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    return (
        df.join(span, list(by))
        .withColumn("spike_risk_score", F.when(width > 1e-10, (p - F.col("_lo")) / width).otherwise(0.0))
        .withColumn("spike_risk_flag", flag(F.col("spike_risk_score") > RISK_FLAG))
        .drop("_lo", "_hi")
    )


def push_down(pred: Column, prob: Column) -> Column:
    """Likely negative but not yet low: 100 less; output not below -80."""
    return F.greatest(F.when((prob > 0.6) & (pred > -20), pred - 100).otherwise(pred), F.lit(-80.0))


def expert_flags(space: Column, hour: Column) -> dict[str, Column]:
    return {
        "expert_negative_space": flag(space < 0),
        "expert_noon_high_space": flag(hour.isin(*features.NOON_HOURS) & (space > features.NOON_SPACE)),
    }


def stage_attribution(stages: Mapping[str, DataFrame], truth: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Bucket metrics per stage on keys shared with the truth, with deltas in stage order.

    ``stages`` maps stage name to (keys, y_pred); truth is joined once to the stack.
    """
    from . import reports

    stack = None
    for i, (name, df) in enumerate(stages.items()):
        part = df.select(*keys, "y_pred").withColumns({"stage": F.lit(name), "stage_no": F.lit(i)})
        stack = part if stack is None else stack.unionByName(part)
    marked = metrics.price_buckets(truth.select(*keys, "y_true"), by)
    both = stack.join(marked, list(keys))
    from ..functions import scores

    g = both.groupBy(*by, "stage", "stage_no", "bucket").agg(
        scores.smape("denom_absfloor", "y_true", "y_pred").alias("smape"), F.count(F.lit(1)).alias("rows")
    )
    return reports.stage_deltas(g, [*by, "bucket"], "stage_no", "smape")
