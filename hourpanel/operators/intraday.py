"""Intraday tracker: gate a correction pack, blend it in, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean, clip, flag

PREDICTION_COLUMNS = ("rt_pred", "y_fused", "y_pred")


@dataclass(frozen=True)
class IntradayPolicy:
    """Gates and weight caps."""

    enabled: bool = True
    min_cutoff_hour: int = 12
    high_weight_cutoff_hour: int = 14
    min_confidence_low: float = 0.35
    min_confidence_high: float = 0.55
    min_observed_hours: int = 3
    max_residual_std: float = 180.0
    low_weight: float = 0.12
    high_weight: float = 0.22
    max_fusion_weight: float = 0.25
    disable_full_day: bool = True


def _number(df: DataFrame, names: Sequence[str], kind: str) -> Column:
    name = next((n for n in names if n in df.columns), None)
    return F.coalesce(clean(name).cast(kind), F.lit(0).cast(kind)) if name else F.lit(0).cast(kind)


def gate(pack: DataFrame, policy: IntradayPolicy = IntradayPolicy(), prediction_mode: str = "INTRADAY") -> DataFrame:
    """Second line of defence over a pack's own decision and weight."""
    pack = pack.withColumns(
        {
            "cutoff_hour": _number(pack, ["cutoff_hour"], "int"),
            "intraday_confidence": _number(pack, ["intraday_confidence"], "double"),
            "fusion_weight": _number(pack, ["fusion_weight"], "double"),
            "n_observed": _number(pack, ["n_observed", "observed_hours"], "int"),
            "residual_std_today": _number(pack, ["residual_std_today"], "double"),
        }
    )
    if not policy.enabled or (policy.disable_full_day and prediction_mode != "INTRADAY"):
        return pack.withColumns({"policy_decision": F.lit("DISABLED"), "fusion_weight": F.lit(0.0)})
    told = F.col("policy_decision")
    weighted = told.isin("LOW_WEIGHT", "HIGH_WEIGHT")
    off = (told == "DISABLED") | (F.col("n_observed") < policy.min_observed_hours)
    if "mode" in pack.columns:
        off = off | ~F.col("mode").eqNullSafe("INTRADAY")
    newly_off = F.lit(False)
    if "mode" in pack.columns:
        newly_off = newly_off | ~F.col("mode").eqNullSafe("INTRADAY")
    newly_off = newly_off | (F.col("n_observed") < policy.min_observed_hours)
    early = F.col("cutoff_hour") < policy.min_cutoff_hour
    shaky = weighted & (
        (F.col("intraday_confidence") < policy.min_confidence_low)
        | (F.col("residual_std_today") > policy.max_residual_std)
    )
    too_high = (F.col("cutoff_hour") < policy.high_weight_cutoff_hour) | (
        F.col("intraday_confidence") < policy.min_confidence_high
    )
    decision = (
        F.when(off, "DISABLED")
        .when(early | shaky, "SHADOW_ONLY")
        .when((told == "HIGH_WEIGHT") & too_high, "LOW_WEIGHT")
        .otherwise(told)
    )
    zeroed = newly_off | ((told != "DISABLED") & (early | shaky))
    pack = pack.withColumns({"_decision": decision, "_zeroed": zeroed})
    weight = (
        F.when(F.col("_zeroed"), F.lit(0.0))
        .when(F.col("_decision") == "LOW_WEIGHT", F.least("fusion_weight", F.lit(policy.low_weight)))
        .otherwise(F.col("fusion_weight"))
    )
    return pack.withColumns(
        {"policy_decision": F.col("_decision"), "fusion_weight": clip(weight, 0.0, policy.max_fusion_weight)}
    ).drop("_decision", "_zeroed")


def apply_pack(
    base: DataFrame,
    pack: DataFrame | None,
    mode: str = "shadow",
    policy: IntradayPolicy = IntradayPolicy(),
    prediction_mode: str = "INTRADAY",
    series: Sequence[str] = (),
) -> DataFrame:
    """Blend gated corrections into every prediction column and add audit columns.

    Modes: ``off``, ``shadow`` (audit only), ``low_weight``, ``high_weight``.
    """
    present = [c for c in PREDICTION_COLUMNS if c in base.columns]
    if not present:
        raise ValueError(f"no prediction column; need one of {PREDICTION_COLUMNS}")
    first = F.col(present[0])
    before = {"rt_pred_before_intraday": first}
    before.update({f"{c}_before_intraday": F.col(c) for c in ("y_fused", "y_pred") if c in present})
    idle = mode == "off" or prediction_mode != "INTRADAY" or pack is None
    if idle:
        joined = base.withColumns(
            {"_corr": F.lit(None).cast("double"), "_dec": F.lit(None).cast("string"), "_w": F.lit(0.0),
             "_conf": F.lit(0.0), "_shadow": F.lit(False), "_reason": F.lit(None).cast("string")}
        )
    else:
        gated = gate(pack, policy, prediction_mode)
        side = gated.select(
            *series,
            F.col("business_day").cast("date").alias("business_day"),
            F.col("target_hour").cast("int").alias("hour_business"),
            F.col("intraday_corrected_pred").cast("double").alias("_corr"),
            F.col("policy_decision").alias("_dec"),
            F.coalesce("fusion_weight", F.lit(0.0)).alias("_w"),
            F.coalesce("intraday_confidence", F.lit(0.0)).alias("_conf"),
            F.coalesce("shadow_only_flag", F.lit(False)).alias("_shadow"),
            F.col("guardrail_reason").alias("_reason"),
        )
        joined = base.withColumn("business_day", F.col("business_day").cast("date")).join(
            side, [*series, "business_day", "hour_business"], "left"
        )
    hit = F.col("_corr").isNotNull()
    applies = F.lit(False)
    if mode in ("low_weight", "high_weight") and not idle:
        applies = hit & ~F.coalesce(F.col("_dec"), F.lit("DISABLED")).isin("DISABLED", "SHADOW_ONLY") & ~F.col("_shadow")
    final = (1 - F.col("_w")) * first + F.col("_w") * F.col("_corr")
    joined = joined.withColumns(
        {
            **before,
            "intraday_available": hit,
            "intraday_applied": F.coalesce(applies, F.lit(False)),
            "intraday_policy_decision": F.when(hit, F.coalesce("_dec", F.lit("DISABLED"))).otherwise("DISABLED"),
            "intraday_fusion_weight": F.when(hit, F.col("_w")).otherwise(0.0),
            "intraday_confidence": F.when(hit, F.col("_conf")).otherwise(0.0),
            "intraday_guardrail_reason": F.coalesce(F.when(hit, F.col("_reason")), F.lit("")),
            "intraday_shadow_pred": F.when(hit, F.col("_corr")),
            "intraday_shadow_delta": F.when(hit, F.col("_corr") - first),
            "_final": final,
        }
    )
    on = F.col("intraday_applied")
    joined = joined.withColumns(
        {
            **{c: F.when(on, F.col("_final")).otherwise(F.col(c)) for c in present},
            **{k.replace("before", "after"): F.when(on, F.col("_final")).otherwise(F.col(k)) for k in before},
            "intraday_prediction_column_updated": on,
            "intraday_updated_columns": F.when(on, F.lit(",".join(present))).otherwise(""),
        }
    )
    return joined.drop("_corr", "_dec", "_w", "_conf", "_shadow", "_reason", "_final")


def apply_stats(applied: DataFrame, mode: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and means of one run; decision counts come from ``value_counts``."""
    hit, on = F.col("intraday_available"), F.col("intraday_applied")
    off = F.col("intraday_policy_decision") == "DISABLED"
    shadow = hit & (F.lit(True) if mode == "shadow" else ~on & ~off)
    disabled = ~hit if mode == "shadow" else ~hit | (~on & off)
    return applied.groupBy(*by).agg(
        F.sum(flag(hit)).alias("matched_rows"),
        F.sum(flag(on)).alias("applied_rows"),
        F.sum(flag(shadow)).alias("shadow_rows"),
        F.sum(flag(disabled)).alias("disabled_rows"),
        F.coalesce(F.avg(F.when(hit, F.col("intraday_fusion_weight"))), F.lit(0.0)).alias("avg_fusion_weight"),
        F.coalesce(F.avg(F.when(hit, F.col("intraday_confidence"))), F.lit(0.0)).alias("avg_confidence"),
    )


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(*by, column).agg(F.count(F.lit(1)).alias("rows"))


def pack_checks(pack: DataFrame, mode: str = "online", by: Sequence[str] = ()) -> DataFrame:
    """Eight pack rules as rows ``check_name, severity, bad_rows, passed``."""
    mid = F.col("cutoff_hour").between(10, 11) & ~F.col("policy_decision").isin("SHADOW_ONLY", "DISABLED")
    conds = [
        ("mode_intraday", "error", ~F.col("mode").eqNullSafe("INTRADAY")),
        ("target_after_cutoff", "error", F.col("target_hour") <= F.col("cutoff_hour")),
        ("cutoff_below_10", "warning", F.col("cutoff_hour") < 10),
        ("cutoff_10_11_not_shadow", "warning", mid),
        ("fusion_weight_range", "error", ~F.coalesce(F.col("fusion_weight"), F.lit(0.0)).between(0.0, 0.3)),
        ("confidence_range", "error", ~F.coalesce(F.col("intraday_confidence"), F.lit(0.0)).between(0.0, 1.0)),
    ]
    if mode == "online":
        conds.append(("no_truth_online", "error", F.col("y_true").isNotNull()))
    key = list(dict.fromkeys([*by, "business_day", "target_hour"]))
    per_key = pack.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(flag(c)).alias(n) for n, _, c in conds]
    )
    total = per_key.groupBy(*by).agg(
        *[F.sum(n).alias(n) for n, _, _ in conds],
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("unique_key"),
    )
    items = [(n, s) for n, s, _ in conds] + [("unique_key", "error")]
    return total.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("severity"), F.col(n).alias("bad_rows"))
                    for n, s in items
                ]
            )
        ).alias("_c"),
    ).select(*by, "_c.*").withColumn("passed", F.col("bad_rows") == 0)
