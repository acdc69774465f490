"""Labels, risk, events, corrections and calibration queries."""

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import asof, calibrate, corrections, dedupe, events, features, metrics, reports
from .queries_metrics import SMAPE_SQL, smape_sql
from .registry import query

S = ["series_id"]


def pack(t):
    """Correction pack: base prediction, truth, spike probability, negative risks."""
    m = t.stored_market.select(
        "series_id", "business_day", "hour_business", "period", "ds", F.col("rt").alias("y_true"),
        F.col("da").alias("base_fused_pred"), F.least(F.lit(1.0), F.col("high_spike_prob") * 4).alias("high_spike_prob"),
        F.col("wind_forecast"), F.col("solar_forecast"), F.col("load_forecast"),
    )
    return m.withColumns(
        {
            "negative_prob": F.greatest(F.lit(0.0), F.lit(0.6) - F.col("base_fused_pred") / 200),
            "low_valley_prob": F.greatest(F.lit(0.0), F.lit(0.7) - F.col("base_fused_pred") / 200),
        }
    )


PACK = """pk AS (SELECT series_id, business_day, hour_business, period, ds, rt AS y_true, da AS b, least(1.0::DOUBLE, high_spike_prob * 4) AS p, wind_forecast, solar_forecast, load_forecast,
  greatest(0.0::DOUBLE, 0.6::DOUBLE - da / 200) AS np, greatest(0.0::DOUBLE, 0.7::DOUBLE - da / 200) AS lp FROM market),
hist AS (SELECT * FROM pk WHERE business_day <= DATE '2024-01-15')"""


def history(t):
    return pack(t).where(F.col("business_day") <= F.lit("2024-01-15").cast("date"))


@query(
    "price_labels",
    "series_id:i ds:t is_negative_price:i is_low_valley:i is_overestimate_low:i spike_label:i",
    """SELECT p.series_id, ds, CAST(y_true < 0 AS INT) AS is_negative_price, CAST(y_true <= greatest(50, q) AS INT) AS is_low_valley, CAST(b - y_true >= 30 AS INT) AS is_overestimate_low,
       CAST(abs(y_true - b) > 100 OR b > 800 OR y_true > 800 OR b < -80 OR y_true < -80 AS INT) AS spike_label
       FROM pk p JOIN (SELECT series_id, quantile_cont(y_true, 0.1) AS q FROM hist GROUP BY ALL) h ON p.series_id = h.series_id""",
    PACK,
)
def _(t):
    df = corrections.add_labels(pack(t), S, "y_true", "base_fused_pred", history(t))
    return df.withColumn("spike_label", corrections.spike_label(F.col("base_fused_pred"), F.col("y_true")))


@query(
    "pack_flags",
    "series_id:i ds:t residual:d abs_error:d smape_floor50:d high_spike_flag:i severe_underestimate_flag:i",
    f"""SELECT series_id, ds, y_true - b AS residual, abs(y_true - b) AS abs_error, {SMAPE_SQL['absfloor_capped'].format(t='y_true', p='b')} AS smape_floor50,
       CAST(abs(y_true - b) > 200 AS INT) AS high_spike_flag, CAST(y_true - b > 200 AS INT) AS severe_underestimate_flag FROM pk""",
    PACK,
)
def _(t):
    return corrections.pack_flags(pack(t))


@query(
    "heuristic_negative_risk",
    "series_id:i ds:t negative_prob:d low_valley_prob:d",
    """SELECT series_id, ds, least(greatest(sh + lv * 0.2 + rn * 0.3 * 0.25, 0), 1) AS negative_prob, least(greatest(sh + lv * 0.25 + rl * 0.25 * 0.2 + rn * 0.3 * 0.1, 0), 1) AS low_valley_prob FROM (
       SELECT p.series_id, p.ds, coalesce(h.rn, 0) AS rn, coalesce(h.rl, 0) AS rl, least(greatest(1 - p.b / 200, 0), 1) AS lv,
         CASE WHEN p.hour_business <= 8 THEN 0.15 WHEN p.hour_business >= 17 THEN 0.1 ELSE 0.05 END * 0.1 + least(greatest(-coalesce(h.rr, 0) / 50, 0), 0.2) * 0.15
         + least(greatest((wind_forecast + solar_forecast) * 1.01379135792 / load_forecast, 0), 2) * 0.05 * 0.1 AS sh
       FROM pk p LEFT JOIN (SELECT series_id, hour_business, avg(CAST(b < 0 AS DOUBLE)) AS rn, avg(CAST(b <= 50 AS DOUBLE)) AS rl, avg(y_true - b) FILTER (y_true <= 50) AS rr FROM hist GROUP BY ALL) h
       ON p.series_id = h.series_id AND p.hour_business = h.hour_business)""",
    PACK,
)
def _(t):
    df = features.low_price_rates(pack(t).drop("negative_prob", "low_valley_prob"), history(t), S)
    ratio = F.least(F.greatest((F.col("wind_forecast") + F.col("solar_forecast")) * 1.01379135792 / F.col("load_forecast"), F.lit(0.0)), F.lit(2.0))
    return corrections.heuristic_risk(df.withColumn("renewable_ratio", ratio))


@query(
    "rule_spike_scores",
    "series_id:i ds:t rule_score:d hybrid:d",
    """SELECT series_id, ds, rule_score, least(greatest(0.6 * p + 0.4 * rule_score, 0), 1) AS hybrid FROM (
       SELECT x.series_id, ds, p, least(greatest(0.3 * least(greatest((b - b5) / greatest(b95 - b5, 1e-10), 0), 1) + 0.15 * least(greatest((sp - s5) / greatest(s95 - s5, 1e-10), 0), 1)
         + 0.2 * sev + 0.2 * CAST(period = '9_16' AS INT) + 0.15 * CASE WHEN r95 > r5 THEN least(greatest((res - r5) / (r95 - r5), 0), 1) ELSE 0 END, 0), 1) AS rule_score
       FROM x JOIN (SELECT series_id, quantile_cont(b, 0.05) AS b5, quantile_cont(b, 0.95) AS b95, quantile_cont(sp, 0.05) AS s5, quantile_cont(sp, 0.95) AS s95,
         quantile_cont(res, 0.05) AS r5, quantile_cont(res, 0.95) AS r95 FROM x GROUP BY ALL) q ON x.series_id = q.series_id)""",
    PACK + """, x AS (SELECT series_id, ds, period, b, p, load_forecast / 10 AS sp, coalesce(avg(CAST(y_true - b > 200 AS DOUBLE)) OVER w, 0) AS sev, greatest(coalesce(avg(y_true - b) OVER w, 0), 0) AS res
       FROM pk WINDOW w AS (PARTITION BY series_id, hour_business ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))""",
)
def _(t):
    from ..operators.rowblocks import RowBlocks, rolling

    df = corrections.pack_flags(pack(t)).withColumn("prediction_spread", F.col("load_forecast") / 10)
    rb = RowBlocks(df, ["series_id", "hour_business"], before=7, bucket=F.trunc("ds", "month"))
    zero = F.lit(0.0)
    df = rb.add(
        {
            "recent_severe_rate_by_hour": F.coalesce(rolling(rb, "severe_underestimate_flag", 7, min_rows=1, shift=1), zero),
            "recent_mean_residual_by_hour": F.coalesce(rolling(rb, "residual", 7, min_rows=1, shift=1), zero),
        }
    )
    df = corrections.rule_scores(df, S)
    return df.withColumn("hybrid", corrections.hybrid_score(F.col("high_spike_prob"), F.col("rule_score")))


LIMITS = """lim AS (SELECT series_id, period, quantile_cont(rt, 0.95) AS hi, quantile_cont(rt, 0.05) AS lo, quantile_cont(abs(rt - da), 0.95) AS sp FROM market GROUP BY ALL),
ev2 AS (SELECT m.series_id, m.ds, m.period, m.rt, unnest([CASE WHEN rt > hi THEN {'e': 'high_spike', 'th': round(hi, 2), 'v': round(rt, 2)} END,
   CASE WHEN rt < lo THEN {'e': 'low_valley', 'th': round(lo, 2), 'v': round(rt, 2)} END, CASE WHEN abs(rt - da) > sp THEN {'e': 'spread_extreme', 'th': round(sp, 2), 'v': round(abs(rt - da), 2)} END]) AS x
   FROM market m JOIN lim l ON m.series_id = l.series_id AND m.period = l.period)"""


def event_rows(t):
    m = t.stored_market
    limits = events.event_thresholds(m, ["series_id", "period"], "rt", "da")
    return events.detect_events(m, limits, ["series_id", "period"], "rt", "da")


@query("event_thresholds", "series_id:i period:s high_spike:d low_valley:d spread_extreme:d", "SELECT series_id, period, hi AS high_spike, lo AS low_valley, sp AS spread_extreme FROM lim", LIMITS)
def _(t):
    return events.event_thresholds(t.stored_market, ["series_id", "period"], "rt", "da")


@query("extreme_events", "series_id:i ds:t event_type:s threshold:d value:d", "SELECT series_id, ds, x.e AS event_type, x.th AS threshold, x.v AS value FROM ev2 WHERE x IS NOT NULL", LIMITS)
def _(t):
    return event_rows(t)


@query(
    "residual_events",
    "series_id:i ds:t event_type:s threshold:d value:d",
    """SELECT * FROM (SELECT m.series_id, ds, 'residual_underestimate' AS event_type, round(u, 2) AS threshold, round(rt - da, 2) AS value FROM market m JOIN q ON m.series_id = q.series_id WHERE rt - da > u
       UNION ALL SELECT m.series_id, ds, 'residual_overestimate', round(o, 2), round(-(rt - da), 2) FROM market m JOIN q ON m.series_id = q.series_id WHERE -(rt - da) > o)""",
    "q AS (SELECT series_id, quantile_cont(rt - da, 0.9) AS u, quantile_cont(-(rt - da), 0.9) AS o FROM market GROUP BY ALL)",
)
def _(t):
    return events.residual_events(t.stored_market, S, "rt", "da")


@query(
    "monthly_spike_summary",
    "series_id:i month:s event_count:i avg_price:d max_price:d n_9_16:i p9_16_ratio:d",
    """SELECT series_id, strftime(ds, '%Y-%m') AS month, count(*) AS event_count, avg(rt) AS avg_price, max(rt) AS max_price, count(*) FILTER (period = '9_16') AS n_9_16,
       count(*) FILTER (period = '9_16') / count(*) AS p9_16_ratio FROM ev2 WHERE x.e = 'high_spike' GROUP BY ALL""",
    LIMITS,
)
def _(t):
    return events.monthly_spikes(event_rows(t), S, "rt")


@query(
    "period_event_summary",
    "series_id:i period:s total_events:i high_spike:i low_valley:i spread_extreme:i avg_true_price:d",
    """SELECT series_id, period, count(*) AS total_events, count(*) FILTER (x.e = 'high_spike') AS high_spike, count(*) FILTER (x.e = 'low_valley') AS low_valley,
       count(*) FILTER (x.e = 'spread_extreme') AS spread_extreme, avg(rt) AS avg_true_price FROM ev2 WHERE x IS NOT NULL GROUP BY ALL""",
    LIMITS,
)
def _(t):
    return events.period_events(event_rows(t), S, "rt")


REGIME = """rg AS (SELECT m.*, CASE WHEN rt > q90 THEN 'extreme_high' WHEN rt > q75 THEN 'high' WHEN rt >= q25 THEN 'normal' WHEN rt >= q10 THEN 'low' ELSE 'extreme_low' END AS regime FROM market m JOIN (
   SELECT series_id, quantile_cont(rt, 0.1) AS q10, quantile_cont(rt, 0.25) AS q25, quantile_cont(rt, 0.75) AS q75, quantile_cont(rt, 0.9) AS q90 FROM market GROUP BY ALL) q ON m.series_id = q.series_id)"""


@query(
    "regime_performance",
    "series_id:i regime:s count:i smape:d mae:d price_mean:d price_std:d",
    f"SELECT series_id, regime, count(*) AS count, {smape_sql('regime', 'rt', 'da')} AS smape, avg(abs(rt - da)) AS mae, avg(rt) AS price_mean, stddev_samp(rt) AS price_std FROM rg GROUP BY ALL",
    REGIME,
)
def _(t):
    return events.regime_performance(events.classify_regime(t.stored_market, S, "rt"), S, "rt", "da")


@query(
    "worst_cases",
    "series_id:i ds:t gap:d",
    "SELECT series_id, ds, abs(rt - da) AS gap FROM market ORDER BY gap DESC, series_id, ds LIMIT 100",
)
def _(t):
    return events.worst_cases(t.stored_market.withColumn("gap", F.abs(F.col("rt") - F.col("da"))), "gap", 100, ["series_id", "ds"])


@query(
    "latest_rows_per_cutoff",
    "series_id:i hour_business:i ds:t rt:d",
    "SELECT series_id, hour_business, ds, rt FROM (SELECT *, row_number() OVER (PARTITION BY series_id, hour_business ORDER BY ds DESC) AS r FROM market) WHERE r <= 3",
)
def _(t):
    return events.latest_rows(t.stored_market, ["series_id", "hour_business"], 3)


def lift_sql(cand, thr, ratio, cap, boost, src="pk"):
    """Lift and guardrail in SQL: columns spike_corrected, final, reason, lift."""
    return f"""(SELECT *, fin - b AS lift FROM (SELECT *, CASE WHEN reason LIKE 'NO_%' THEN b WHEN amt > alw THEN b + alw ELSE least(greatest(sc, -200), 1500) END AS fin FROM (
      SELECT *, CASE WHEN b < 0 THEN 'NO_CORRECTION_NEGATIVE_BASE' WHEN p < {thr} THEN 'NO_CORRECTION_LOW_PROB' WHEN period != '9_16' AND p < {thr} * 1.1::DOUBLE THEN 'NO_CORRECTION_NORMAL_HOUR'
        WHEN amt > alw OR sc > 1500 OR sc < -200 THEN 'GUARDRAIL_CLIPPED' ELSE 'LIFT_APPLIED' END AS reason FROM (
      SELECT *, sc - b AS amt, greatest(0, least(sc - b, b * CASE WHEN period = '9_16' THEN {ratio} ELSE {ratio} * 0.7::DOUBLE END, CASE WHEN period = '9_16' THEN {cap} ELSE {cap} * 0.6::DOUBLE END)) AS alw FROM (
      SELECT *, CASE WHEN lift_reason IN ('LIFT_CAPPED', 'LIFT_APPLIED') THEN b + capped ELSE b END AS sc FROM (
      SELECT *, CASE WHEN p < {thr} THEN 'NO_CORRECTION_LOW_PROB' WHEN period != '9_16' AND p < {thr} * 1.1::DOUBLE THEN 'NO_CORRECTION_NORMAL_HOUR' WHEN capped <= 0 THEN 'NO_CORRECTION_LOW_PROB'
        WHEN capped < raw THEN 'LIFT_CAPPED' ELSE 'LIFT_APPLIED' END AS lift_reason FROM (
      SELECT *, greatest(0, least(raw, b * {ratio}, {cap})) AS capped FROM (
      SELECT *, {cand} * CASE WHEN period = '9_16' THEN {boost} ELSE 1.0 END AS raw FROM {src}))))))))"""


@query(
    "lift_candidates",
    "series_id:i period:s lift_candidate:d down_candidate:d",
    "SELECT series_id, period, greatest(0, quantile_cont(y_true - b, 0.9)) AS lift_candidate, least(0, quantile_cont(y_true - b, 0.1)) AS down_candidate FROM hist GROUP BY ALL",
    PACK,
)
def _(t):
    h = history(t)
    return corrections.lift_candidates(h, S).join(corrections.downward_candidates(h, S), ["series_id", "period"])


FITTED = ", pf AS (SELECT p.*, coalesce(q.c, 0) AS c, coalesce(q.d, 0) AS d FROM pk p LEFT JOIN (SELECT series_id, period, greatest(0, quantile_cont(y_true - b, 0.9)) AS c, least(0, quantile_cont(y_true - b, 0.1)) AS d FROM hist GROUP BY ALL) q ON p.series_id = q.series_id AND p.period = q.period)"
SPIKE_SPEC = "profile:s series_id:i ds:t spike_corrected_pred:d final_pred:d lift_applied:d reason_code:s lift_reason:s"


@query(
    "spike_correction_profiles",
    SPIKE_SPEC,
    "SELECT profile, series_id, ds, sc AS spike_corrected_pred, fin AS final_pred, lift AS lift_applied, reason AS reason_code, lift_reason FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS profile, * FROM {lift_sql('c', f'{v[0]}::DOUBLE', f'{v[1]}::DOUBLE', f'{v[2]}::DOUBLE', f'{v[3]}::DOUBLE', 'pf')}"
        for n, v in {"conservative": (0.75, 0.2, 200, 1.0), "medium": (0.6, 0.35, 350, 1.15), "aggressive": (0.45, 0.6, 600, 1.3)}.items()
    ) + ")",
    PACK + FITTED,
)
def _(t):
    cand = corrections.lift_candidates(history(t), S)
    out = None
    for name, prof in corrections.SPIKE_PROFILES.items():
        one = corrections.apply_spike(pack(t), S, cand, prof).withColumn("profile", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "spike_correction_defaults",
    "series_id:i ds:t final_pred:d reason_code:s",
    f"SELECT series_id, ds, fin AS final_pred, reason AS reason_code FROM {lift_sql('CASE WHEN period = ' + chr(39) + '9_16' + chr(39) + ' THEN 57.5::DOUBLE ELSE 50.0::DOUBLE END', '0.6::DOUBLE', '0.35::DOUBLE', '350.0::DOUBLE', '1.15::DOUBLE')}",
    PACK,
)
def _(t):
    return corrections.apply_spike(pack(t), S)


def down_sql(cand, thr, ratio, cap, floor, protect, base="b", src="pf", gate="p > 0.5"):
    shield = f"(period = '9_16' AND lp < {thr} * 1.5::DOUBLE) OR" if protect else ""
    return f"""(SELECT *, CASE WHEN p > 0.5 THEN {base} WHEN am >= 0 THEN nc WHEN am < al THEN {base} + al ELSE greatest(nc, -200) END AS nfin,
      CASE WHEN p > 0.5 THEN 'GUARDRAIL_HIGH_SPIKE_GATE' WHEN am >= 0 THEN 'DOWNWARD_CORRECTION_APPLIED' WHEN am < al OR nc < -200 THEN 'GUARDRAIL_CAPPED' ELSE 'DOWNWARD_CORRECTION_APPLIED' END AS nreason FROM (
      SELECT *, nc - {base} AS am, -least(abs(nc - {base}), abs({base} * CASE period WHEN '9_16' THEN 0.1::DOUBLE WHEN '1_8' THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END), CASE period WHEN '9_16' THEN 15.0 WHEN '1_8' THEN 40.0 ELSE 30.0 END) AS al FROM (
      SELECT *, CASE WHEN dreason LIKE 'DOWNWARD_CORRECTION%' THEN tg ELSE {base} END AS nc FROM (
      SELECT *, CASE WHEN {gate} THEN 'DOWNWARD_NO_CORRECTION_HIGH_SPIKE_GATE' WHEN greatest(np, lp) < {thr} THEN 'DOWNWARD_NO_CORRECTION_LOW_RISK' WHEN {base} <= 0 THEN 'DOWNWARD_NO_CORRECTION_ALREADY_LOW'
        WHEN {shield} (period != '9_16' AND greatest(np, lp) < 0.5) OR cd >= 0 THEN 'DOWNWARD_NO_CORRECTION_LOW_RISK' WHEN abs(tg - {base}) < abs({cand}) THEN 'DOWNWARD_CORRECTION_CAPPED' ELSE 'DOWNWARD_CORRECTION_APPLIED' END AS dreason FROM (
      SELECT *, greatest({base} + cd, {floor}) AS tg FROM (SELECT *, least(0, greatest({cand}, -{base} * {ratio}, -{cap})) AS cd FROM {src}))))))"""


@query(
    "negative_correction_profiles",
    "profile:s series_id:i ds:t negative_corrected_pred:d final_pred:d downward_reason:s negative_reason_code:s",
    "SELECT profile, series_id, ds, nc AS negative_corrected_pred, nfin AS final_pred, dreason AS downward_reason, nreason AS negative_reason_code FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS profile, * FROM {down_sql('d', f'{v[0]}::DOUBLE', f'{v[1]}::DOUBLE', f'{v[2]}::DOUBLE', f'{v[3]}::DOUBLE', v[4])}"
        for n, v in {"conservative": (0.5, 0.1, 15.0, -50.0, True), "moderate": (0.35, 0.2, 30.0, -100.0, True), "aggressive": (0.25, 0.3, 50.0, -200.0, False)}.items()
    ) + ")",
    PACK + FITTED,
)
def _(t):
    cand = corrections.downward_candidates(history(t), S)
    out = None
    for name, prof in corrections.NEGATIVE_PROFILES.items():
        one = corrections.apply_negative(pack(t), S, cand, prof).withColumn("profile", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


STACK = (
    PACK
    + ", st0 AS (SELECT *, fin AS af, lift > 0 AS up, CASE period WHEN '1_8' THEN -15.0 WHEN '9_16' THEN -5.0 ELSE -10.0 END::DOUBLE AS d FROM "
    + lift_sql("CASE WHEN period = '9_16' THEN 57.5::DOUBLE ELSE 50.0::DOUBLE END", "0.6::DOUBLE", "0.35::DOUBLE", "350.0::DOUBLE", "1.15::DOUBLE")
    + "), st1 AS (SELECT *, CASE WHEN up OR p >= 0.5 THEN af ELSE nfin END AS an FROM "
    + down_sql("d", "0.4::DOUBLE", "0.15::DOUBLE", "20.0::DOUBLE", "-100.0::DOUBLE", True, base="af", src="st0")
    + """), st AS (SELECT *, CASE WHEN hour_business NOT BETWEEN 9 AND 16 AND (rf - x) / abs(rf) > 1 - 0.8::DOUBLE THEN af * 0.8::DOUBLE ELSE x END AS final_pred FROM (
      SELECT *, CASE WHEN up THEN greatest(an, af) ELSE an END AS x, CASE WHEN af = 0 THEN 1 ELSE af END AS rf, an < af AS dn FROM st1))"""
)


@query(
    "residual_stack",
    "series_id:i ds:t after_high_spike_pred:d after_negative_pred:d final_pred:d high_spike_applied:b negative_applied:b negative_reason_code:s correction_reason:s module_sequence:s",
    """SELECT series_id, ds, af AS after_high_spike_pred, an AS after_negative_pred, final_pred, up AS high_spike_applied, dn AS negative_applied,
       CASE WHEN up OR p >= 0.5 THEN 'spike_blocks_negative' WHEN dn THEN 'negative_downward' ELSE 'negative_blocked_by_guardrail' END AS negative_reason_code,
       CASE WHEN NOT up AND NOT dn THEN CASE WHEN p >= 0.5 THEN 'spike_blocks_negative' ELSE 'no_correction' END ELSE concat_ws(' | ', CASE WHEN up THEN 'high_spike_lifted' END, CASE WHEN dn THEN 'negative_downward' END) END AS correction_reason,
       concat_ws('→', CASE WHEN up THEN 'high_spike' END, CASE WHEN dn THEN 'negative' END, 'guardrail') AS module_sequence FROM st""",
    STACK,
)
def _(t):
    return corrections.residual_stack(pack(t), S)


def ablation_part(config, up, down):
    """One config of the ablation in SQL: b, final, up-flag per row."""
    lifted = lift_sql("c", "0.6::DOUBLE", "0.35::DOUBLE", "350.0::DOUBLE", "1.15::DOUBLE", "pf") if up else "(SELECT *, b AS fin, 0.0::DOUBLE AS lift FROM pf)"
    src = f"(SELECT *, fin AS af, lift > 0 AS up FROM {lifted})"
    low = f"(SELECT *, CASE WHEN up OR p >= 0.5 THEN af ELSE nfin END AS an FROM {down_sql('d', '0.4::DOUBLE', '0.15::DOUBLE', '20.0::DOUBLE', '-100.0::DOUBLE', True, base='af', src=src)})" if down else f"(SELECT *, af AS an FROM {src})"
    return f"""SELECT '{config}' AS config, series_id, hour_business, y_true, b, up, CASE WHEN hour_business NOT BETWEEN 9 AND 16 AND (rf - x) / abs(rf) > 1 - 0.8::DOUBLE THEN af * 0.8::DOUBLE ELSE x END AS fp FROM (
      SELECT *, CASE WHEN up THEN greatest(an, af) ELSE an END AS x, CASE WHEN af = 0 THEN 1 ELSE af END AS rf FROM {low})"""


@query(
    "stack_ablation",
    "series_id:i config:s smape_before:d smape_after:d negative_mae_improvement:d low_valley_mae_improvement:d normal_degradation:d false_lift_rate:d",
    f"""SELECT *, CASE WHEN nb > 0 THEN round((nb - na) / nb * 100, 2) ELSE 0 END AS negative_mae_improvement, CASE WHEN lb > 0 THEN round((lb - la) / lb * 100, 2) ELSE 0 END AS low_valley_mae_improvement, round(n1 - n0, 4) AS normal_degradation,
       CASE WHEN k > 0 THEN round(1 - good, 4) ELSE 0 END AS false_lift_rate FROM (SELECT series_id, config, {smape_sql('denom50', 'y_true', 'b')} AS smape_before, {smape_sql('denom50', 'y_true', 'fp')} AS smape_after,
       avg(abs(y_true - b)) FILTER (y_true < 0) AS nb, avg(abs(y_true - fp)) FILTER (y_true < 0) AS na, avg(abs(y_true - b)) FILTER (y_true <= 50) AS lb, avg(abs(y_true - fp)) FILTER (y_true <= 50) AS la,
       {smape_sql('denom50', 'y_true', 'b', 'hour_business NOT BETWEEN 9 AND 16')} AS n0, {smape_sql('denom50', 'y_true', 'fp', 'hour_business NOT BETWEEN 9 AND 16')} AS n1, count(*) FILTER (up) AS k, avg(CAST(fp > y_true AS DOUBLE)) FILTER (up) AS good FROM abl GROUP BY ALL)""",
    PACK + FITTED + ", abl AS (" + " UNION ALL ".join(ablation_part(*c) for c in (("baseline", False, False), ("spike_only", True, False), ("negative_only", False, True), ("unified", True, True))) + ")",
)
def _(t):
    return corrections.ablation(pack(t), S, history(t))


@query(
    "stack_unified_scorecard",
    "series_id:i smape_before:d smape_after:d negative_count:i low_valley_count:i negative_miss_after:i",
    f"""SELECT series_id, {smape_sql('denom50', 'y_true', 'b')} AS smape_before, {smape_sql('denom50', 'y_true', 'final_pred')} AS smape_after, count(*) FILTER (y_true < 0) AS negative_count,
       count(*) FILTER (y_true <= 50) AS low_valley_count, count(*) FILTER (y_true < 0 AND final_pred >= 0) AS negative_miss_after FROM st GROUP BY ALL""",
    STACK,
)
def _(t):
    return metrics.correction_scorecard(corrections.residual_stack(pack(t), S), S)


@query(
    "parameter_grid_search",
    "series_id:i combo:i spike_prob_threshold:d max_lift_ratio:d smape:d severe:i false_lift_rate:d normal_degradation:d lift_applied_count:i eligible:b score:d best:b",
    f"""SELECT *, eligible AND row_number() OVER (PARTITION BY series_id ORDER BY eligible DESC, score, combo) = 1 AS best FROM (
       SELECT *, false_lift_rate <= 0.12 AND normal_degradation <= 0.5 AS eligible, severe * 1000 + smape * 10 + false_lift_rate * 100 + normal_degradation * 50 AS score FROM (
       SELECT series_id, combo, thr AS spike_prob_threshold, ratio AS max_lift_ratio, {smape_sql('raw_capped', 'y_true', 'fin')} AS smape, count(*) FILTER (y_true - fin > 200) AS severe,
         count(*) FILTER (hs = 0 AND fin > b AND lift > 0) / greatest(count(*) FILTER (hs = 0), 1) AS false_lift_rate,
         {smape_sql('raw_capped', 'y_true', 'fin', "period != '9_16'")} - {smape_sql('raw_capped', 'y_true', 'b', "period != '9_16'")} AS normal_degradation, count(*) FILTER (lift > 0) AS lift_applied_count
       FROM {lift_sql('c', 'thr', 'ratio', '350.0::DOUBLE', 'boost', 'gr')} GROUP BY ALL))""",
    PACK + FITTED + """, gr AS (SELECT pf.*, CAST(abs(y_true - b) > 200 AS INT) AS hs, g.* FROM pf, (SELECT row_number() OVER (ORDER BY a.thr, b2.ratio, c2.boost) - 1 AS combo, a.thr, b2.ratio, c2.boost FROM (VALUES (0.45::DOUBLE), (0.55), (0.6)) a(thr),
       (VALUES (0.25::DOUBLE), (0.35)) b2(ratio), (VALUES (1.0::DOUBLE), (1.3)) c2(boost)) g)""",
)
def _(t):
    grid = corrections.param_grid(spike_prob_threshold=[0.45, 0.55, 0.60], max_lift_ratio=[0.25, 0.35], period_9_16_boost=[1.0, 1.30])
    df = corrections.pack_flags(pack(t))
    return corrections.grid_search(df, S, grid, corrections.lift_candidates(history(t), S))


@query(
    "risk_collapse",
    "series_id:i ds:t high_spike_prob:d spike_risk_flag:i",
    "SELECT m.series_id, m.ds, coalesce(r, 0) AS high_spike_prob, CAST(coalesce(r, 0) > 0.8 AS INT) AS spike_risk_flag FROM market m LEFT JOIN (SELECT series_id, ds, max(y_pred / 100) AS r FROM panel WHERE model_name != 'view' GROUP BY ALL) x ON m.series_id = x.series_id AND m.ds = x.ds",
)
def _(t):
    risk = t.panel.where("model_name != 'view'").select("series_id", "ds", (F.col("y_pred") / 100).alias("spike_risk_score"))
    return corrections.collapse_risk(t.stored_market.drop("high_spike_prob"), risk, ["series_id", "ds"])


@query(
    "fallback_risk",
    "series_id:i ds:t spike_risk_score:d spike_risk_flag:i",
    "SELECT *, CAST(spike_risk_score > 0.8 AS INT) AS spike_risk_flag FROM (SELECT series_id, ds, (da - min(da) OVER (PARTITION BY series_id)) / (max(da) OVER (PARTITION BY series_id) - min(da) OVER (PARTITION BY series_id)) AS spike_risk_score FROM market)",
)
def _(t):
    return corrections.fallback_risk(t.stored_market, S, "da")


@query(
    "push_down_and_expert_flags",
    "series_id:i ds:t pushed:d expert_negative_space:i expert_noon_high_space:i",
    """SELECT series_id, ds, greatest(CASE WHEN p > 0.6 AND b > -20 THEN b - 100 ELSE b END, -80) AS pushed, CAST(b < 0 AS INT) AS expert_negative_space,
       CAST(hour_business IN (11, 12, 13, 14) AND b * 100 > 23000 AS INT) AS expert_noon_high_space FROM pk""",
    PACK,
)
def _(t):
    df = pack(t)
    flags = corrections.expert_flags(F.col("base_fused_pred") * 100, F.col("hour_business"))
    flags["expert_negative_space"] = corrections.expert_flags(F.col("base_fused_pred"), F.col("hour_business"))["expert_negative_space"]
    return df.withColumns({"pushed": corrections.push_down(F.col("base_fused_pred"), F.col("high_spike_prob")), **flags})


@query(
    "stage_attribution",
    "series_id:i stage:s bucket:s smape:d rows:i delta:d",
    f"""SELECT series_id, stage, bucket, smape, rows, smape - lag(smape) OVER (PARTITION BY series_id, bucket ORDER BY no) AS delta FROM (
       SELECT b.series_id, no, stage, bucket, {smape_sql('denom_absfloor', 'b.rt', 's.y_pred')} AS smape, count(*) AS rows FROM bk b JOIN (
         SELECT series_id, ds, 0 AS no, 'day_ahead' AS stage, da AS y_pred FROM market UNION ALL SELECT series_id, ds, 1, 'blend', 0.5 * da + 60 FROM market UNION ALL SELECT series_id, ds, 2, 'risk', 0.5 * da + 60 + high_spike_prob * 50 FROM market) s
       ON b.series_id = s.series_id AND b.ds = s.ds GROUP BY ALL)""",
    """bk AS (SELECT m.series_id, m.ds, rt, CASE WHEN rt <= 0 THEN 'negative' WHEN rt >= q THEN 'spike' ELSE 'normal' END AS bucket FROM market m JOIN (SELECT series_id, quantile_cont(rt, 0.95) AS q FROM market GROUP BY ALL) q ON m.series_id = q.series_id)""",
)
def _(t):
    m = t.stored_market
    blend = 0.5 * F.col("da") + 60
    stages = {
        "day_ahead": m.withColumn("y_pred", F.col("da")),
        "blend": m.withColumn("y_pred", blend),
        "risk": m.withColumn("y_pred", blend + F.col("high_spike_prob") * 50),
    }
    return corrections.stage_attribution(stages, m.withColumn("y_true", F.col("rt")), ["series_id", "ds"], S)


def scored(t):
    m = t.stored_market
    return m.select(
        "series_id", "business_day", "hour_business", "period", "ds", "da", F.col("rt").alias("rt_actual"),
        (F.col("rt") - F.col("da")).alias("delta_target"), (F.col("high_spike_prob") * 300 - 20).alias("delta_hat"),
    )


SCORED = "sc AS (SELECT series_id, business_day, hour_business, period, ds, da, rt - da AS dt, high_spike_prob * 300 - 20 AS dh FROM market), vl AS (SELECT * FROM sc WHERE business_day <= DATE '2024-01-20')"


def val(t):
    return scored(t).where(F.col("business_day") <= F.lit("2024-01-20").cast("date"))


BIAS_COLS = {"segment_bias": "period", "hour_bias": "hour_business", "segment_hour_bias": "period, hour_business", "segment_sign_bias": "period, dh > 0", "segment_hour_sign_bias": "period, hour_business, dh > 0"}


@query(
    "bias_calibration",
    "mode:s series_id:i period:s rows:i bias_sum:d rt_hat_sum:d",
    " UNION ALL ".join(
        f"SELECT '{m}' AS mode, s.series_id, s.period, count(*) AS rows, sum(coalesce(b.q, 0)) AS bias_sum, sum(s.da + s.dh + coalesce(b.q, 0)) AS rt_hat_sum FROM sc s LEFT JOIN (SELECT series_id, {', '.join(f'{c} AS k{i}' for i, c in enumerate(k.split(', ')))}, median(dt - dh) AS q FROM vl GROUP BY ALL) b ON s.series_id = b.series_id AND "
        + " AND ".join(f"({'s.' + c}) = b.k{i}" for i, c in enumerate(k.split(", ")))
        + " GROUP BY ALL"
        for m, k in BIAS_COLS.items()
    ),
    SCORED,
)
def _(t):
    out = None
    for mode in BIAS_COLS:
        adj = calibrate.apply_bias(scored(t), calibrate.bias_map(val(t), S, mode), S, mode)
        g = adj.groupBy("series_id", "period").agg(F.count(F.lit(1)).alias("rows"), F.sum("bias").alias("bias_sum"), F.sum("rt_hat").alias("rt_hat_sum"))
        g = g.withColumn("mode", F.lit(mode))
        out = g if out is None else out.unionByName(g)
    return out


@query(
    "bias_reducers",
    "series_id:i season:s hour_business:i mean_bias:d q70_bias:d",
    "SELECT series_id, 'winter' AS season, hour_business, avg(dt - dh) AS mean_bias, quantile_cont(dt - dh, 0.7) AS q70_bias FROM vl WHERE hour_business IN (9, 10, 11, 14, 15) AND ds >= (SELECT max(ds) FROM vl) - INTERVAL 20 DAY GROUP BY ALL",
    SCORED,
)
def _(t):
    v = calibrate.recent_rows(val(t), S, 20)
    a = calibrate.bias_map(v, S, "month_hour_bias", "mean", scope="risk_extended").withColumnRenamed("bias", "mean_bias")
    b = calibrate.bias_map(v, S, "month_hour_bias", "quantile", 0.7, "risk_extended").withColumnRenamed("bias", "q70_bias")
    return a.join(b, ["series_id", "season", "hour_business"])


@query(
    "threshold_bias",
    "series_id:i ds:t bias:d rt_hat:d",
    """SELECT s.series_id, s.ds, CASE WHEN abs(dh) >= cut THEN q ELSE 0 END AS bias, da + dh + CASE WHEN abs(dh) >= cut THEN q ELSE 0 END AS rt_hat FROM sc s JOIN (
       SELECT v.series_id, v.period, any_value(cut) AS cut, median(dt - dh) AS q FROM vl v JOIN (SELECT series_id, period, quantile_cont(abs(dh), 0.6) AS cut FROM vl GROUP BY ALL) c ON v.series_id = c.series_id AND v.period = c.period WHERE abs(dh) >= cut GROUP BY ALL) b
       ON s.series_id = b.series_id AND s.period = b.period""",
    SCORED,
)
def _(t):
    return calibrate.threshold_bias(val(t), scored(t), S, 0.6)


@query(
    "error_gate_bias",
    "series_id:i ds:t bias:d",
    """SELECT s.series_id, s.ds, CASE WHEN abs(dh) >= cut THEN coalesce(q, 0) ELSE 0 END AS bias FROM sc s JOIN (SELECT series_id, quantile_cont(abs(dt - dh), 0.3) AS cut FROM vl GROUP BY ALL) c ON s.series_id = c.series_id
       LEFT JOIN (SELECT v.series_id, period, median(dt - dh) AS q FROM vl v JOIN (SELECT series_id, quantile_cont(abs(dt - dh), 0.3) AS cut FROM vl GROUP BY ALL) c ON v.series_id = c.series_id WHERE abs(dt - dh) >= cut GROUP BY ALL) b
       ON s.series_id = b.series_id AND s.period = b.period""",
    SCORED,
)
def _(t):
    return calibrate.error_gate_bias(val(t), scored(t), S, 0.3, ["period"])


@query(
    "posthoc_calibration",
    "series_id:i ds:t y_calibrated:d",
    """SELECT m.series_id, m.ds, da - coalesce(b.q, 0) + CASE WHEN high_spike_prob > 0.1 THEN coalesce(a.q, 0) ELSE 0 END AS y_calibrated FROM market m
       LEFT JOIN (SELECT series_id, period, median(da - rt) AS q FROM market WHERE business_day <= DATE '2024-01-20' GROUP BY ALL HAVING count(*) >= 5) b ON m.series_id = b.series_id AND m.period = b.period
       LEFT JOIN (SELECT series_id, period, quantile_cont(rt - da, 0.85) AS q FROM market WHERE business_day <= DATE '2024-01-20' AND rt > 400 GROUP BY ALL HAVING count(*) >= 5) a ON m.series_id = a.series_id AND m.period = a.period""",
)
def _(t):
    df = t.stored_market.withColumns({"y_true": F.col("rt"), "y_pred": F.col("da")})
    v = df.where(F.col("business_day") <= F.lit("2024-01-20").cast("date"))
    return calibrate.posthoc(df, S, calibrate.period_bias(v, S), calibrate.spike_addon(v, S), "high_spike_prob", 0.1)


def regime_frame(t):
    m = t.stored_market.withColumns({"y_true": F.col("rt"), "y_pred": F.col("da")})
    sr, br = F.col("solar_forecast") / F.col("load_forecast"), F.col("wind_forecast") / F.col("load_forecast")
    stress = calibrate.stress_mask(sr, br, F.col("load_forecast"), (0.4, 0.02, 100.0))
    return m.withColumns({"stress": stress, "peak": calibrate.peak_mask(stress, F.col("da"), F.col("load_forecast"), sr, (150.0, 150.0, 0.3))})


REGAFF = """rf AS (SELECT *, st AS stress, NOT st AND da >= 150 AND load_forecast >= 150 AND solar_forecast / load_forecast <= 0.3 AS peak FROM (SELECT *, solar_forecast / load_forecast >= 0.4 OR wind_forecast / load_forecast <= 0.02 OR load_forecast <= 100 AS st FROM market))"""


@query(
    "regime_affine",
    "series_id:i stress:b rows:i slope:d intercept:d",
    """SELECT series_id, stress, count(*) AS rows, CASE WHEN count(*) < 8 THEN 1 ELSE least(greatest(regr_slope(rt, da), 0.7), 1.3) END AS slope, CASE WHEN count(*) < 8 THEN 0 ELSE regr_intercept(rt, da) END AS intercept FROM rf GROUP BY ALL""",
    REGAFF,
)
def _(t):
    return calibrate.regime_affine(regime_frame(t), S)


@query(
    "affine_calibration",
    "series_id:i ds:t y_calibrated:d",
    """SELECT m.series_id, m.ds, da * a + b AS y_calibrated FROM market m JOIN (SELECT series_id, least(greatest(regr_slope(rt, da), 0.7), 1.3) AS a, regr_intercept(rt, da) AS b FROM market WHERE business_day <= DATE '2024-01-20' GROUP BY ALL) f ON m.series_id = f.series_id""",
)
def _(t):
    df = t.stored_market.withColumns({"y_true": F.col("rt"), "y_pred": F.col("da")})
    v = df.where(F.col("business_day") <= F.lit("2024-01-20").cast("date"))
    return calibrate.affine_apply(df, calibrate.affine_fit(v, S), S)


@query(
    "regime_loss_weights",
    "series_id:i ds:t peak_weight:d focus_weight:d",
    "SELECT series_id, ds, CASE WHEN peak THEN 2.5 ELSE 1 END AS peak_weight, CASE WHEN NOT stress AND NOT peak AND hour_business IN (9, 10, 11, 12, 13, 16) THEN 1.5 ELSE 1 END AS focus_weight FROM rf",
    REGAFF,
)
def _(t):
    df = regime_frame(t)
    return df.withColumns(calibrate.regime_weights(F.col("stress"), F.col("peak"), F.col("hour_business"), 2.5, 1.5))


@query("spike_day_affine", "series_id:i rule:i day_count:i hour_count:i slope:d intercept:d smape:d mae:d", None)
def _(t):
    m = regime_frame(t)
    days = calibrate.day_table(m, S, "solar_forecast", "load_forecast", "da", "load_forecast")
    return calibrate.spike_day_affine(m, S, days)


@query(
    "calibrator_choice",
    "series_id:i calibrator:s smape:d chosen:b",
    f"""SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY smape, o) = 1 AS chosen FROM (SELECT series_id, 0 AS o, 'none' AS calibrator, {smape_sql('floor50', 'rt', 'da')} AS smape FROM market GROUP BY ALL
       UNION ALL SELECT series_id, 1, 'half', {smape_sql('floor50', 'rt', '(da * 0.5 + 40)')} FROM market GROUP BY ALL)""",
)
def _(t):
    df = t.stored_market.select("series_id", F.col("rt").alias("y_true"), "da", (F.col("da") * 0.5 + 40).alias("half"))
    return calibrate.choose_calibrator(df, S, {"none": "da", "half": "half"})


@query(
    "training_weights",
    "series_id:i ds:t spike:d severe:d period_spike:d low:d",
    """SELECT m.series_id, ds, CASE WHEN rt > greatest(q90, 150) AND mid THEN 6 WHEN rt > greatest(q90, 150) THEN 3 ELSE 1 END AS spike, CASE WHEN rt > greatest(q95, 250) THEN 4 ELSE 1 END AS severe,
       CASE WHEN rt > greatest(q90, 150) AND mid THEN 8 WHEN rt > greatest(q90, 150) THEN 3 ELSE 1 END AS period_spike,
       CASE WHEN rt > q95 THEN 3 WHEN rt < 0 THEN 5 WHEN rt < 50 THEN 2 ELSE 1 END * CASE WHEN mid THEN 1.5 ELSE 1 END AS low
       FROM (SELECT *, hour_business BETWEEN 9 AND 16 AS mid FROM market) m JOIN (SELECT series_id, quantile_cont(rt, 0.9) AS q90, quantile_cont(rt, 0.95) AS q95 FROM market GROUP BY ALL) q ON m.series_id = q.series_id""",
)
def _(t):
    profiles = {"spike": "spike_weighted", "severe": "severe_underestimate_weighted", "period_spike": "period_spike_weighted", "low": "low_price"}
    return calibrate.price_weights(t.stored_market, S, "rt", profiles)


@query(
    "tail_weights",
    "series_id:i ds:t weight:d",
    """SELECT s.series_id, ds, CASE WHEN abs(dt) >= q THEN 2.0 ELSE 1 END * CASE WHEN hour_business IN (9, 10) AND period = '9_16' THEN 1.8 ELSE 1 END * CASE WHEN hour_business IN (15, 18) THEN 1.3 ELSE 1 END AS weight
       FROM sc s JOIN (SELECT series_id, quantile_cont(abs(dt), 0.9) AS q FROM sc GROUP BY ALL) q ON s.series_id = q.series_id""",
    SCORED,
)
def _(t):
    return calibrate.tail_weights(scored(t), S, 2.0, 0.9, {"hours": (9, 10), "weight": 1.8, "segments": ["9_16"]}, {"hours": (15, 18), "weight": 1.3})


LOWS, HIGHS = (0.05, 0.1, 0.15, 0.2), (0.25, 0.3, 0.4, 0.5)
PROBS = "pb AS (SELECT series_id, ds, business_day, high_spike_prob AS p, CAST(rt > 180 AS INT) AS y FROM market)"


def probs(t):
    return t.stored_market.select("series_id", "ds", "business_day", F.col("high_spike_prob").alias("prob"), (F.col("rt") > 180).cast("int").alias("label"))


@query(
    "gray_zone_thresholds",
    "series_id:i gray_low:d gray_high:d precision:d recall:d coverage:d positive_coverage:d",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY precision DESC, positive_coverage DESC, coverage DESC, gray_high - gray_low, gray_low, gray_high) AS k FROM (
       SELECT series_id, gray_low, gray_high, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, c / n AS coverage, tp / pos AS positive_coverage FROM (
       SELECT series_id, gray_low, gray_high, count(*) FILTER (p >= gray_high AND y = 1) AS tp, count(*) FILTER (p >= gray_high AND y = 0) AS fp, count(*) FILTER (p <= gray_low AND y = 1) AS fn,
         count(*) FILTER (p <= gray_low OR p >= gray_high) AS c, count(*) AS n, sum(y) AS pos FROM pb, (VALUES {', '.join(f'({v}::DOUBLE)' for v in LOWS)}) l(gray_low), (VALUES {', '.join(f'({v}::DOUBLE)' for v in HIGHS)}) h(gray_high) GROUP BY ALL))
       WHERE coverage >= 0.3 AND recall >= 0.02 AND precision >= 0.1) WHERE k = 1""",
    PROBS,
)
def _(t):
    return calibrate.gray_zone_search(probs(t), S, LOWS, HIGHS, {"coverage": 0.3, "recall": 0.02, "precision": 0.1})


SMOOTH = f"""dg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, business_day ORDER BY precision DESC, positive_coverage DESC, coverage DESC, gray_high - gray_low, gray_low, gray_high) AS k FROM (
       SELECT series_id, business_day, gray_low, gray_high, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, c / n AS coverage, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS positive_coverage FROM (
       SELECT series_id, business_day, gray_low, gray_high, count(*) FILTER (p >= gray_high AND y = 1) AS tp, count(*) FILTER (p >= gray_high AND y = 0) AS fp, count(*) FILTER (p <= gray_low OR p >= gray_high) AS c, count(*) AS n, sum(y) AS pos
         FROM pb, (VALUES {', '.join(f'({v}::DOUBLE)' for v in LOWS)}) l(gray_low), (VALUES {', '.join(f'({v}::DOUBLE)' for v in HIGHS)}) h(gray_high) GROUP BY ALL)) WHERE coverage >= 0.2) WHERE k = 1),
dn AS (SELECT d.series_id, d.business_day, g.gray_low AS a, g.gray_high AS b, row_number() OVER (PARTITION BY d.series_id ORDER BY d.business_day) AS i FROM (SELECT DISTINCT series_id, business_day FROM pb) d LEFT JOIN dg g ON d.series_id = g.series_id AND d.business_day = g.business_day),
sm AS (SELECT DISTINCT series_id, CAST(NULL AS DATE) AS business_day, 0::BIGINT AS i, 0.1::DOUBLE AS lo, 0.3::DOUBLE AS hi FROM dn
  UNION ALL BY STEP
  SELECT s.series_id, d.business_day, d.i, CASE WHEN d.a IS NULL THEN s.lo ELSE round(z.a2, 4) END, CASE WHEN d.a IS NULL THEN s.hi ELSE round(z.b2, 4) END FROM sm s JOIN dn d ON d.series_id = s.series_id AND d.i = s.i + 1,
    LATERAL (SELECT least(greatest(0.4 * least(greatest(d.a, s.lo - 0.05), s.lo + 0.05) + (1 - 0.4::DOUBLE) * s.lo, 0.02), 0.25) AS a1, least(greatest(0.4 * least(greatest(d.b, s.hi - 0.05), s.hi + 0.05) + (1 - 0.4::DOUBLE) * s.hi, 0.22), 0.6) AS b1) x,
    LATERAL (SELECT CASE WHEN x.b1 - x.a1 < 0.05 THEN least(0.6, x.a1 + 0.05) ELSE x.b1 END AS b2, x.a1, x.b1) y, LATERAL (SELECT y.b2, CASE WHEN y.b1 - y.a1 < 0.05 AND y.b2 - y.a1 < 0.05 THEN greatest(0.02, y.b2 - 0.05) ELSE y.a1 END AS a2) z)"""


@query("smoothed_thresholds", "series_id:i business_day:t gray_low:d gray_high:d", "SELECT series_id, business_day, lo AS gray_low, hi AS gray_high FROM sm WHERE i > 0", f"{PROBS}, {SMOOTH}")
def _(t):
    daily = calibrate.gray_zone_search(probs(t), ["series_id", "business_day"], LOWS, HIGHS, {"coverage": 0.2})
    days = probs(t).select("series_id", "business_day").distinct().join(daily, ["series_id", "business_day"], "left")
    return calibrate.smooth_thresholds(days, S, 0.1, 0.3, 0.05, 0.4, (0.02, 0.25), (0.22, 0.6))


TH = tuple(round(0.05 + 0.025 * i, 3) for i in range(24))


@query(
    "best_fbeta_threshold",
    "series_id:i threshold:d recall:d precision:d fbeta:d tp:i fp:i fn:i",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY fbeta DESC, threshold) AS k FROM (SELECT *, 5 * precision * recall / greatest(4 * precision + recall, 1e-10) AS fbeta FROM (
       SELECT *, tp / greatest(tp + fn, 1) AS recall, tp / greatest(tp + fp, 1) AS precision FROM (SELECT series_id, threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp,
         count(*) FILTER (p < threshold AND y = 1) AS fn FROM pb, (VALUES {', '.join(f'({v}::DOUBLE)' for v in TH)}) g(threshold) GROUP BY ALL)))) WHERE k = 1""",
    PROBS,
)
def _(t):
    return calibrate.best_fbeta(probs(t), S, TH)


@query(
    "recall_at_precision",
    "series_id:i threshold:d precision:d recall:d reached:b",
    """SELECT series_id, threshold, precision, recall, ok AS reached FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ok DESC, CASE WHEN ok THEN recall ELSE precision END DESC, threshold) AS k FROM (
       SELECT *, precision >= 0.25 AS ok FROM (SELECT series_id, threshold, cp / cn AS precision, cp / tot AS recall FROM (
         SELECT series_id, p AS threshold, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY series_id) AS tot FROM (SELECT series_id, p, count(*) AS n, sum(y) AS pos FROM pb GROUP BY ALL) WINDOW w AS (PARTITION BY series_id ORDER BY p DESC))))) WHERE k = 1""",
    PROBS,
)
def _(t):
    return calibrate.best_recall_at_precision(probs(t), S, 0.25)


@query(
    "cascade_decision",
    "series_id:i correct_alarms:i missed_alarms:i false_alarms:i total_extremes:i",
    """SELECT series_id, count(*) FILTER (d = 1 AND y = 1) AS correct_alarms, count(*) FILTER (d = 0 AND y = 1) AS missed_alarms, count(*) FILTER (d = 1 AND y = 0) AS false_alarms, sum(y) AS total_extremes
       FROM (SELECT series_id, y, CASE WHEN p > 0.3 THEN 1 WHEN p < 0.1 THEN 0 ELSE CAST(p * 2 > 0.35 AS INT) END AS d FROM pb) GROUP BY ALL""",
    PROBS,
)
def _(t):
    df = probs(t).withColumn("final_pred", calibrate.cascade(F.col("prob"), F.col("prob") * 2, F.lit(0.1), F.lit(0.3), 0.35))
    return calibrate.alarm_counts(df, S)
