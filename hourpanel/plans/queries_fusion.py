"""Fusion and learner queries."""

from itertools import product

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import folds, fusion, joins, learners, metrics, solve
from .fixture import DA_TYPES, MODELS
from .queries_metrics import SMAPE_SQL, smape_sql
from . import sql_solves as sq
from .registry import query

S = ["series_id"]
BY = ["series_id", "task", "period"]
POINT = ["series_id", *fusion.POINT]
BYS = "series_id, task, period"
PTS = "series_id, task, target_day, ds, period, hour_business"
ON = "a.series_id = b.series_id AND a.task = b.task AND a.period = b.period"

IMAE = f"""im0 AS (SELECT {BYS}, model_name, avg(abs(y_true - y_pred)) AS mae, count(*) AS n FROM panel GROUP BY ALL),
im AS (SELECT *, (1 / greatest(mae, 1e-6)) / sum(1 / greatest(mae, 1e-6)) OVER (PARTITION BY {BYS}) AS w FROM im0)"""
FUSED = f"""fu AS (SELECT {', '.join('a.' + c.strip() for c in PTS.split(','))}, max(y_true) AS y_true,
  CASE WHEN sum(w) > 1e-9 AND abs(sum(w) - 1) > 0.01 THEN sum(w * y_pred) / sum(w) ELSE sum(w * y_pred) END AS y_fused FROM panel a JOIN im b ON {ON} AND a.model_name = b.model_name GROUP BY ALL)"""


@query(
    "fusion_flagship",
    "series_id:i task:s period:s rows:i smape:d mae:d rmse:d bias_mean:d",
    f"""SELECT series_id, task, coalesce(period, 'overall') AS period, count(*) AS rows, {smape_sql('floor50', 'y_true', 'y_fused')} AS smape, avg(abs(y_true - y_fused)) AS mae,
       sqrt(avg((y_true - y_fused) ** 2)) AS rmse, avg(y_fused - y_true) AS bias_mean FROM fu GROUP BY GROUPING SETS ((series_id, task, period), (series_id, task))""",
    f"{IMAE}, {FUSED}",
)
def _(t):
    p = t.stored_panel
    fused = fusion.fuse(p, fusion.inverse_mae(p, BY), BY, POINT)
    return metrics.with_overall(fused, ["series_id", "task"], "period", metrics.standard_aggs("y_true", "y_fused"))


@query(
    "wide_frame",
    "series_id:i ds:t y_true:d extra:i " + " ".join(f"{m}:d" for m in MODELS),
    f"SELECT series_id, ds, max(y_true) AS y_true, max(n) AS extra, {', '.join(f'max(y_pred) FILTER (model_name = {chr(39)}{m}{chr(39)}) AS {m}' for m in MODELS)} FROM panel GROUP BY ALL",
)
def _(t):
    return fusion.wide_frame(t.stored_panel.withColumn("extra", F.col("n")), POINT, MODELS, ["extra"])


@query(
    "truth_conflicts",
    "series_id:i ds:t lowest:d highest:d rows:i",
    "SELECT series_id, ds, min(y) AS lowest, max(y) AS highest, count(*) AS rows FROM (SELECT series_id, ds, CASE WHEN n > 3 THEN y_true + 1 ELSE y_true END AS y FROM panel) GROUP BY ALL HAVING min(y) != max(y)",
)
def _(t):
    p = t.stored_panel.withColumn("y_true", F.when(F.col("n") > 3, F.col("y_true") + 1).otherwise(F.col("y_true")))
    return fusion.truth_conflicts(p, ["series_id", "ds"])


@query(
    "coverage_report",
    "series_id:i task:s period:s model_name:s expected_rows:i available_rows:i coverage:d eligible:b",
    f"""SELECT a.series_id, a.task, a.period, model_name, any_value(e) AS expected_rows, count(DISTINCT ds) AS available_rows, round(count(DISTINCT ds) / any_value(e), 4) AS coverage, count(DISTINCT ds) / any_value(e) >= 0.6 AS eligible
       FROM panel a JOIN (SELECT {BYS}, count(DISTINCT ds) AS e FROM panel GROUP BY ALL) b ON {ON} GROUP BY ALL""",
)
def _(t):
    return fusion.coverage(t.stored_panel, BY, 0.6)


@query("inverse_mae_weights", "series_id:i task:s period:s model_name:s mae:d sample_count:i weight:d", f"SELECT {BYS}, model_name, mae, n AS sample_count, w AS weight FROM im", IMAE)
def _(t):
    return fusion.inverse_mae(t.stored_panel, BY)


SOFT = f"""SELECT {BYS}, model_name, rmse, exp(z) / sum(exp(z)) OVER (PARTITION BY {BYS}) AS weight FROM (SELECT *, -rmse / (max(rmse) OVER (PARTITION BY {BYS}) + 1e-10) / 0.1 AS z FROM (
  SELECT a.series_id, a.task, a.period, a.model_name, sqrt((adj + yy) / n) AS rmse FROM (SELECT {BYS}, model_name, sum((y_true - y_pred) ** 2 - y_true ** 2) AS adj FROM panel GROUP BY ALL) a
  JOIN (SELECT {BYS}, sum(y ** 2) AS yy, count(*) AS n FROM (SELECT {BYS}, ds, max(y_true) AS y FROM panel GROUP BY ALL) GROUP BY ALL) b ON {ON}))"""


@query("softmax_rmse_weights", "series_id:i task:s period:s model_name:s rmse:d weight:d", SOFT)
def _(t):
    return fusion.softmax_rmse(t.stored_panel, BY, POINT)


@query(
    "explicit_and_equal_weights",
    "series_id:i kind:s model_name:s weight:d",
    """SELECT DISTINCT series_id, 'equal' AS kind, model_name, 0.2::DOUBLE AS weight FROM panel UNION ALL
       SELECT DISTINCT series_id, 'explicit', m, w / 4 FROM panel, (VALUES ('view', 1.0::DOUBLE), ('click', 3.0)) v(m, w)""",
)
def _(t):
    p = t.stored_panel
    a = fusion.equal_weights(p, S).withColumn("kind", F.lit("equal"))
    return a.unionByName(fusion.explicit_weights({"view": 1.0, "click": 3.0}, p, S).withColumn("kind", F.lit("explicit")))


@query(
    "anchor_blend",
    "series_id:i ds:t y_fused:d",
    "SELECT series_id, ds, 0.9 * coalesce(a, o) + (1 - 0.9::DOUBLE) * coalesce(o, a) AS y_fused FROM (SELECT series_id, ds, max(y_pred) FILTER (model_name = 'view') AS a, avg(y_pred) FILTER (model_name != 'view') AS o FROM panel GROUP BY ALL)",
)
def _(t):
    return fusion.anchor_blend(t.stored_panel, ["series_id", "ds"], "view")


RAW_W = f"rw AS (SELECT {BYS}, model_name, avg(y_pred - 40) / 20 AS weight FROM panel GROUP BY ALL)"


def raw_weights(t):
    return t.stored_panel.groupBy(*BY, "model_name").agg((F.avg(F.col("y_pred") - 40) / 20).alias("weight"))


@query(
    "scaled_weights",
    "series_id:i task:s period:s model_name:s weight:d",
    f"""SELECT {BYS}, model_name, CASE WHEN abs(t - 1) < 1e-9 THEN c WHEN abs(u) < 1e-9 THEN 0.2 ELSE d / u END AS weight FROM (SELECT *, sum(d) OVER (PARTITION BY {BYS}) AS u FROM (
       SELECT *, CASE WHEN abs(t) > 1e-9 THEN least(greatest(c / t, -0.5), 1.2) ELSE 0.2 END AS d FROM (SELECT *, sum(c) OVER (PARTITION BY {BYS}) AS t FROM (SELECT *, least(greatest(weight, -0.5), 1.2) AS c FROM rw))))""",
    RAW_W,
)
def _(t):
    return fusion.scale_weights(raw_weights(t), BY)


@query(
    "projected_weights",
    "series_id:i task:s period:s model_name:s weight:d",
    f"SELECT {BYS}, model_name, w AS weight FROM pj JOIN {sq.named(MODELS)} USING (i)",
    f"{RAW_W}, {sq.pin_and_share('pj', f'(SELECT {BYS}, i, weight AS v FROM rw JOIN {sq.named(MODELS)} USING (model_name))', BYS, len(MODELS))}",
)
def _(t):
    return fusion.project_weights(raw_weights(t), BY)


@query(
    "filled_weights",
    "series_id:i task:s period:s model_name:s weight:d",
    f"SELECT g.series_id, g.task, g.period, m AS model_name, coalesce(im.w, 1.0::DOUBLE / 6) AS weight FROM (SELECT DISTINCT {BYS} FROM panel) g, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('other')) v(m) LEFT JOIN im ON im.series_id = g.series_id AND im.task = g.task AND im.period = g.period AND im.model_name = m",
    IMAE,
)
def _(t):
    p = t.stored_panel
    return fusion.fill_weights(fusion.inverse_mae(p, BY), p, BY, [*MODELS, "other"])


@query(
    "gram_statistics",
    "series_id:i task:s period:s n:d g01:d g33:d b2:d sy:d yy:d",
    f"""SELECT {BYS}, CAST(count(*) AS DOUBLE) AS n, sum(click * error) AS g01, sum(signup * signup) AS g33, sum(purchase * y) AS b2, sum(y) AS sy, sum(y * y) AS yy FROM (SELECT {BYS}, ds, max(y_true) AS y,
       {', '.join(f'coalesce(max(y_pred) FILTER (model_name = {chr(39)}{m}{chr(39)}), 0) AS {m}' for m in MODELS)} FROM panel GROUP BY ALL) GROUP BY ALL""",
)
def _(t):
    g = solve.gram(fusion.wide_frame(t.stored_panel, POINT, MODELS), BY, MODELS, fill=0.0)
    return g.select(*BY, "n", F.col("g")[1].alias("g01"), F.col("g")[18].alias("g33"), F.col("b")[2].alias("b2"), "sy", "yy")


def _solved(t, method, fill, **kw):
    wide = fusion.wide_frame(t.stored_panel, POINT, MODELS)
    return solve.solve(solve.gram(wide, BY, MODELS, fill=fill), BY, MODELS, method, **kw)


K = len(MODELS)
FILLED = f"""wz AS (SELECT {BYS}, ds, max(y_true) AS y, {', '.join(f'coalesce(max(y_pred) FILTER (model_name = {chr(39)}{m}{chr(39)}), 0) AS x{i}' for i, m in enumerate(MODELS))} FROM panel GROUP BY ALL),
gr AS ({sq.gram('wz', BYS, [f'x{i}' for i in range(K)])})"""
_WEIGHTS = f"SELECT {BYS}, model_name, v AS weight FROM {sq.long('fit', BYS, K)} JOIN {sq.named(MODELS)} USING (i)"
_PROJECTED = f"SELECT {BYS}, model_name, w AS weight FROM pj JOIN {sq.named(MODELS)} USING (i)"


def others_of(source, k, out, keys):
    """The statistics without column ``out``."""
    at = lambda i: f"({i} + CASE WHEN {i} >= {out} THEN 1 ELSE 0 END)"
    n = k - 1
    g = f"list_transform(range(0, {n * n}), lambda i: g[{at(f'(i // {n})')} * {k} + {at(f'(i % {n})')} + 1])"
    return f"(SELECT {keys}, {g} AS g, list_transform(range(0, {n}), lambda i: b[{at('i')} + 1]) AS b FROM {source})"


_ANCHOR = f"SELECT {BYS}, model_name, CASE WHEN i = {K - 1} THEN 0.9 ELSE (1 - 0.9::DOUBLE) * v END AS weight FROM {sq.long('(SELECT * REPLACE (list_append(w, 0::DOUBLE) AS w) FROM fit)', BYS, K)} JOIN {sq.named(MODELS)} USING (i)"
for _name, _method, _kw, _sql, _ctes in (
    ("ridge_weights", "ridge", {"alpha": 1.0}, _WEIGHTS, sq.ridge("fit", "gr", K, "1.0")),
    ("ridge_nonnegative_weights", "ridge_nonnegative", {"alpha": 2.0}, _WEIGHTS, sq.quadratic("fit", "gr", K, 2.0, mixture=False)),
    ("ridge_projected_weights", "ridge_projected", {"alpha": 1.0}, _PROJECTED, f"{sq.ridge('fit', 'gr', K, '1.0', centred=True)}, {sq.pin_and_share('pj', sq.long('fit', BYS, K), BYS, K)}"),
    ("convex_mse_weights", "convex", {}, _WEIGHTS, sq.quadratic("fit", "gr", K)),
    ("anchor_convex_weights", "anchor", {"anchor": 4}, _ANCHOR, sq.quadratic("fit", others_of("gr", K, K - 1, BYS), K - 1)),
):
    query(_name, "series_id:i task:s period:s model_name:s weight:d", _sql, f"{FILLED}, {_ctes}")(lambda t, m=_method, k=_kw: _solved(t, m, 0.0, **k))


@query("convex_smape_weights", "series_id:i task:s period:s model_name:s weight:d", None)
def _(t):
    wide = fusion.wide_frame(fusion.complete_points(t.stored_panel, POINT, 3), POINT, MODELS).withColumns({m: F.coalesce(m, F.lit(0.0)) for m in MODELS})
    return fusion.as_long(fusion.convex_search(wide, BY, MODELS), BY, MODELS)


ROLL = f"""dy AS (SELECT series_id, business_day, count(*) AS n, sum(y * y) AS yy, {', '.join(f'sum((y - {m}) ** 2) AS e_{m}' for m in MODELS)} FROM (SELECT series_id, business_day, hour_business, max(y_true) AS y,
  {', '.join(f'coalesce(max(y_pred) FILTER (model_name = {chr(39)}{m}{chr(39)}), 0) AS {m}' for m in MODELS)} FROM panel GROUP BY ALL) GROUP BY ALL),
ro AS (SELECT series_id, business_day, model_name, e, CASE WHEN days >= 5 AND n >= 40 THEN true ELSE false END AS ok FROM (SELECT series_id, business_day, sum(n) OVER w AS n, count(*) OVER w AS days,
  [{', '.join(f'sqrt(sum(e_{m}) OVER w / sum(n) OVER w)' for m in MODELS)}] AS es, {list(MODELS)} AS ms FROM dy WINDOW w AS (PARTITION BY series_id ORDER BY business_day RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)), LATERAL (SELECT unnest(ms) AS model_name, unnest(es) AS e))"""


@query(
    "rolling_softmax_weights",
    "series_id:i business_day:t model_name:s weight:d",
    """SELECT series_id, business_day, model_name, CASE WHEN ok THEN exp(z) / sum(exp(z)) OVER (PARTITION BY series_id, business_day) ELSE 0.2 END AS weight
       FROM (SELECT *, -e / (max(e) OVER (PARTITION BY series_id, business_day) + 1e-10) / 0.1 AS z FROM ro)""",
    ROLL,
)
def _(t):
    return fusion.rolling_weights(t.stored_panel, S, MODELS, "softmax", window_days=10, min_history_days=10)


_XS = [f"x{i}" for i in range(K)]
_G = [f"sum(x{i} * x{j})" for i in range(K) for j in range(K)]
_SUMS = [*_G, *[f"sum({x} * y)" for x in _XS], *[f"sum({x})" for x in _XS], "sum(y)", "CAST(count(*) AS DOUBLE)"]
_PAST = ", ".join(f"sum(c{i}) OVER w AS c{i}" for i in range(len(_SUMS)))
ROLLED = f"""wr AS (SELECT series_id, business_day, hour_business, max(y_true) AS y, {', '.join(f'coalesce(max(y_pred) FILTER (model_name = {chr(39)}{m}{chr(39)}), 0) AS x{i}' for i, m in enumerate(MODELS))} FROM panel GROUP BY ALL),
wd0 AS (SELECT series_id, business_day, {', '.join(f'{c} AS c{i}' for i, c in enumerate(_SUMS))} FROM wr GROUP BY ALL),
wd1 AS (SELECT series_id, business_day, {_PAST}, count(*) OVER w AS days FROM wd0 WINDOW w AS (PARTITION BY series_id ORDER BY business_day RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
wd2 AS (SELECT series_id, business_day, [{', '.join(f'c{i}' for i in range(K * K))}] AS g, [{', '.join(f'c{K * K + i}' for i in range(K))}] AS b, [{', '.join(f'c{K * K + K + i}' for i in range(K))}] AS s,
  c{K * K + 2 * K} AS sy, c{K * K + 2 * K + 1} AS n, coalesce(days >= 5 AND c{K * K + 2 * K + 1} >= 40, false) AS ok FROM wd1),
wok AS (SELECT * FROM wd2 WHERE ok)"""
_DAYS = "series_id, business_day"
_VIEW = MODELS.index("view")


def _rolled(weight):
    return f"""SELECT d.series_id, d.business_day, model_name, CASE WHEN d.ok THEN {weight} ELSE 0.2 END AS weight FROM wd2 d CROSS JOIN {sq.named(MODELS)}
       LEFT JOIN fit ON fit.series_id = d.series_id AND fit.business_day = d.business_day"""


for _m, _a, _sql, _ctes in (
    ("convex", None, _rolled("w[i + 1]"), sq.quadratic("fit", "wok", K)),
    ("ridge", None, _rolled("w[i + 1]"), sq.ridge("fit", "wok", K, "1.0")),
    ("anchor", "view", _rolled(f"CASE WHEN i = {_VIEW} THEN 0.9 ELSE (1 - 0.9::DOUBLE) * w[i + 1 - CASE WHEN i > {_VIEW} THEN 1 ELSE 0 END] END"), sq.quadratic("fit", others_of("wok", K, _VIEW, _DAYS), K - 1)),
):
    query(f"rolling_{_m}_weights", "series_id:i business_day:t model_name:s weight:d", _sql, f"{ROLLED}, {_ctes}")(
        lambda t, m=_m, a=_a: fusion.rolling_weights(t.stored_panel, S, MODELS, m, window_days=10, anchor=a)
    )


@query(
    "rolling_fusion_metrics",
    "series_id:i business_day:s rows:i smape:d severe:i",
    f"""SELECT series_id, coalesce(CAST(business_day AS VARCHAR), 'overall') AS business_day, count(*) AS rows, {smape_sql('absfloor_capped', 'y', 'f')} AS smape, count(*) FILTER (y - f > 20) AS severe FROM (
       SELECT p.series_id, p.business_day, p.hour_business, max(y_true) AS y, sum(w * y_pred) AS f FROM panel p JOIN (SELECT series_id, business_day, model_name, CASE WHEN ok THEN exp(z) / sum(exp(z)) OVER (PARTITION BY series_id, business_day) ELSE 0.2 END AS w
       FROM (SELECT *, -e / (max(e) OVER (PARTITION BY series_id, business_day) + 1e-10) / 0.1 AS z FROM ro)) w ON p.series_id = w.series_id AND p.business_day = w.business_day AND p.model_name = w.model_name GROUP BY ALL)
       GROUP BY GROUPING SETS ((series_id, business_day), (series_id))""",
    ROLL,
)
def _(t):
    p = t.stored_panel
    w = fusion.rolling_weights(p, S, MODELS, "softmax", window_days=10)
    f = fusion.fuse(p, w, ["series_id", "business_day"], ["series_id", "business_day", "hour_business"], "zero")
    return metrics.with_overall(
        f, S, "business_day",
        {"rows": F.count(F.lit(1)), "smape": scores.smape("absfloor_capped", "y_true", "y_fused"), "severe": F.count(F.when(F.col("y_true") - F.col("y_fused") > 20, 1))},
    )


BG = f"""fp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {BYS}, ds) AS k FROM panel) WHERE k >= 3),
dl AS (SELECT {BYS}, target_day, model_name, {smape_sql('floor50')} AS loss FROM fp GROUP BY ALL),
gl AS (SELECT *, exp(-(max(target_day) OVER (PARTITION BY {BYS}) - target_day) / 30.0::DOUBLE) AS gate, least(greatest(loss / CASE WHEN med < 1e-9 THEN 1 ELSE med END, 0), 5) AS nl FROM (SELECT *, median(loss) OVER (PARTITION BY {BYS}, target_day) AS med FROM dl))"""


@query(
    "bgew_weights",
    "series_id:i task:s period:s model_name:s weight:d",
    f"SELECT {BYS}, model_name, exp(z) / sum(exp(z)) OVER (PARTITION BY {BYS}) AS weight FROM (SELECT {BYS}, model_name, -0.5 * sum(gate * nl) AS z FROM gl GROUP BY ALL)",
    BG,
)
def _(t):
    return learners.bgew(t.stored_panel, BY, 3)


@query(
    "bgew_trace",
    "series_id:i task:s period:s target_day:t model_name:s loss:d normalized_loss:d gate:d weight_after:d",
    f"""SELECT {BYS}, target_day, model_name, loss, nl AS normalized_loss, gate, exp(z) / sum(exp(z)) OVER (PARTITION BY {BYS}, target_day) AS weight_after
       FROM (SELECT *, -0.5 * sum(gate * nl) OVER (PARTITION BY {BYS}, model_name ORDER BY target_day) AS z FROM gl)""",
    BG,
)
def _(t):
    return learners.bgew_trace(t.stored_panel, BY, 3)


TAP = """tp AS (SELECT *, exp(-ab / 3.0::DOUBLE) * exp(-(h - 1) / 2.0::DOUBLE) * exp(-a / 14.0::DOUBLE) * 0.9::DOUBLE AS g FROM (SELECT *, (30 - a) // 3 AS fid, 9 - (30 - a) // 3 AS ab, ((29 - a) % 3 + 3) % 3 + 1 AS h FROM (SELECT *, DATE '2024-01-31' - business_day AS a FROM panel) WHERE a BETWEEN 1 AND 30))"""


def tap(t):
    df = folds.assign_tap_folds(t.stored_panel, "2024-01-31").withColumn("source_confidence", F.lit(0.9))
    return df.withColumn("sample_gate", learners.sample_gate(df))


@query("sample_gates", "series_id:i ds:t model_name:s sample_gate:d", "SELECT series_id, ds, model_name, g AS sample_gate FROM tp", TAP)
def _(t):
    return tap(t)


LOSS_SQL = f"""SELECT l.series_id, l.task, l.period, l.fid AS tap_fold_id, l.model_name, loss, median(loss) OVER (PARTITION BY l.series_id, l.task, l.period, l.fid) AS median_loss, mg AS mean_gate FROM (
       SELECT p.series_id, p.task, p.period, p.fid, p.model_name, 0.6 * sum(g * {SMAPE_SQL['floor50'].format(t='y_true', p='y_pred')}) / sum(g) + 0.3 * sum(g * abs(y_true - y_pred) / greatest(md, 1e-6)) / sum(g)
         + 0.1 * sum(g * abs(y_true - y_pred)) FILTER (y_true >= q9) / sum(g) FILTER (y_true >= q9) AS loss
       FROM tp p JOIN (SELECT {BYS}, fid, model_name, median(abs(y_true)) AS md, quantile_cont(y_true, 0.9) AS q9 FROM tp GROUP BY ALL) q ON p.series_id = q.series_id AND p.task = q.task AND p.period = q.period AND p.fid = q.fid AND p.model_name = q.model_name GROUP BY ALL) l
       JOIN (SELECT {BYS}, fid, avg(g) AS mg FROM (SELECT {BYS}, fid, ds, max(g) AS g FROM tp GROUP BY ALL) GROUP BY ALL) m ON l.series_id = m.series_id AND l.task = m.task AND l.period = m.period AND l.fid = m.fid
       QUALIFY count(*) OVER (PARTITION BY l.series_id, l.task, l.period, l.fid) >= 2"""


@query(
    "tap_fold_losses",
    "series_id:i task:s period:s tap_fold_id:i model_name:s loss:d median_loss:d mean_gate:d",
    LOSS_SQL,
    TAP,
)
def _(t):
    return learners.fold_losses(tap(t), BY)


STEPS = f"""lo AS ({LOSS_SQL}),
grp AS (SELECT DISTINCT {BYS}, m AS model_name FROM lo, (VALUES {', '.join(f"('{m}')" for m in MODELS)}) v(m)),
stp AS (SELECT {BYS}, model_name, 0 AS k, 0.2::DOUBLE AS weight FROM grp
  UNION ALL BY STEP
  SELECT s.series_id, s.task, s.period, s.model_name, s.k + 1, x.raw / sum(x.raw) OVER (PARTITION BY s.series_id, s.task, s.period) FROM stp s LEFT JOIN lo l ON l.series_id = s.series_id AND l.task = s.task AND l.period = s.period AND l.model_name = s.model_name AND l.tap_fold_id = 9 - s.k,
    LATERAL (SELECT CASE WHEN l.loss IS NULL THEN s.weight ELSE greatest(s.weight * exp(-0.8 * l.mean_gate * least(greatest(l.loss / greatest(l.median_loss, 1e-6), 0.25), 4)), 0.03) END AS raw) x WHERE s.k < 10)"""


@query("tap_update_weights", "series_id:i task:s period:s model_name:s weight:d", f"SELECT {BYS}, model_name, weight FROM stp WHERE k = 10", f"{TAP}, {STEPS}")
def _(t):
    return learners.tap_update(learners.fold_losses(tap(t), BY), BY, MODELS)


@query(
    "evidence_shrinkage",
    "series_id:i task:s period:s model_name:s confidence:d weight:d",
    f"""SELECT {BYS}, model_name, c AS confidence, x / sum(x) OVER (PARTITION BY {BYS}) AS weight FROM (SELECT *, greatest(c * w + (1 - c) * 0.2, 0.03) AS x FROM (
       SELECT a.series_id, a.task, a.period, a.model_name, a.w, m / (m + 5) AS c FROM im a JOIN (SELECT {BYS}, model_name, sum(g) AS m FROM tp GROUP BY ALL) b ON {ON} AND a.model_name = b.model_name))""",
    f"{TAP}, {IMAE}",
)
def _(t):
    w = fusion.inverse_mae(t.stored_panel, BY).select(*BY, "model_name", "weight")
    return learners.shrink(tap(t), w, BY)


@query("tap_learner_weights", "series_id:i task:s period:s model_name:s weight:d", None)
def _(t):
    return learners.tap_learner(tap(t), BY, sorted(MODELS))


ALL_M = sorted(MODELS)
_I = range(len(ALL_M))
_each = lambda form, sep=", ": sep.join(form.format(i=i, m=ALL_M[i]) for i in _I)
_WHOLE = _each("m{i} IS NOT NULL", " AND ")
CAND = f"""wd AS (SELECT {BYS}, ds, max(y_true) AS y, {_each("max(y_pred) FILTER (model_name = '{m}') AS m{i}")} FROM panel GROUP BY ALL),
fp AS (SELECT t.* FROM panel t JOIN wd ON t.series_id = wd.series_id AND t.task = wd.task AND t.ds = wd.ds WHERE {_WHOLE}),
dl AS (SELECT {BYS}, target_day, model_name, {smape_sql('floor50')} AS loss FROM fp GROUP BY ALL),
gl AS (SELECT *, exp(-(max(target_day) OVER (PARTITION BY {BYS}) - target_day) / 30.0::DOUBLE) AS gate, least(greatest(loss / CASE WHEN med < 1e-9 THEN 1 ELSE med END, 0), 5) AS nl FROM (SELECT *, median(loss) OVER (PARTITION BY {BYS}, target_day) AS med FROM dl)),
bw AS (SELECT {BYS}, {_each("max(w) FILTER (model_name = '{m}') AS w{i}")} FROM (
  SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY {BYS}) AS w FROM (SELECT {BYS}, model_name, -0.5 * sum(gate * nl) AS z FROM gl GROUP BY ALL)) GROUP BY ALL),
ca AS (SELECT {BYS}, unnest(['equal_weight', 'bgew', {_each("'single_{m}'")}]) AS candidate_name, unnest([1, 3, {_each("0")}]) AS kind, unnest([0, 2, {", ".join(str(3 + i) for i in _I)}]) AS position,
  {", ".join(f"unnest([1.0 / {len(ALL_M)}, w{i}, {', '.join(str(int(i == j)) for j in _I)}]) AS a{i}" for i in _I)} FROM bw),
scd AS (SELECT {', '.join('w.' + c for c in BYS.split(', '))}, candidate_name, kind, position, {smape_sql('floor50', 'w.y', '(' + _each("ca.a{i} * w.m{i}", " + ") + ')')} AS score, avg(abs(w.y - ({_each("ca.a{i} * w.m{i}", " + ")}))) AS mae, count(*) AS n
  FROM wd w JOIN ca ON w.series_id = ca.series_id AND w.task = ca.task AND w.period = ca.period WHERE {_each("w.m{i} IS NOT NULL", " AND ")} GROUP BY ALL)"""


@query(
    "candidate_selection",
    "series_id:i task:s period:s candidate_name:s score:d mae:d n:i intersection_retention_rate:d chosen:b",
    f"""SELECT a.series_id, a.task, a.period, candidate_name, score, mae, n, keep AS intersection_retention_rate, row_number() OVER (PARTITION BY a.series_id, a.task, a.period ORDER BY CASE WHEN score <= best + greatest(abs(best) * 1e-3, 1e-9) THEN 0 ELSE 1 END, kind, position) = 1 AS chosen
       FROM (SELECT *, min(score) OVER (PARTITION BY {BYS}) AS best FROM scd) a JOIN (SELECT {BYS}, avg(CAST({_WHOLE} AS DOUBLE)) AS keep FROM wd GROUP BY ALL) b ON {ON}""",
    CAND,
)
def _(t):
    df = t.stored_panel
    c = learners.candidate_weights(df, BY, ALL_M, convex=False)
    return learners.choose_candidate(learners.evaluate_candidates(df, c, BY, ALL_M), BY)


GRID = 8  # weights in eighths: 495 mixtures of five models
_STEPS = ["(SELECT unnest(range(0, %d)) AS g%d)" % (GRID + 1, i) for i in _I[:-1]]
_LAST = f"{GRID} - " + " - ".join(f"g{i}" for i in _I[:-1])


@query(
    "convex_beats_grid",
    "series_id:i task:s period:s grid_score:d fit_not_above:b",
    f"""SELECT series_id, task, period, min(score) AS grid_score, true AS fit_not_above FROM (
          SELECT series_id, task, period, {smape_sql('floor50', 'y', '(' + _each("g{i} * m{i}", " + ") + f') / {GRID}.0::DOUBLE')} AS score
          FROM wd CROSS JOIN (SELECT *, {_LAST} AS g{_I[-1]} FROM {" CROSS JOIN ".join(_STEPS)}) WHERE g{_I[-1]} >= 0 AND {_WHOLE} GROUP BY {BYS}, {_each("g{i}")}) GROUP BY ALL""",
    CAND,
)
def _(t):
    """The fitted mixture against all mixtures in eighths: their least score, and whether the fit lies above it."""
    df = t.stored_panel
    wide = fusion.wide_frame(df, [*BY, *learners.DAY_POINT], ALL_M).na.drop(subset=["y_true", *ALL_M])
    names = F.lit("fit"), F.lit("fit"), F.lit(0)
    labels = [n.alias(a) for n, a in zip(names, ("candidate_name", "selected_mode", "position"), strict=True)]
    fit = learners.evaluate_candidates(df, fusion.convex_search(wide, BY, ALL_M).select(*BY, *labels, "weights"), BY, ALL_M)
    mixtures = [w for w in product(range(GRID + 1), repeat=len(ALL_M)) if sum(w) == GRID]
    grid = F.array(*[F.array(*[F.lit(v / GRID) for v in w]) for w in mixtures])
    x = F.array(*[F.col(m) for m in ALL_M])
    at = wide.select(*BY, "y_true", F.posexplode(F.transform(grid, lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))).alias("mixture", "p"))
    best = at.groupBy(*BY, "mixture").agg(scores.smape("floor50", "y_true", "p").alias("score")).groupBy(*BY).agg(F.min("score").alias("grid_score"))
    return best.join(fit.select(*BY, "score"), BY).select(*BY, "grid_score", (F.col("score") <= F.col("grid_score") * (1 + 1e-9)).alias("fit_not_above"))


@query("convex_candidate_is_best", "series_id:i task:s period:s not_above_others:b sums_to_one:b inside:b", None)
def _(t):
    """For the convex candidate of all models: whether no other candidate lies below it, and its weights are a mixture.

    The loss has the prediction in its denominator, so the search may end in a local minimum; the row then says so.
    """
    df = t.stored_panel
    c = learners.candidate_weights(df, BY, ALL_M)
    scored = learners.evaluate_candidates(df, c, BY, ALL_M)
    convex = F.col("candidate_name") == "static_convex"
    best = scored.groupBy(*BY).agg((F.min(F.when(convex, F.col("score"))) <= F.min(F.when(~convex, F.col("score"))) * (1 + 1e-6) + 1e-9).alias("not_above_others"))
    total = F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w)
    mix = c.where(convex).select(*BY, (F.abs(total - 1) < 1e-6).alias("sums_to_one"), F.forall("weights", lambda w: w.between(-1e-9, 1 + 1e-9)).alias("inside"))
    return best.join(mix, BY)


@query("holdout_learner_routing", "series_id:i task:s period:s candidate_name:s selected_mode:s score:d", None)
def _(t):
    df = t.stored_panel.withColumn("target_day", F.date_add("target_day", 16))
    return learners.holdout_learner(df, BY, ALL_M)[0]


@query("holdout_learner_backtest", "series_id:i task:s period:s rows:i smape:d mae:d", None)
def _(t):
    df = t.stored_panel.withColumn("target_day", F.date_add("target_day", 16))
    routing, weights = learners.holdout_learner(df, BY, ALL_M)
    out = learners.apply_routing(df, routing, weights, S)
    return out.groupBy(*BY).agg(F.count(F.lit(1)).alias("rows"), scores.smape("floor50", "y_true", "y_fused").alias("smape"), scores.mae("y_true", "y_fused").alias("mae"))


WFIVE = "w5 AS (SELECT * FROM im WHERE model_name != 'signup' AND NOT (task = 'realtime' AND period = '1_8'))"
RULE_EXPR = {
    "propagate": "CASE WHEN used = nw THEN v END",
    "renorm_tol": "CASE WHEN u > 1e-9 AND abs(u - 1) > 0.01 THEN v / u ELSE v END",
    "zero": "v",
    "renorm_row": "CASE WHEN u > 0 THEN v / u ELSE mean END",
    "renorm_used": "CASE WHEN u > 0 THEN v / u END",
    "renorm_group": "CASE WHEN u2 IS NULL THEN v2 ELSE v2 END",
}


@query(
    "fuse_missing_rules",
    "rule:s series_id:i ds:t y_fused:d regime:s",
    " UNION ALL ".join(
        f"SELECT '{r}' AS rule, series_id, ds, CASE WHEN nw IS NULL THEN mean ELSE {e} END AS y_fused, CASE WHEN nw IS NULL THEN 'fallback_mean' ELSE 'weights' END AS regime FROM fz" for r, e in RULE_EXPR.items()
    ),
    f"""{IMAE}, {WFIVE}, nw AS (SELECT {BYS}, count(*) AS nw FROM w5 GROUP BY ALL),
    dm AS (SELECT series_id, task, period, target_day, sum(coalesce(w, 0)) AS tot, count(*) AS nm FROM (SELECT DISTINCT a.series_id, a.task, a.period, a.target_day, a.model_name, b.w FROM panel a LEFT JOIN w5 b ON {ON} AND a.model_name = b.model_name) GROUP BY ALL),
    fz AS (SELECT a.series_id, a.ds, any_value(nw) AS nw, coalesce(sum(b.w * y_pred), 0) AS v, coalesce(sum(b.w), 0) AS u, avg(y_pred) AS mean, count(b.w) AS used, sum(CASE WHEN tot < 1e-9 THEN 1.0 / nm ELSE b.w / tot END) AS u2,
      coalesce(sum(CASE WHEN tot < 1e-9 THEN 1.0 / nm ELSE b.w / tot END * y_pred), 0) AS v2
      FROM panel a LEFT JOIN w5 b ON {ON} AND a.model_name = b.model_name LEFT JOIN nw c ON a.series_id = c.series_id AND a.task = c.task AND a.period = c.period
      JOIN dm d ON a.series_id = d.series_id AND a.task = d.task AND a.period = d.period AND a.target_day = d.target_day GROUP BY ALL)""",
)
def _(t):
    p = t.stored_panel
    w = fusion.inverse_mae(p, BY).where("model_name != 'signup' AND NOT (task = 'realtime' AND period = '1_8')")
    return fusion.fuse_rules(p, w, BY, POINT, list(RULE_EXPR))


@query(
    "routing_applied",
    "series_id:i ds:t selected_mode:s y_fused:d available_models:s",
    f"""SELECT a.series_id, ds, CASE WHEN period = '9_16' THEN CASE WHEN has = 1 THEN 'single_model' ELSE 'equal_weight_fallback' END ELSE 'bgew' END AS selected_mode,
       sum(CASE WHEN period = '9_16' THEN CASE WHEN has = 1 THEN CAST(model_name = 'view' AS INT) ELSE 1.0 / cnt END WHEN tot < 1e-9 THEN 1.0 / cnt ELSE w / tot END * y_pred) AS y_fused, string_agg(model_name, ',' ORDER BY model_name) AS available_models
       FROM (SELECT p.*, im.w, g.has, g.cnt, g.tot FROM panel p JOIN im ON p.series_id = im.series_id AND p.task = im.task AND p.period = im.period AND p.model_name = im.model_name JOIN (
         SELECT series_id, task, period, target_day, max(CAST(model_name = 'view' AS INT)) AS has, count(*) AS cnt, sum(w) AS tot FROM (SELECT DISTINCT p.series_id, p.task, p.period, p.target_day, p.model_name, im.w FROM panel p JOIN im ON p.series_id = im.series_id AND p.task = im.task AND p.period = im.period AND p.model_name = im.model_name) GROUP BY ALL) g
         ON p.series_id = g.series_id AND p.task = g.task AND p.period = g.period AND p.target_day = g.target_day) a
       GROUP BY a.series_id, ds, period, has HAVING period != '9_16' OR has = 0 OR count(*) FILTER (model_name = 'view') >= 0""",
    IMAE,
)
def _(t):
    p = t.stored_panel
    w = fusion.inverse_mae(p, BY)
    mid = F.col("period") == "9_16"
    routing = p.select(*BY).distinct().select(
        *BY, F.when(mid, "single_model").otherwise("bgew").alias("selected_mode"), F.when(mid, "single_view").otherwise("bgew").alias("candidate_name")
    )
    return learners.apply_routing(p, routing, w, S)


@query(
    "short_days",
    "series_id:i task:s target_day:t rows:i",
    "SELECT series_id, task, target_day, count(*) AS rows FROM (SELECT DISTINCT series_id, task, target_day, ds FROM panel) GROUP BY ALL HAVING count(*) != 24",
)
def _(t):
    fused = fusion.mean_fusion(t.stored_panel, POINT)
    return learners.short_days(fused, ["series_id", "task", "target_day"])


TEMPL = "VALUES ('click', 0.7::DOUBLE, 0.0::DOUBLE), ('error', 0.1, 0.1), ('purchase', 0.1, 0.2), ('signup', 0.1, 0.2), ('view', 0.0, 0.5)"


@query(
    "spike_aware_fusion",
    "series_id:i ds:t y_fused:d spike_regime:s",
    f"""SELECT series_id, ds, CASE WHEN u > 1e-9 AND abs(u - 1) > 0.01 THEN v / u ELSE v END AS y_fused, regime AS spike_regime FROM (
       SELECT f.series_id, f.ds, any_value(CASE WHEN f.period != '9_16' THEN 'neutral' WHEN p >= 0.6 THEN 'spike_heavy' WHEN p <= 0.2 THEN 'calm_heavy' ELSE 'neutral' END) AS regime, coalesce(sum(fw * y_pred), 0) AS v, sum(fw) FILTER (y_pred IS NOT NULL) AS u FROM (
         SELECT *, CASE WHEN f_on THEN CASE WHEN abs(t0 - 1) < 1e-9 THEN c0 ELSE d0 / sum(d0) OVER (PARTITION BY series_id, ds) END ELSE w END AS fw FROM (
         SELECT *, least(greatest(c0 / t0, -0.5), 1.2) AS d0 FROM (SELECT *, sum(c0) OVER (PARTITION BY series_id, ds) AS t0 FROM (
         SELECT *, least(greatest(CASE WHEN f_on THEN w + au * (up - w) + ad * (dn - (w + 0)) ELSE w END, -0.5), 1.2) AS c0 FROM (
         SELECT x.series_id, x.task, x.ds, x.period, x.p, im.model_name, im.w, up, dn, CASE WHEN p >= 0.6 THEN least(1, (p - 0.6::DOUBLE) / (1 - 0.6::DOUBLE)) ELSE 0 END AS au, CASE WHEN p <= 0.2 THEN greatest(0, 1 - p / 0.2::DOUBLE) ELSE 0 END AS ad,
           x.period = '9_16' AND (p > 0.6 OR p < 0.2) AS f_on
         FROM (SELECT {BYS}, ds, least(1, max(n) / 4.0::DOUBLE) AS p FROM panel GROUP BY ALL) x JOIN im ON x.series_id = im.series_id AND x.task = im.task AND x.period = im.period JOIN ({TEMPL}) tm(model_name, up, dn) ON tm.model_name = im.model_name))))) f
       LEFT JOIN panel y ON f.series_id = y.series_id AND f.ds = y.ds AND f.model_name = y.model_name GROUP BY f.series_id, f.ds)""",
    IMAE,
)
def _(t):
    p = t.stored_panel
    w = fusion.inverse_mae(p, BY).select(*BY, "model_name", "weight")
    cells = [("click", 0.7, 0.0), ("error", 0.1, 0.1), ("purchase", 0.1, 0.2), ("signup", 0.1, 0.2), ("view", 0.0, 0.5)]
    arr = F.array(*[F.struct(F.lit(m).alias("model_name"), F.lit(u).alias("up"), F.lit(d).alias("down")) for m, u, d in cells])
    templates = p.select(*BY).distinct().select(*BY, F.explode(arr).alias("t")).select(*BY, "t.*")
    df = p.withColumn("spike_prob", F.least(F.lit(1.0), F.col("n") / 4.0))
    return fusion.fuse_spike_aware(df, w, templates, BY, POINT)


@query("spike_aware_fit", "series_id:i task:s period:s scale:d bias:d smape:d rows:i", None)
def _(t):
    df = t.stored_panel.withColumn("spike_prob", F.least(F.lit(1.0), F.col("n") / 4.0))
    arr = F.array(*[F.struct(F.lit(m).alias("model_name"), F.lit(u).alias("up"), F.lit(d).alias("down")) for m, u, d in (("click", 0.7, 0.1), ("purchase", 0.2, 0.3), ("view", 0.1, 0.6))])
    templates = df.select(*BY).distinct().select(*BY, F.explode(arr).alias("t")).select(*BY, "t.*")
    return learners.spike_aware_fit(df, BY, ALL_M, templates)[2]


@query(
    "router_mix",
    "series_id:i task:s period:s model_name:s weight:d",
    f"""SELECT {BYS}, model_name, CASE WHEN abs(t - 1) < 1e-9 THEN c ELSE d / sum(d) OVER (PARTITION BY {BYS}) END AS weight FROM (SELECT *, least(greatest(c / t, -0.5), 1.2) AS d FROM (SELECT *, sum(c) OVER (PARTITION BY {BYS}) AS t FROM (
       SELECT a.series_id, a.task, a.period, a.model_name, least(greatest(b.w + 0.4 * (a.weight - b.w), -0.5), 1.2) AS c FROM rw a JOIN im b ON {ON} AND a.model_name = b.model_name)))""",
    f"{RAW_W}, {IMAE}",
)
def _(t):
    return fusion.mix_router(fusion.inverse_mae(t.stored_panel, BY).select(*BY, "model_name", "weight"), raw_weights(t), BY, 0.4)


AFF = [(s, b) for s in fusion.SCALES for b in fusion.BIASES]


@query(
    "affine_search",
    "series_id:i task:s period:s scale:d bias:d smape:d rows:i",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {BYS} ORDER BY smape, i) AS k FROM (SELECT {BYS}, i, s AS scale, b AS bias, {smape_sql('floor50', 'y_true', '(s * y_fused + b)')} AS smape, count(*) AS rows
       FROM fu, (VALUES {', '.join(f'({i}, {s}::DOUBLE, {b}::DOUBLE)' for i, (s, b) in enumerate(AFF))}) g(i, s, b) GROUP BY ALL)) WHERE k = 1 AND rows >= 4""",
    f"{IMAE}, {FUSED}",
)
def _(t):
    p = t.stored_panel
    return fusion.affine_search(fusion.fuse(p, fusion.inverse_mae(p, BY), BY, POINT), BY)


@query(
    "segment_override_and_residual",
    "series_id:i ds:t y_pred:d",
    """SELECT p.series_id, p.ds, CASE WHEN p.task = 'realtime' AND p.period = '9_16' AND a.y_pred IS NOT NULL THEN a.y_pred ELSE p.y_pred END + CASE WHEN p.period = '17_24' THEN coalesce(r.v, 0) ELSE 0 END AS y_pred
       FROM (SELECT * FROM panel WHERE model_name = 'view') p LEFT JOIN (SELECT * FROM panel WHERE model_name = 'click') a ON p.series_id = a.series_id AND p.ds = a.ds
       LEFT JOIN (SELECT series_id, ds, y_true - y_pred AS v FROM panel WHERE model_name = 'error') r ON p.series_id = r.series_id AND p.ds = r.ds""",
)
def _(t):
    p = t.stored_panel
    base, alt = p.where("model_name = 'view'"), p.where("model_name = 'click'")
    out = fusion.override_segment(base, alt, ["series_id", "ds"], "realtime")
    res = p.where("model_name = 'error'").select("series_id", "ds", (F.col("y_true") - F.col("y_pred")).alias("residual"))
    return fusion.add_residual(out, res, ["series_id", "ds"], "17_24")


@query(
    "best_single_by_folds",
    "series_id:i task:s period:s best_single_model:s best_single_smape:d",
    f"""SELECT {BYS}, m AS best_single_model, s AS best_single_smape FROM (SELECT *, row_number() OVER (PARTITION BY {BYS} ORDER BY s, m) AS k FROM (SELECT {BYS}, m, avg(s) AS s FROM (
       SELECT {BYS}, fold, m, {smape_sql('floor50', 'y', 'p')} AS s FROM (SELECT *, unnest({list(ALL_M)}) AS m, unnest([{_each('m{i}')}]) AS p FROM (
         SELECT {BYS}, ds, y, {_each('m{i}')}, greatest(floor((i - (n - 3 * sz)) / sz) + 1, 0) AS fold FROM (SELECT *, greatest(n // 4, 1) AS sz FROM (
           SELECT *, row_number() OVER (PARTITION BY {BYS} ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY {BYS}) AS n FROM wd))))
       WHERE fold > 0 AND p IS NOT NULL GROUP BY ALL) GROUP BY ALL)) WHERE k = 1""",
    CAND,
)
def _(t):
    wide = fusion.wide_frame(t.stored_panel, POINT, ALL_M)
    return learners.best_single(learners.time_folds(wide, BY, 3), BY, ALL_M)


KA = len(ALL_M)


def imputed(extra=""):
    """Wide points of all models (and a sixth column) with medians in gaps, dealt to time-ordered folds."""
    cols = [*(f"m{i}" for i in range(KA)), *(["e"] if extra else [])]
    wide = ", ".join(f"max(y_pred) FILTER (model_name = '{m}') AS m{i}" for i, m in enumerate(ALL_M))
    return f"""iw0 AS (SELECT *{f", {extra} AS e" if extra else ""} FROM (SELECT {BYS}, ds, hour_business, max(y_true) AS y, {wide} FROM panel GROUP BY ALL)),
    iw1 AS (SELECT {BYS}, ds, y, {", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY {BYS}), 0) AS x{i}" for i, c in enumerate(cols))}, row_number() OVER (PARTITION BY {BYS} ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY {BYS}) AS n FROM iw0 WHERE y IS NOT NULL),
    iw AS MATERIALIZED (SELECT {BYS}, ds, y, {", ".join(f"x{i}" for i in range(len(cols)))}, greatest(floor((i - (n - 3 * greatest(n // 4, 1))) / greatest(n // 4, 1)) + 1, 0)::INTEGER AS fold FROM iw1),
    gw AS ({sq.gram("iw", BYS, [f"x{i}" for i in range(len(cols))])}),
    gt AS ({sq.gram("(SELECT iw.*, f FROM iw, (VALUES (1), (2), (3)) folds(f) WHERE fold < f)", BYS + ", f", [f"x{i}" for i in range(len(cols))])}),
    bs AS (SELECT {BYS}, model, avg(s) AS s FROM (SELECT {BYS}, fold, i AS model, {smape_sql("floor50", "y", "p")} AS s FROM (SELECT {BYS}, fold, y, unnest(range(0, {KA})) AS i, unnest([{", ".join(f"x{i}" for i in range(KA))}]) AS p FROM iw WHERE fold > 0) GROUP BY ALL) GROUP BY ALL),
    bc AS (SELECT {BYS}, min(s) AS best_single_smape, arg_min(model, (s, model)) AS cv_model FROM bs GROUP BY ALL)"""


_X = ", ".join(f"x{i}" for i in range(KA))
_DOT = lambda w, k: f"list_sum(list_transform(range(1, {k + 1}), lambda i: {w}[i] * x[i]))"
ROUTER = f"""{imputed()}, al AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(learners.ALPHAS))}) a(ai, alpha)),
{sq.ridge("rf", "(SELECT gt.*, ai, alpha FROM gt, al)", KA, "alpha", centred=True)},
{sq.pin_and_share("rp", sq.long("rf", BYS + ", f, ai", KA), BYS + ", f, ai", KA)},
rl AS (SELECT {BYS}, f, ai, list(w ORDER BY i) AS w FROM rp GROUP BY {BYS}, f, ai),
rs AS (SELECT {BYS}, ai, avg(s) AS s FROM (SELECT {BYS}, f, ai, {smape_sql("floor50", "y", "p")} AS s FROM (SELECT {", ".join("a." + c for c in BYS.split(", "))}, f, ai, y, {_DOT("w", KA)} AS p FROM (SELECT *, [{_X}] AS x FROM iw) a JOIN rl b ON {ON} AND a.fold = b.f) GROUP BY ALL) GROUP BY ALL),
rb AS (SELECT {BYS}, min(s) AS cv_smape, arg_min(ai, (s, ai)) AS ai FROM rs GROUP BY ALL),
oa AS (SELECT {BYS}, arg_min(i, (s, i)) AS model FROM (SELECT {BYS}, i, {smape_sql("floor50", "y", "p")} AS s FROM (SELECT {BYS}, y, unnest(range(0, {KA})) AS i, unnest([{_X}]) AS p FROM iw) GROUP BY ALL) GROUP BY ALL),
rr AS (SELECT * FROM rb JOIN al USING (ai) JOIN bc USING ({BYS}) JOIN oa USING ({BYS}))"""


@query(
    "router_report",
    "series_id:i task:s period:s best_alpha:d cv_smape:d best_single_model:s best_single_smape:d use_router:b",
    f"SELECT {BYS}, alpha AS best_alpha, cv_smape, model_name AS best_single_model, best_single_smape, cv_smape < best_single_smape AS use_router FROM rr JOIN {sq.named(ALL_M)} ON names.i = rr.model",
    ROUTER,
)
def _(t):
    return learners.router(fusion.wide_frame(t.stored_panel, POINT, ALL_M), BY, ALL_M)[0]


@query(
    "router_weights",
    "series_id:i task:s period:s model_name:s weight:d",
    f"SELECT {BYS}, model_name, CASE WHEN cv_smape < best_single_smape THEN w ELSE CAST(i = model AS DOUBLE) END AS weight FROM fp2 JOIN {sq.named(ALL_M)} USING (i) JOIN rr USING ({BYS})",
    f"""{ROUTER}, {sq.ridge("ff", f"(SELECT gw.*, alpha FROM gw JOIN rr USING ({BYS}))", KA, "alpha", centred=True)}, {sq.pin_and_share("fp2", sq.long("ff", BYS, KA), BYS, KA)}""",
)
def _(t):
    return learners.router(fusion.wide_frame(t.stored_panel, POINT, ALL_M), BY, ALL_M)[1]


@query(
    "meta_learner_report",
    "series_id:i task:s period:s cv_smape:d best_single_smape:d gate:s",
    f"""SELECT {BYS}, cv_smape, best_single_smape, CASE WHEN cv_smape < best_single_smape THEN 'strict' WHEN cv_smape - best_single_smape < 0.5 THEN 'meta_floor' ELSE 'best_single' END AS gate FROM bc JOIN (
       SELECT {BYS}, avg(s) AS cv_smape FROM (SELECT {BYS}, f, {smape_sql("floor50", "y", "p")} AS s FROM (SELECT {", ".join("a." + c for c in BYS.split(", "))}, f, y, c + {_DOT("w", KA + 1)} AS p
       FROM (SELECT *, [{_X}, x{KA}] AS x FROM iw) a JOIN mf b ON {ON} AND a.fold = b.f) GROUP BY ALL) GROUP BY ALL) USING ({BYS})""",
    f"""{imputed("sin(2 * pi() * hour_business / 24)")}, {sq.ridge("mf", "gt", KA + 1, "1.0", centred=True)}""",
)
def _(t):
    wide = fusion.wide_frame(t.stored_panel, POINT, ALL_M).withColumn("hour_sin", F.sin(2 * F.pi() * F.col("hour_business") / 24))
    return learners.meta_learner(wide, BY, ALL_M, ["hour_sin"])[0]


@query(
    "meta_learner_nonnegative",
    "series_id:i ds:t y_fused:d",
    f"SELECT a.series_id, ds, {_DOT('w', KA)} AS y_fused FROM (SELECT *, [{_X}] AS x FROM iw) a JOIN mn b ON {ON}",
    f"{imputed()}, {sq.quadratic('mn', 'gw', KA, 2.0, mixture=False)}",
)
def _(t):
    return learners.meta_learner(fusion.wide_frame(t.stored_panel, POINT, ALL_M), BY, ALL_M, alpha=2.0, nonnegative=True)[1]


@query(
    "multi_run_mean",
    "series_id:i ds:t period:s y_pred:d runs:i",
    "SELECT series_id, ds, CASE WHEN period = '1_8' THEN NULL ELSE period END AS period, avg(y_pred) AS y_pred, count(*) AS runs FROM panel GROUP BY ALL",
)
def _(t):
    df = t.stored_panel.withColumn("period", F.when(F.col("period") != "1_8", F.col("period")))
    return fusion.multi_run_mean(df, ["series_id", "ds", "period"])


@query(
    "fixed_window_backtest",
    "series_id:i ds:t y_true:d y_fused:d",
    f"""SELECT a.series_id, a.ds, max(m.rt) AS y_true, CASE WHEN sum(w) > 1e-9 AND abs(sum(w) - 1) > 0.01 THEN sum(w * y_pred) / sum(w) ELSE coalesce(sum(w * y_pred), 0) END AS y_fused FROM panel a
       JOIN market m ON a.series_id = m.series_id AND a.ds = m.ds
       LEFT JOIN (SELECT *, (1 / greatest(mae, 1e-6)) / sum(1 / greatest(mae, 1e-6)) OVER (PARTITION BY {BYS}) AS w FROM (SELECT {BYS}, model_name, avg(abs(y_true - y_pred)) AS mae FROM panel WHERE target_day < DATE '2024-01-21' GROUP BY ALL)) b ON {ON} AND a.model_name = b.model_name
       WHERE target_day >= DATE '2024-01-21' GROUP BY ALL""",
)
def _(t):
    truth = joins.truth_frame(t.stored_market, {"dayahead": "rt", "realtime": "rt"}, S)
    return fusion.backtest(t.stored_panel, S, "2024-01-21", truth)[1]


@query(
    "fusion_modes_report",
    "series_id:i mode:s period:s rows:i smape:d",
    f"""SELECT series_id, mode, coalesce(period, 'overall') AS period, count(*) AS rows, {smape_sql('floor50', 'y_true', 'y_fused')} AS smape FROM (
       SELECT series_id, period, y_true, y_fused, 'weights' AS mode FROM fu UNION ALL SELECT series_id, period, max(y_true), avg(y_pred), 'mean' FROM panel GROUP BY {PTS}) GROUP BY GROUPING SETS ((series_id, mode, period), (series_id, mode))""",
    f"{IMAE}, {FUSED}",
)
def _(t):
    p = t.stored_panel
    return learners.modes_report({"weights": fusion.fuse(p, fusion.inverse_mae(p, BY), BY, POINT), "mean": fusion.mean_fusion(p, POINT)}, S)


@query(
    "covariate_regression",
    "series_id:i ds:t y_hat:d",
    f"SELECT a.series_id, ds, c + {_DOT('w', 5)} AS y_hat FROM (SELECT *, [x0, x1, x2, x3, x4] AS x FROM cz) a JOIN cf b ON a.series_id = b.series_id WHERE ds > TIMESTAMP '2024-01-20 00:00:00'",
    f"""cm AS (SELECT series_id, avg(load_forecast) AS a0, stddev_pop(load_forecast) AS d0, avg(wind_forecast) AS a1, stddev_pop(wind_forecast) AS d1 FROM market WHERE ds <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL),
    cz AS (SELECT market.series_id, ds, rt AS y, coalesce((load_forecast - a0) / nullif(d0, 0), 0) AS x0, coalesce((wind_forecast - a1) / nullif(d1, 0), 0) AS x1, {", ".join(f"CAST(period = '{p}' AS DOUBLE) AS x{i + 2}" for i, p in enumerate(("1_8", "9_16", "17_24")))} FROM market JOIN cm ON market.series_id = cm.series_id),
    cg AS ({sq.gram("(SELECT * FROM cz WHERE ds <= TIMESTAMP '2024-01-20 00:00:00' AND y IS NOT NULL)", "series_id", [f"x{i}" for i in range(5)])}), {sq.ridge("cf", "cg", 5, "1.0", centred=True)}""",
)
def _(t):
    return learners.covariate_regression(t.stored_market, S, "rt", ["load_forecast", "wind_forecast"], "period", ["1_8", "9_16", "17_24"], "2024-01-20 00:00:00")
