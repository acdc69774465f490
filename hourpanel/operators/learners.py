"""Learners that choose or update weights over validation folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, scores
from ..functions.numeric import clip
from ..session import materialise
from . import folds, fusion, metrics, quantile, solve

GROUP = list(fusion.GROUP)
DAY_POINT = ("target_day", "ds", "hour_business")


def gated_losses(df: DataFrame, by: Sequence[str], models: int, tau: float = 30.0, loss_clip: float = 5.0) -> DataFrame:
    """Daily loss per model on fully predicted points, over the day's median, clipped, with its age gate."""
    by = list(by)
    full = fusion.complete_points(df, [*by, *DAY_POINT], models)
    daily = full.groupBy(*by, "target_day", "model_name").agg(scores.smape("floor50", "y_true", "y_pred").alias("loss"))
    med = daily.groupBy(*by, "target_day").agg(F.median("loss").alias("_med"))
    last = daily.groupBy(*by).agg(F.max("target_day").alias("_last"))
    m = F.when(F.col("_med") < 1e-9, 1.0).otherwise(F.col("_med"))
    return (
        daily.join(med, [*by, "target_day"])
        .join(last, by)
        .withColumns(
            {
                "normalized_loss": clip(F.col("loss") / m, 0.0, loss_clip),
                "gate": F.exp(-F.datediff("_last", "target_day") / tau),
            }
        )
        .drop("_med", "_last")
    )


def bgew(df: DataFrame, by: Sequence[str], models: int, tau: float = 30.0, eta: float = 0.5) -> DataFrame:
    """Exponential weights over daily gated losses in closed form.

    Each update multiplies by exp(-eta gate loss) and normalises; the
    normalisers cancel, so the final weights are a softmax of the summed losses.
    """
    g = gated_losses(df, by, models, tau)
    total = g.groupBy(*by, "model_name").agg((-eta * F.sum(F.col("gate") * F.col("normalized_loss"))).alias("_z"))
    return fusion.softmax(total, by, "_z").drop("_z")


def bgew_trace(df: DataFrame, by: Sequence[str], models: int, tau: float = 30.0, eta: float = 0.5) -> DataFrame:
    """Weights after each day: running sums per model (one row per day), softmax across models."""
    g = gated_losses(df, by, models, tau)
    upto = W.partitionBy(*by, "model_name").orderBy("target_day").rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumn("_z", -eta * F.sum(F.col("gate") * F.col("normalized_loss")).over(upto))
    return fusion.softmax(g, [*by, "target_day"], "_z", "weight_after").drop("_z")


# Decay constants and update limits of the tap learner.
TAU_BLOCK, TAU_HORIZON, TAU_DAYS = 3.0, 2.0, 14.0
ETA, FLOOR, EVIDENCE = 0.8, 0.03, 5.0
LOSS_MIX = (0.6, 0.3, 0.1)
LOSS_RANGE = (0.25, 4.0)


def sample_gate(df: DataFrame) -> Column:
    """Decay by block age, horizon and day age, times source confidence."""
    age, horizon = F.col("age_block"), F.col("horizon_day")
    days = F.exp(-F.col("age_days") / TAU_DAYS) if "age_days" in df.columns else F.exp(-age * 3 / TAU_DAYS)
    conf = F.coalesce("source_confidence", F.lit(1.0)) if "source_confidence" in df.columns else F.lit(1.0)
    one = F.lit(1.0)
    return (
        F.coalesce(F.exp(-age / TAU_BLOCK), one) * F.coalesce(F.exp(-(horizon - 1) / TAU_HORIZON), one) * F.coalesce(days, one) * conf
    )


def fold_losses(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Composite gated loss per (group, fold, model), the fold's mean gate and median loss."""
    by = list(by)
    key = [*by, "tap_fold_id", "model_name"]
    ok = df.where(F.col("y_true").isNotNull())
    gates = ok.groupBy(*by, "tap_fold_id", "age_block", "ds").agg(F.max("sample_gate").alias("_g"))
    gates = gates.groupBy(*by, "tap_fold_id", "age_block").agg(F.avg("_g").alias("mean_gate"))
    rows = ok.where(F.col("y_pred").isNotNull()).withColumn("_abs", F.abs("y_true"))
    cuts = quantile.column_quantiles(rows, key, {"_med": ("_abs", 0.5), "_q90": ("y_true", 0.90)})
    gap = F.abs(F.col("y_true") - F.col("y_pred"))
    w = F.col("sample_gate")
    peak = F.col("y_true") >= F.col("_q90")
    losses = (
        rows.join(cuts, key)
        .groupBy(*key)
        .agg(
            scores.weighted_mean(scores.smape_row("floor50", "y_true", "y_pred"), w).alias("_s"),
            scores.weighted_mean(gap / F.greatest("_med", F.lit(1e-6)), w).alias("_n"),
            scores.weighted_mean(F.when(peak, gap), w).alias("_p"),
        )
        .withColumn("loss", LOSS_MIX[0] * F.col("_s") + LOSS_MIX[1] * F.coalesce("_n", "_s") + LOSS_MIX[2] * F.coalesce("_p", "_s"))
        .drop("_s", "_n", "_p")
    )
    med = losses.groupBy(*by, "tap_fold_id").agg(F.median("loss").alias("median_loss"), F.count(F.lit(1)).alias("_models"))
    return losses.join(med, [*by, "tap_fold_id"]).join(gates, [*by, "tap_fold_id"]).where("_models >= 2").drop("_models")


def tap_update(losses: DataFrame, by: Sequence[str], models: Sequence[str], eta: float = ETA, floor: float = FLOOR) -> DataFrame:
    """Fold by fold from newest to oldest: w exp(-eta gate loss), floor, renormalise.

    The floor makes the steps order-dependent, so the at most ten folds of a
    group are folded as an array of loss vectors.
    """
    by, k = list(by), len(models)
    per_fold = losses.groupBy(*by, "tap_fold_id", "age_block", "mean_gate").agg(
        *[
            F.max(F.when(F.col("model_name") == m, F.col("loss") / F.greatest("median_loss", F.lit(1e-6)))).alias(f"_l{i}")
            for i, m in enumerate(models)
        ]
    )
    step = F.struct("age_block", F.col("mean_gate").alias("g"), F.array(*[F.col(f"_l{i}") for i in range(k)]).alias("l"))
    arr = per_fold.groupBy(*by).agg(F.array_sort(F.collect_list(step)).alias("_f"))

    def update(w, f):
        raw = F.zip_with(
            w,
            f["l"],
            lambda a, l: F.when(l.isNull(), a).otherwise(
                F.greatest(a * F.exp(-eta * f["g"] * clip(l, *LOSS_RANGE)), F.lit(floor))
            ),
        )
        total = F.aggregate(raw, F.lit(0.0), lambda acc, v: acc + v)
        return F.transform(raw, lambda v: v / total)

    start = F.array(*[F.lit(1.0 / k)] * k)
    found = arr.select(*by, F.aggregate("_f", start, update).alias("weights"))
    return fusion.as_long(found, by, models)


def shrink(df: DataFrame, weights: DataFrame, by: Sequence[str], prior: DataFrame | None = None, evidence: float = EVIDENCE, floor: float = FLOOR) -> DataFrame:
    """Mix learned and prior weights by the gate mass each model has seen, floor, renormalise."""
    by = list(by)
    mass = df.groupBy(*by, "model_name").agg(F.sum("sample_gate").alias("_m"))
    j = weights.join(mass, [*by, "model_name"], "left").withColumn("_m", F.coalesce("_m", F.lit(0.0)))
    if prior is None:
        j = j.withColumn("_p", 1 / F.count(F.lit(1)).over(W.partitionBy(*by)))
    else:
        j = j.join(prior.select(*by, "model_name", F.col("weight").alias("_p")), [*by, "model_name"], "left")
        j = j.withColumn("_p", F.coalesce("_p", 1 / F.count(F.lit(1)).over(W.partitionBy(*by))))
    conf = F.col("_m") / (F.col("_m") + evidence)
    j = j.withColumn("_w", F.greatest(conf * F.col("weight") + (1 - conf) * F.col("_p"), F.lit(floor)))
    return fusion.normalised(j.drop("weight"), by, "_w").select(*by, "model_name", conf.alias("confidence"), "weight")


def tap_refit(df: DataFrame, by: Sequence[str], models: Sequence[str], prior: DataFrame, lam: float = 0.05, floor: float = FLOOR) -> DataFrame:
    """Least gated composite loss near the prior, no weight below the floor."""
    point = [*by, "ds"]
    wide = fusion.wide_frame(df, point, models, ["sample_gate"])
    found = fusion.convex_search(wide, by, models, "composite", lam, prior, (floor, 1.0), weight="sample_gate")
    return fusion.as_long(found, by, models)


def tap_learner(df: DataFrame, by: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Gate, update, shrink and refit: final weights of the tap learner."""
    df = materialise(df.withColumn("sample_gate", sample_gate(df)), "tap")
    learned = tap_update(fold_losses(df, by), by, models)
    shrunk = shrink(df, learned, by).select(*by, "model_name", "weight")
    return tap_refit(df, by, models, shrunk)


# Complexity order of candidate kinds; simpler wins inside the tolerance.
COMPLEXITY = {"single_model": 0, "equal_weight": 1, "static_convex": 2, "bgew": 3}
TOLERANCE = 1e-3


def candidate_weights(df: DataFrame, by: Sequence[str], models: Sequence[str], convex: bool = True) -> DataFrame:
    """candidate_name, selected_mode, position and a weight array per group."""
    by, k = list(by), len(models)
    groups = df.select(*by).distinct()
    fixed = [("equal_weight", "equal_weight", 0, [1.0 / k] * k)]
    fixed += [(f"single_{m}", "single_model", 3 + i, [1.0 if j == i else 0.0 for j in range(k)]) for i, m in enumerate(models)]
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("candidate_name"), F.lit(mode).alias("selected_mode"), F.lit(o).alias("position"), F.array(*[F.lit(float(v)) for v in w]).alias("weights"))
            for n, mode, o, w in fixed
        ]
    )
    out = groups.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*")
    b = bgew(df, by, k).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("model_name", "weight"))).alias("_m"))
    b = b.select(*by, F.lit("bgew").alias("candidate_name"), F.lit("bgew").alias("selected_mode"), F.lit(2).alias("position"),
                 F.array(*[F.coalesce(F.try_element_at("_m", F.lit(m)), F.lit(0.0)) for m in models]).alias("weights"))
    out = out.unionByName(b)
    if convex:
        wide = fusion.wide_frame(df, [*by, *DAY_POINT], models)
        c = fusion.convex_search(wide, by, models, starts=b.select(*by, "weights"))
        out = out.unionByName(
            c.select(*by, F.lit("static_convex").alias("candidate_name"), F.lit("static_convex").alias("selected_mode"), F.lit(1).alias("position"), "weights")
        )
    return out


def evaluate_candidates(df: DataFrame, candidates: DataFrame, by: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Score of every candidate on fully predicted points, and the share of points kept."""
    by = list(by)
    wide = fusion.wide_frame(df, [*by, *DAY_POINT], models)
    x = F.array(*[F.col(m) for m in models])
    full = F.forall(x, lambda v: v.isNotNull())
    keep = wide.groupBy(*by).agg(F.avg(full.cast("double")).alias("intersection_retention_rate"))
    j = wide.where(full).withColumn("_x", x).join(candidates, by)
    f = F.aggregate(F.zip_with("weights", "_x", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return (
        j.withColumn("_f", f)
        .groupBy(*by, "candidate_name", "selected_mode", "position", "weights")
        .agg(scores.smape("floor50", "y_true", "_f").alias("score"), scores.mae("y_true", "_f").alias("mae"), F.count(F.lit(1)).alias("n"))
        .join(keep, by)
    )


def choose_candidate(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mark the winner: within 0.1 % of the best score the simplest kind, then listing order."""
    part = W.partitionBy(*by)
    best = F.min("score").over(part)
    rank_kind = F.lit(9)
    for mode, c in COMPLEXITY.items():
        rank_kind = F.when(F.col("selected_mode") == mode, c).otherwise(rank_kind)
    near = F.col("score") <= best + F.greatest(F.abs(best) * TOLERANCE, F.lit(1e-9))
    df = scored.withColumns({"_far": (~near).cast("int"), "_kind": rank_kind})
    rank = F.row_number().over(part.orderBy("_far", "_kind", "position"))
    return df.withColumn("chosen", rank == 1).drop("_far", "_kind")


def holdout_learner(df: DataFrame, by: Sequence[str], models: Sequence[str], convex: bool = True) -> tuple[DataFrame, DataFrame]:
    """(routing, weights): candidates fitted on earlier months, judged on each group's last month, refitted on all."""
    by = list(by)
    df = materialise(df, "oof")
    month = F.date_format("target_day", "yyyy-MM")
    span = df.groupBy(*by).agg(F.max(month).alias("_last"), F.count_distinct(month).alias("_months"))
    j = df.join(span, by)
    several = F.col("_months") > 1
    fit = j.where(~several | (month < F.col("_last"))).drop("_last", "_months")
    judge = j.where(~several | (month == F.col("_last"))).drop("_last", "_months")
    fitted = materialise(candidate_weights(fit, by, models, convex), "candidates")
    routing = choose_candidate(evaluate_candidates(judge, fitted, by, models), by).where("chosen").drop("weights", "chosen")
    again = candidate_weights(df, by, models, convex)
    final = again.join(routing.select(*by, "candidate_name"), [*by, "candidate_name"])
    weights = fusion.as_long(final.select(*by, "weights"), by, models)
    return routing, weights


def apply_routing(df: DataFrame, routing: DataFrame, weights: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Chosen single model, or fusion normalised over the models seen that day; equal weights as fallback."""
    by = [*series, *GROUP]
    point = [*series, *fusion.POINT]
    day = [*by, "target_day"]
    r = routing.select(
        *by, "selected_mode",
        F.when(F.col("selected_mode") == "single_model", F.regexp_replace("candidate_name", "^single_", "")).alias("selected_model"),
    )
    seen = df.groupBy(*day, "model_name").agg(F.count(F.lit(1)).alias("_n"))
    seen = seen.join(weights.select(*by, "model_name", "weight"), [*by, "model_name"], "left")
    part = W.partitionBy(*day)
    seen = seen.join(r, by)
    tot = F.sum(F.coalesce("weight", F.lit(0.0))).over(part)
    cnt = F.count(F.lit(1)).over(part)
    has = F.max((F.col("model_name") == F.col("selected_model")).cast("int")).over(part)
    seen = seen.withColumns({"_t": tot, "_c": cnt, "_h": has})
    single = F.col("selected_mode") == "single_model"
    w = (
        F.when(single & (F.col("_h") == 1), (F.col("model_name") == F.col("selected_model")).cast("double"))
        .when(single, 1 / F.col("_c"))
        .when(F.col("_t") < 1e-9, 1 / F.col("_c"))
        .otherwise(F.coalesce("weight", F.lit(0.0)) / F.col("_t"))
    )
    mode = F.when(single & (F.col("_h") == 0), "equal_weight_fallback").otherwise(F.col("selected_mode"))
    plan = seen.select(*day, "model_name", w.alias("_w"), mode.alias("selected_mode"))
    j = df.join(plan, [*day, "model_name"])
    used = F.when((F.col("_w") > 0) & F.col("y_pred").isNotNull(), F.format_string("%s=%.3f", F.col("model_name"), F.col("_w")))
    out = j.groupBy(*point, "selected_mode").agg(
        F.max("y_true").alias("y_true"),
        F.sum(F.col("_w") * F.col("y_pred")).alias("y_fused"),
        F.concat_ws(",", F.array_sort(F.collect_set("model_name"))).alias("available_models"),
        F.concat_ws(",", F.array_sort(F.collect_list(used))).alias("weight_summary"),
    )
    return out


def short_days(fused: DataFrame, keys: Sequence[str], rows: int = 24) -> DataFrame:
    """(task, day) without the expected number of rows."""
    return fused.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") != rows)


def time_folds(wide: DataFrame, by: Sequence[str], k: int = 3) -> DataFrame:
    """``fold`` 0 for the rows only ever trained on, 1..k for k validation blocks at the end, in time order.

    The size of a block is n // (k + 1), as a time-series split has it.
    """
    from . import rowblocks

    out = rowblocks.with_row_index(wide, list(by), ["ds"], F.to_date("ds"), "_i", total="_n", staged=True)
    size = F.greatest(F.floor(F.col("_n") / (k + 1)), F.lit(1))
    fold = F.greatest(F.floor((F.col("_i") - (F.col("_n") - k * size)) / size) + 1, F.lit(0))
    return out.withColumn("fold", fold.cast("int")).drop("_i", "_n")


def best_single(wide: DataFrame, by: Sequence[str], models: Sequence[str], cv: bool = True) -> DataFrame:
    """Model with the lowest sMAPE per group, over all rows or as mean over validation folds."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("model_name"), F.col(m).alias("p")) for i, m in enumerate(models)])
    long = wide.select(*by, *(["fold"] if cv else []), "y_true", F.explode(cells).alias("_m"))
    long = long.where(F.col("_m.p").isNotNull() & F.col("y_true").isNotNull())
    err = scores.smape("floor50", F.col("y_true"), F.col("_m.p"))
    if cv:
        g = long.where("fold > 0").groupBy(*by, "fold", F.col("_m.i").alias("i"), F.col("_m.model_name").alias("model_name")).agg(err.alias("_s"))
        g = g.groupBy(*by, "i", "model_name").agg(F.avg("_s").alias("smape"))
    else:
        g = long.groupBy(*by, F.col("_m.i").alias("i"), F.col("_m.model_name").alias("model_name")).agg(err.alias("smape"))
    best = g.groupBy(*by).agg(F.min_by(F.struct("model_name", "smape"), F.struct("smape", "i")).alias("_b"))
    return best.select(*by, F.col("_b.model_name").alias("best_single_model"), F.col("_b.smape").alias("best_single_smape"))


# The rule that lets a learner pass although it is slightly worse.
META_FLOOR_POINTS = 0.5
META_FLOOR_MODELS = 3


def learner_gate(cv_smape: Column, best_cv: Column, models: int, margin: float = 0.0, floor: bool = True) -> Column:
    """strict, meta_floor or best_single."""
    out = F.when(cv_smape + margin < best_cv, "strict")
    if floor and models >= META_FLOOR_MODELS:
        out = out.when(cv_smape - best_cv < META_FLOOR_POINTS, "meta_floor")
    return out.otherwise("best_single")


def impute_median(wide: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    med = quantile.column_quantiles(wide, by, {f"_m_{c}": (c, 0.5) for c in columns})
    j = wide.join(med, list(by))
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}).drop(*[f"_m_{c}" for c in columns])


# Ridge penalties tried by the router.
ALPHAS = (0.01, 0.1, 0.5, 1.0, 2.0, 5.0)


def router(wide: DataFrame, by: Sequence[str], models: Sequence[str], alphas: Sequence[float] = ALPHAS, k: int = 3, margin: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(report, weights): ridge penalty by time-series folds, kept only if it beats the best single model.

    Statistics are summed once per (group, fold); the training part of a fold is
    the running sum of the folds before it. All penalties are solved from the
    same sums and scored in one pass over the rows.
    """
    by, kk = list(by), len(models)
    data = materialise(time_folds(impute_median(wide.where(F.col("y_true").isNotNull()), by, models), by, k), "router")
    raw = solve.gram(data, [*by, "fold"], models)
    before = W.partitionBy(*by).orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)

    def summed(w, size, c):
        return F.array(*[F.sum(F.col(c)[i]).over(w) for i in range(size)])

    def spread(w):
        return raw.select(
            *by, "fold", summed(w, kk * kk, "g").alias("g"), summed(w, kk, "b").alias("b"), summed(w, kk, "s").alias("s"),
            F.sum("sy").over(w).alias("sy"), F.sum("n").over(w).alias("n"),
        )

    train = spread(before).where("fold > 0")
    x = F.array(*[F.col(m) for m in models])
    fits = None
    for i, a in enumerate(alphas):
        udf = solve.fit_column("ridge_projected", kk, alpha=a)
        one = train.select(*by, "fold", F.lit(i).alias("i"), F.lit(float(a)).alias("alpha"), udf("g", "b", "s", "sy", "n").alias("_w"))
        fits = one if fits is None else fits.unionByName(one)
    f = F.aggregate(F.zip_with("_w", "_x", lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    held = data.where("fold > 0").withColumn("_x", x).join(fits, [*by, "fold"]).withColumn("_f", f)
    cv = held.groupBy(*by, "fold", "i", "alpha").agg(scores.smape("floor50", "y_true", "_f").alias("_s"))
    cv = cv.groupBy(*by, "i", "alpha").agg(F.avg("_s").alias("cv_smape"))
    best = cv.groupBy(*by).agg(F.min_by(F.struct("alpha", "cv_smape"), F.struct("cv_smape", "i")).alias("_b"))
    best = best.select(*by, F.col("_b.alpha").alias("best_alpha"), F.col("_b.cv_smape").alias("cv_smape"))
    single = best_single(data, by, models, cv=True)
    overall = best_single(data, by, models, cv=False).select(*by, F.col("best_single_model").alias("_all"))
    report = best.join(single, by).join(overall, by)
    report = report.withColumns({"use_router": F.col("cv_smape") + margin < F.col("best_single_smape"), "best_single_model": F.col("_all")}).drop("_all")
    report = materialise(report, "report")
    final = spread(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).where("fold = 0").drop("fold")
    weights = None
    for a in alphas:
        part = final.join(report.where(F.col("best_alpha") == float(a)).select(*by), by)
        w = solve.solve(part, by, models, "ridge_projected", alpha=a)
        weights = w if weights is None else weights.unionByName(w)
    gated = weights.join(report.select(*by, "use_router", "best_single_model"), by)
    gated = gated.withColumn(
        "weight", F.when(F.col("use_router"), F.col("weight")).otherwise((F.col("model_name") == F.col("best_single_model")).cast("double"))
    )
    return report, gated.select(*by, "model_name", "weight")


def meta_learner(
    wide: DataFrame, by: Sequence[str], models: Sequence[str], extras: Sequence[str] = (), alpha: float = 1.0, k: int = 3, nonnegative: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(report, predictions): ridge on model predictions and extra features per group, behind the learner gate.

    ``nonnegative`` is the plain form: no intercept, weights >= 0, no gate.
    Where the gate says best_single, that model's own value is the prediction.
    """
    by, cols = list(by), [*models, *extras]
    size = len(cols)
    data = materialise(time_folds(impute_median(wide.where(F.col("y_true").isNotNull()), by, cols), by, k), "meta")
    x = F.array(*[F.col(c).cast("double") for c in cols], *([] if nonnegative else [F.lit(1.0)]))
    dot = F.aggregate(F.zip_with("_w", x, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    whole = solve.gram(data, by, cols)
    if nonnegative:
        coef = whole.select(*by, solve.fit_column("ridge_nonnegative", size, alpha=alpha)("g", "b", "s", "sy", "n").alias("_w"))
        out = data.join(coef, by).withColumn("y_fused", dot).drop("_w", "fold")
        return coef.withColumnRenamed("_w", "coefficients"), out
    fit = solve.fit_column("ridge_intercept", size, alpha=alpha)
    sums = solve.gram(data, [*by, "fold"], cols)
    before = W.partitionBy(*by).orderBy("fold").rowsBetween(W.unboundedPreceding, -1)

    def run(c, n):
        return F.array(*[F.sum(F.col(c)[i]).over(before) for i in range(n)]).alias(c)

    train = sums.select(*by, "fold", run("g", size * size), run("b", size), run("s", size), F.sum("sy").over(before).alias("sy"), F.sum("n").over(before).alias("n"))
    coefs = train.where("fold > 0").select(*by, "fold", fit("g", "b", "s", "sy", "n").alias("_w"))
    cv = data.join(coefs, [*by, "fold"]).withColumn("_f", dot).groupBy(*by, "fold").agg(scores.smape("floor50", "y_true", "_f").alias("_s"))
    report = cv.groupBy(*by).agg(F.avg("_s").alias("cv_smape")).join(best_single(data, by, models, cv=True), by)
    report = report.withColumn("gate", learner_gate(F.col("cv_smape"), F.col("best_single_smape"), len(models)))
    report = report.join(whole.select(*by, fit("g", "b", "s", "sy", "n").alias("coefficients")), by)
    single = F.coalesce(*[F.when(F.col("best_single_model") == m, F.col(m)) for m in models])
    out = data.join(report.select(*by, "gate", "best_single_model", F.col("coefficients").alias("_w")), by)
    out = out.withColumn("y_fused", F.when(F.col("gate") == "best_single", single).otherwise(dot))
    return report, out.drop("_w", "fold", "best_single_model")


def spike_aware_fit(df: DataFrame, by: Sequence[str], models: Sequence[str], templates: DataFrame, reg: float = 0.1, prob: str = "spike_prob") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, fused, affine): segment weights near inverse error, 9_16 templates, affine calibration."""
    by = list(by)
    point = list(dict.fromkeys([*by, *fusion.POINT]))
    full = fusion.complete_points(df, point, len(models))
    prior = fusion.project_weights(fusion.inverse_mae(full, by).select(*by, "model_name", "weight"), by)
    wide = fusion.wide_frame(full, point, models)
    found = fusion.convex_search(wide, by, models, "floor50", reg, prior, fusion.BOUNDS)
    weights = materialise(fusion.as_long(found, by, models), "weights")
    fused = materialise(fusion.fuse_spike_aware(df, weights, templates, by, point, prob), "fused")
    affine = fusion.affine_search(fused, by)
    return weights, fusion.apply_affine(fused, affine, by), affine


def modes_report(modes: dict[str, DataFrame], by: Sequence[str]) -> DataFrame:
    """Scores per mode and period with an overall row."""
    stack = None
    for name, df in modes.items():
        part = df.select(*by, "period", "y_true", "y_fused").withColumn("mode", F.lit(name))
        stack = part if stack is None else stack.unionByName(part)
    return metrics.with_overall(stack, [*by, "mode"], "period", metrics.standard_aggs("y_true", "y_fused"))


def covariate_regression(df: DataFrame, series: Sequence[str], y: str, numeric: Sequence[str], category: str, levels: Sequence[object], context_end: str, alpha: float = 1.0) -> DataFrame:
    """Ridge of y on z-scored covariates and one-hot levels, fitted on the context and predicted for the horizon.

    Per series the context becomes one row of cross products; the rows of the
    horizon meet their coefficients by a join.
    """
    series = list(series)
    end = F.lit(context_end).cast("timestamp_ntz")
    ctx = df.where(F.col("ds") <= end)
    moments = ctx.groupBy(*series).agg(*[F.avg(c).alias(f"_mu_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in numeric])
    j = df.join(moments, series)
    feats = [f"_z{i}" for i in range(len(numeric))] + [f"_h{i}" for i in range(len(levels))]
    j = j.withColumns(
        {
            **{f"_z{i}": F.coalesce((F.col(c) - F.col(f"_mu_{c}")) / F.nullif(F.col(f"_sd_{c}"), F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(numeric)},
            **{f"_h{i}": (F.col(category) == F.lit(v)).cast("double") for i, v in enumerate(levels)},
        }
    )
    stats = solve.gram(j.where(F.col("ds") <= end), series, feats, y)
    coef = stats.select(*series, solve.fit_column("ridge_intercept", len(feats), alpha=alpha)("g", "b", "s", "sy", "n").alias("_w"))
    x = F.array(*[F.col(f) for f in feats], F.lit(1.0))
    out = j.where(F.col("ds") > end).join(coef, series)
    return out.withColumn(
        "y_hat", F.aggregate(F.zip_with("_w", x, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    ).select(*df.columns, "y_hat")
