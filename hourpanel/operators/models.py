"""The few learned models, on ``pyspark.ml`` with cluster-side training.

Fold and segment loops run on the driver because each pass is one distributed
fit; the number of passes is set by the caller, never by the data size.
Parity with other libraries' trees is statistical.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, flag
from ..session import materialise
from . import corrections, folds, fusion, quantile

SEED = 42


def _inputs(features: Sequence[str], known: Sequence[str], prefix: str = "_i_") -> list:
    """Imputed features as a vector; those not ``known`` have no median and are 0 throughout, which no tree splits on."""
    blank = ", ".join(f"0D AS `{prefix}{c}`" for c in features if c not in known)
    return [
        *([SQLTransformer(statement=f"SELECT *, {blank} FROM __THIS__")] if blank else []),
        *([Imputer(strategy="median", inputCols=list(known), outputCols=[f"{prefix}{c}" for c in known])] if known else []),
        VectorAssembler(inputCols=[f"{prefix}{c}" for c in features], outputCol="_x", handleInvalid="keep"),
    ]


def _fit(df: DataFrame, features: Sequence[str], label: str, learner):
    """Model of the rows that have a label; None if there is no such row."""
    df = df.where(F.col(label).isNotNull())
    seen = df.agg(F.count(F.lit(1)), *[F.count(F.when(~F.isnan(c), F.col(c))) for c in features]).first()
    if not seen[0]:
        return None
    return Pipeline(stages=[*_inputs(features, [c for c, n in zip(features, seen[1:], strict=True) if n]), learner]).fit(df)


def _transform(model, df: DataFrame, out: str) -> DataFrame:
    """``df`` with what the model gives; without a model ``out`` is null."""
    return df.withColumn(out, F.lit(None).cast("double")) if model is None else model.transform(df)


def balanced(df: DataFrame, label: str, out: str = "_weight") -> DataFrame:
    """Class weights n / (2 n_class) from one count per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k")).first()
    weights = counts.withColumn(out, F.lit(total["_all"]) / (F.lit(total["_k"]) * F.col("_n"))).drop("_n")
    return df.join(weights, label)


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def fit_risk(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 6):
    """Class-balanced random forest over imputed features; None if no row has a label."""
    df = balanced(_doubles(df, [*features, label]), label)
    rf = RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol="_weight", numTrees=trees, maxDepth=depth, seed=SEED)
    return _fit(df, features, label, rf)


def risk_probability(model, df: DataFrame, features: Sequence[str], out: str = "risk") -> DataFrame:
    """Probability of class 1; 0 from a model that has seen only class 0, whose vectors have one element; null without a model."""
    keep = df.columns
    if model is None:
        return _transform(None, _doubles(df, features), out).select(*keep, out)
    scored = model.transform(_doubles(df, features))
    return scored.withColumn(out, F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))).select(*keep, out)


def walk_forward_risk(
    df: DataFrame, features: Sequence[str], label: str, start: str, end: str, step_days: int = 7, train_days: int = 30,
    fallback: str = "low_valley_prob", trees: int = 30, depth: int = 5,
) -> DataFrame:
    """Risk for each block of days from a model of the days before it.

    Blocks without history or without both classes keep the heuristic score.
    """
    import datetime as dt

    df = materialise(df, "walk")
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    parts = []
    while a <= b:
        last = min(a + dt.timedelta(days=step_days - 1), b)
        train = df.where((F.col("business_day") < F.lit(a)) & (F.col("business_day") >= F.lit(a - dt.timedelta(days=train_days))))
        block = df.where(F.col("business_day").between(F.lit(a), F.lit(last)))
        seen = train.agg(F.count_distinct(label).alias("k")).first()["k"]
        if seen and seen > 1:
            model = fit_risk(train, features, label, trees, depth)
            parts.append(risk_probability(model, block, features).withColumn("risk_source", F.lit("model")))
        else:
            parts.append(block.withColumns({"risk": F.col(fallback), "risk_source": F.lit("heuristic_v2")}))
        a = last + dt.timedelta(days=1)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Gray zone and hour floor of the two-stage detector.
GRAY = (0.25, 0.65)
MIN_GRAY_ROWS = 100
LOW_PROB, HOUR_SHARE = 0.01, 0.3


def spike_detector(train: DataFrame, score: DataFrame, features: Sequence[str], label: str, series: Sequence[str] = (), iterations: int = 20, depth: int = 3, strict_fix: bool = False) -> DataFrame:
    """Boosted trees, a second model inside the gray zone, and a floor by hourly spike rate.

    The compared results drop the second stage's values; ``strict_fix`` uses them.
    """
    def boosted(d: DataFrame, cols: Sequence[str], n: int):
        gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=n, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=SEED)
        return _fit(_doubles(d, [*cols, label]), cols, label, gbt)

    first = boosted(train, features, iterations)
    scored = risk_probability(first, score, features, "p1")
    p = F.col("p1")
    if strict_fix:
        seen = materialise(risk_probability(first, train, features, "p1"), "gray").where(F.col("p1").between(*GRAY))
        if seen.limit(MIN_GRAY_ROWS + 1).count() > MIN_GRAY_ROWS and seen.agg(F.count_distinct(label)).first()[0] > 1:
            second = boosted(seen, [*features, "p1"], iterations)
            scored = risk_probability(second, scored, [*features, "p1"], "p2")
            p = F.when(F.col("p1").between(*GRAY), F.col("p2")).otherwise(F.col("p1"))
    rates = train.groupBy(*series, "hour_business").agg(F.avg(F.col(label).cast("double")).alias("_rate"))
    out = scored.withColumn("_p", p).join(rates, [*series, "hour_business"], "left")
    low = F.greatest(F.col("_p"), F.coalesce("_rate", F.lit(0.1)) * HOUR_SHARE)
    return out.withColumn("spike_prob", F.when(F.col("_p") < LOW_PROB, low).otherwise(F.col("_p"))).drop("_p", "_rate", "p2")


# Label clip quantile of the segment models.
LABEL_CLIP = 0.995


def segment_regression(
    train: DataFrame, score: DataFrame, features: Sequence[str], label: str, series: Sequence[str], weight: str | None = None,
    iterations: int = 20, depth: int = 4, negative: bool = True,
) -> DataFrame:
    """One boosted regressor per period, and a negative-price classifier that pushes 9_16 down."""
    cap = quantile.quantiles(train, [*series, "period"], label, {"_cap": LABEL_CLIP})
    data = train.join(cap, [*series, "period"]).withColumn(label, F.least(F.col(label), F.col("_cap"))).drop("_cap")
    data = materialise(_doubles(data, [*features, label]), "segments")
    score = _doubles(score, features)
    out = None
    for name in ("1_8", "9_16", "17_24"):
        kw = {"weightCol": weight} if weight else {}
        reg = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=iterations, maxDepth=depth, seed=SEED, predictionCol="y_hat", **kw)
        part = data.where(F.col("period") == name)
        pred = _transform(_fit(part, features, label, reg), score.where(F.col("period") == name), "y_hat").select(*score.columns, "y_hat")
        if name == "9_16" and negative:
            marked = part.withColumn("_neg", flag(F.col(label) < 0))
            if marked.agg(F.count_distinct("_neg")).first()[0] > 1:
                clf = fit_risk(marked, features, "_neg", trees=30, depth=5)
                pred = risk_probability(clf, pred, features, "_np")
                pred = pred.withColumn("y_hat", F.when((F.col("_np") > 0.6) & (F.col("y_hat") > -20), F.col("y_hat") - 100).otherwise(F.col("y_hat"))).drop("_np")
        out = pred if out is None else out.unionByName(pred)
    return out.withColumn("y_hat", F.greatest("y_hat", F.lit(-80.0)))


def choose_window(df: DataFrame, features: Sequence[str], label: str, series: Sequence[str], val_start: str, windows_days: Sequence[int], **kw) -> DataFrame:
    """Validation error per training-window length; ``chosen`` is the best, ties to the shorter."""
    from ..functions import scores
    from pyspark.sql import Window as W

    start = F.lit(val_start).cast("date")
    val = df.where(F.col("business_day") >= start)
    out = None
    for days in windows_days:
        train = df.where((F.col("business_day") < start) & (F.col("business_day") >= F.date_sub(start, days)))
        pred = segment_regression(train, val, features, label, series, **kw)
        s = pred.groupBy(*series).agg(scores.smape("floor50", label, "y_hat").alias("smape")).withColumn("window_days", F.lit(days))
        out = s if out is None else out.unionByName(s)
    return out.withColumn("chosen", F.row_number().over(W.partitionBy(*series).orderBy("smape", "window_days")) == 1)


def delta_regression(train: DataFrame, score: DataFrame, features: Sequence[str], weight: str | None = None, by_segment: bool = False, iterations: int = 20, depth: int = 4) -> DataFrame:
    """Boosted regressor of rt - da; rt_hat = da + delta_hat."""
    kw = {"weightCol": weight} if weight else {}
    parts = [(p, F.col("period") == p) for p in ("1_8", "9_16", "17_24")] if by_segment else [("all", F.lit(True))]
    out = None
    score = _doubles(score, features)
    for _, cond in parts:
        reg = GBTRegressor(featuresCol="_x", labelCol="delta_target", maxIter=iterations, maxDepth=depth, seed=SEED, predictionCol="delta_hat", **kw)
        model = _fit(_doubles(train.where(cond), features), features, "delta_target", reg)
        pred = _transform(model, score.where(cond), "delta_hat").select(*score.columns, "delta_hat")
        out = pred if out is None else out.unionByName(pred)
    return out.withColumn("rt_hat", F.col("da") + F.col("delta_hat"))


def rolling_delta(df: DataFrame, features: Sequence[str], plan: Sequence[tuple[str, str]], **kw) -> DataFrame:
    """Delta regression per fold: train before each test window, score inside it."""
    df = materialise(df, "delta")
    out = None
    for a, b in plan:
        test = df.where(F.col("business_day").between(F.lit(a).cast("date"), F.lit(b).cast("date")))
        part = delta_regression(df.where(F.col("business_day") < F.lit(a).cast("date")), test, features, **kw)
        part = part.withColumn("fold_start", F.lit(a))
        out = part if out is None else out.unionByName(part)
    return out


def out_of_fold_probability(df: DataFrame, series: Sequence[str], features: Sequence[str], label: str, k: int = 5, trees: int = 30, depth: int = 5) -> DataFrame:
    """For every row the probability from a model of the other contiguous folds."""
    tagged = materialise(folds.contiguous_folds(df, series, k), "oof")
    out = None
    for i in range(k):
        model = fit_risk(tagged.where(F.col("fold") != i), features, label, trees, depth)
        part = risk_probability(model, tagged.where(F.col("fold") == i), features, "oof_prob")
        out = part if out is None else out.unionByName(part)
    return out


def boosted_stack(df: DataFrame, point: Sequence[str], models: Sequence[str], split_day: str, iterations: int = 20, depth: int = 3) -> DataFrame:
    """Boosted trees on the models' predictions per (task, period), fitted before the split and applied after it."""
    wide = materialise(fusion.wide_frame(df, point, models), "stack")
    d = F.lit(split_day).cast("date")
    out = None
    for task in ("dayahead", "realtime"):
        for period in ("1_8", "9_16", "17_24"):
            part = wide.where((F.col("task") == task) & (F.col("period") == period))
            reg = GBTRegressor(featuresCol="_x", labelCol="y_true", maxIter=iterations, maxDepth=depth, seed=SEED, predictionCol="y_fused")
            model = _fit(part.where(F.col("target_day") < d), models, "y_true", reg)
            pred = _transform(model, part.where(F.col("target_day") >= d), "y_fused").select(*wide.columns, "y_fused")
            out = pred if out is None else out.unionByName(pred)
    return out
