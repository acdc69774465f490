import datetime as dt
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourpanel import fixed, session
from hourpanel.operators import checks, corrections, dedupe, intraday, joins, ledger, normalize, plugins
from hourpanel.session import scratch_path
from hourpanel.sources import adapters, sinks, tables
from hourpanel.streaming import jobs

S = ["series_id"]
DAY = dt.date(2024, 1, 5)


def pack(make, rows):
    cols = ["series_id", "business_day", "hour_business", "period", "base_fused_pred", "high_spike_prob", "negative_prob", "low_valley_prob", "y_true"]
    return make(pd.DataFrame([(0, DAY, h, "1_8" if h <= 8 else "9_16" if h <= 16 else "17_24", b, p, n, l, 0.0) for h, b, p, n, l in rows], columns=cols))


def test_lift_rules(make):
    df = pack(make, [(12, 100.0, 0.59, 0, 0), (12, 100.0, 0.60, 0, 0), (12, 1000.0, 0.9, 0, 0), (3, 1000.0, 0.62, 0, 0), (3, 1000.0, 0.7, 0, 0), (12, -5.0, 0.9, 0, 0)])
    cand = make(pd.DataFrame([(0, p, 40.0) for p in fixed.PERIODS], columns=["series_id", "period", "lift_candidate"]))
    got = {(r.hour_business, r.base_fused_pred, r.high_spike_prob): r for r in corrections.apply_spike(df, S, cand).collect()}
    assert got[(12, 100.0, 0.59)].reason_code == "NO_CORRECTION_LOW_PROB"
    assert got[(12, 100.0, 0.60)].final_pred == pytest.approx(135.0) and got[(12, 100.0, 0.60)].lift_reason == "LIFT_CAPPED"
    assert got[(12, 1000.0, 0.9)].final_pred == pytest.approx(1046.0)
    assert got[(3, 1000.0, 0.62)].reason_code == "NO_CORRECTION_NORMAL_HOUR"
    assert got[(3, 1000.0, 0.7)].final_pred == pytest.approx(1040.0)
    assert got[(12, -5.0, 0.9)].reason_code == "NO_CORRECTION_NEGATIVE_BASE"


def test_default_candidates_boost_twice_unless_fixed(make):
    df = pack(make, [(12, 1000.0, 0.9, 0, 0)])
    assert corrections.apply_spike(df, S).first().lift_applied == pytest.approx(50 * 1.15 * 1.15)
    assert corrections.apply_spike(df, S, strict_fix=True).first().lift_applied == pytest.approx(50 * 1.15)


def test_relaxed_mode_lowers_the_bar(make):
    df = pack(make, [(3, 100.0, 0.4, 0, 0)])
    cand = make(pd.DataFrame([(0, p, 0.0) for p in fixed.PERIODS], columns=["series_id", "period", "lift_candidate"]))
    assert corrections.apply_spike(df, S, cand).first().lift_applied == 0.0
    assert corrections.apply_spike(df, S, cand, corrections.SpikeProfile(relaxed=True)).first().lift_applied == pytest.approx(30.0)


def test_stack_priority_and_floor(make):
    df = pack(make, [(12, 300.0, 0.9, 0.9, 0.9), (3, 300.0, 0.0, 0.9, 0.9), (4, 20.0, 0.55, 0.9, 0.9), (5, 50.0, 0.0, 0.1, 0.1)])
    got = {(r.hour_business, r.base_fused_pred): r for r in corrections.residual_stack(df, S).collect()}
    assert got[(12, 300.0)].module_sequence == "high_spike→guardrail" and got[(12, 300.0)].final_pred > 300
    assert got[(3, 300.0)].correction_reason == "negative_downward" and got[(3, 300.0)].final_pred == pytest.approx(285.0)
    assert got[(4, 20.0)].correction_reason == "spike_blocks_negative" and got[(4, 20.0)].final_pred == 20.0
    assert got[(5, 50.0)].correction_reason == "no_correction"
    for r in got.values():
        assert r.final_pred >= 0.8 * r.after_high_spike_pred - 1e-9


def test_intraday_modes(make):
    base = make(pd.DataFrame([(0, DAY, h, 100.0, 100.0) for h in (13, 14, 15)], columns=["series_id", "business_day", "hour_business", "rt_pred", "y_fused"]))
    rows = [(0, DAY, 13, 12, 80.0, 0.6, 0.2, "LOW_WEIGHT", 5), (0, DAY, 14, 11, 80.0, 0.9, 0.2, "HIGH_WEIGHT", 5), (0, DAY, 16, 14, 80.0, 0.9, 0.2, "HIGH_WEIGHT", 5)]
    p = normalize.normalise_intraday_pack(make(pd.DataFrame(rows, columns=["series_id", "business_day", "target_hour", "cutoff_hour", "intraday_corrected_pred", "intraday_confidence", "fusion_weight", "policy_decision", "n_observed"])), series=S)
    got = {r.hour_business: r for r in intraday.apply_pack(base, p, "low_weight", series=S).collect()}
    assert got[13].rt_pred == pytest.approx(0.88 * 100 + 0.12 * 80) and got[13].y_fused == got[13].rt_pred and got[13].intraday_updated_columns == "rt_pred,y_fused"
    assert not got[14].intraday_applied and got[14].intraday_policy_decision == "SHADOW_ONLY"
    assert not got[15].intraday_available
    shadow = intraday.apply_pack(base, p, "shadow", series=S)
    assert shadow.where("rt_pred != 100").count() == 0 and shadow.where("intraday_shadow_delta is not null").count() == 2
    off = intraday.apply_pack(base, p, "low_weight", prediction_mode="FULL_DAY", series=S)
    assert off.where("intraday_applied").count() == 0
    with pytest.raises(ValueError, match="no prediction column"):
        intraday.apply_pack(base.drop("rt_pred", "y_fused"), p)


def ledger_frame(make, n, value, target="realtime"):
    rows = [(DAY, DAY, h, target, "m", value) for h in range(1, n + 1)]
    return make(pd.DataFrame(rows, columns=["run_date", "forecast_date", "hour_business", "target", "model_name", "y_pred"]))


def test_ledger_table(spark, make):
    path = scratch_path(spark, "ledger-test")
    ledger.append_to_table(spark, path, ledger_frame(make, 10, 1.0))
    ledger.append_to_table(spark, path, ledger_frame(make, 24, 2.0))
    r = ledger.read_table(spark, path)
    assert r.count() == 24 and r.where("y_pred = 1").count() == 10
    ledger.append_to_table(spark, path, ledger_frame(make, 5, 3.0), force=True)
    r = ledger.read_table(spark, path)
    assert r.count() == 24 and r.where("y_pred = 3").count() == 5 and r.where("y_pred = 1").count() == 5
    ledger.append_to_table(spark, path, ledger_frame(make, 5, 4.0, "dayahead"), force=True)
    assert ledger.read_table(spark, path).count() == 29


def test_ledger_stream_is_repeatable(spark, make):
    src, path = scratch_path(spark, "in"), scratch_path(spark, "out")
    df = ledger_frame(make, 24, 1.0).withColumn("event_time", F.lit("2024-01-05 10:00:00").cast("timestamp"))
    df.unionByName(df).write.parquet(src)
    for run in range(2):
        jobs.ledger_ingest(jobs.read_directory(spark, src, df.schema), path, scratch_path(spark, f"mark{run}")).awaitTermination()
    assert ledger.read_table(spark, path).count() == 24


def test_ledger_stream_keeps_late_rows(spark, make):
    src, path, mark = (scratch_path(spark, n) for n in ("in", "out", "mark"))
    base = ledger_frame(make, 3, 1.0)
    for day in ("2024-01-20", "2024-01-25", "2024-01-10"):  # files arrive in this order, the last one far behind
        base.withColumns({"event_time": F.lit(f"{day} 10:00:00").cast("timestamp"), "run_date": F.lit(day).cast(base.schema["run_date"].dataType)}).write.mode("append").parquet(src)
        jobs.ledger_ingest(jobs.read_directory(spark, src, spark.read.parquet(src).schema), path, mark).awaitTermination()
    assert ledger.read_table(spark, path).count() == 9


def test_shared_folder_is_required_on_a_cluster(spark):
    class Other:
        master, applicationId = "spark://host:7077", "other"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Other()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_intraday_stream_keeps_latest(spark, make):
    src, path = scratch_path(spark, "in"), scratch_path(spark, "out")
    cols = ["business_day", "target_hour", "cutoff_hour", "v"]
    first = make(pd.DataFrame([(DAY, 13, 10, 1.0), (DAY, 13, 12, 2.0), (DAY, 14, 12, 3.0)], columns=cols))
    first.write.parquet(src)
    mark = scratch_path(spark, "mark")
    run = lambda: jobs.intraday_latest(jobs.read_directory(spark, src, first.schema), path, checkpoint=mark).awaitTermination()
    run()
    make(pd.DataFrame([(DAY, 13, 11, 9.0), (DAY, 14, 13, 4.0)], columns=cols)).write.mode("append").parquet(src)
    run()
    assert {(r.target_hour, r.v) for r in jobs.read_intraday(spark, path).collect()} == {(13, 2.0), (14, 4.0)}


def test_encodings(spark, tmp_path):
    for enc in ("utf-8-sig", "gbk"):
        f = tmp_path / f"{enc}.csv"
        f.write_text("时刻,实时电价\n2024-01-01 01:00:00,12.5\n", encoding=enc)
        df = tables.read_csv(spark, str(f))
        assert df.columns == ["时刻", "实时电价"], enc
        assert tables.load_market(df, required=["ds", "rt_price"]).first().rt_price == 12.5


def test_encodings_are_judged_on_whole_files(spark, tmp_path):
    lines = "".join(f"{i},plain\n" for i in range(9000))
    for enc, word in (("utf-8", "电价"), ("gbk", "电价"), ("gb18030", "㐀价")):
        (tmp_path / f"{enc}.csv").write_text(f"n,w\n{lines}-1,{word}\n", encoding=enc)
    got = tables.read_csv(spark, str(tmp_path))
    assert got.count() == 3 * 9001 and sorted(r.w for r in got.where("n = '-1'").collect()) == sorted(["电价", "电价", "㐀价"])


def test_market_duplicates_keep_the_last_by_input_order(make):
    df = make(pd.DataFrame({"ds": ["2024-01-01 01:00:00"] * 3, "rt_price": [5.0, 9.0, 7.0], "at": [1, 2, 3]}))
    assert tables.load_market(df, order=["at"]).first().rt_price == 7.0
    assert tables.load_market(df, order=["at"], keep="first").first().rt_price == 5.0


def test_adapter_prefers_flagged_rows(make):
    df = make(pd.DataFrame({"target_day": ["2024-01-01"] * 2, "hour_business": [24, 1], "official_test": [True, False], "realtime_price": [1.0, 2.0], "pred_realtime_price": [3.0, 4.0]}))
    got = adapters.adapt(df, adapters.SPECS["mixer"], "realtime").collect()
    assert len(got) == 1 and str(got[0].ds) == "2024-01-02 00:00:00" and str(got[0].target_day) == "2024-01-01"
    none = adapters.adapt(df.withColumn("official_test", F.lit(False)), adapters.SPECS["mixer"], "realtime")
    assert none.count() == 2
    with pytest.raises(ValueError, match="no dayahead output"):
        adapters.adapt(df, adapters.SPECS["delta_net"], "dayahead")


def test_null_keys_and_conflicts(make):
    left = make(pd.DataFrame({"k": ["a", None], "y_true": [None, 1.0]}))
    right = make(pd.DataFrame({"k": ["a", None], "y_true": [5.0, 9.0]}))
    got = {r.k: r.y_true for r in joins.fill_truth(left, right, ["k"]).collect()}
    assert got == {"a": 5.0, None: 1.0}


def test_keep_one_needs_no_order_luck(make):
    df = make(pd.DataFrame({"k": [1, 1, 2], "o": [2, 1, 5], "v": [None, 3.0, 4.0]}))
    assert {(r.k, r.v) for r in dedupe.keep_one(df, ["k"], ["o"]).collect()} == {(1, 3.0), (2, 4.0)}
    assert {(r.k, r.v) for r in dedupe.keep_one(df, ["k"], ["o"], last=True).collect()} == {(1, None), (2, 4.0)}


def test_plugins(make):
    c = plugins.Corrections()
    c.register("x", lambda d: d.withColumn("v", F.col("v") + 1))
    with pytest.raises(ValueError, match="already"):
        c.register("x", lambda d: d)
    c.register("y", lambda d: d.withColumn("v", F.col("v") * 2))
    df = make(pd.DataFrame({"v": [1.0]}))
    assert c.run(df).first().v == 4.0 and c.run(df, ["y"]).first().v == 2.0
    with pytest.raises(KeyError):
        c.run(df, ["z"])


def test_weight_and_split_checks(make):
    w = make(pd.DataFrame([("g", "a", 0.99), ("h", "a", 1.03), ("i", "a", 1.5), ("i", "b", -0.5)], columns=["k", "model_name", "weight"]))
    got = {(r.k, r.check_name): r.passed for r in checks.weight_checks(w, ["k"]).collect()}
    assert got[("g", "sum_one")] and not got[("h", "sum_one")] and not got[("i", "non_negative")] and got[("i", "sum_one")]
    f = make(pd.DataFrame({"target_month": ["2024-02"], "train_end": [dt.date(2024, 1, 1)], "val_start": [dt.date(2024, 1, 2)], "val_end": [dt.date(2024, 1, 31)], "test_start": [dt.date(2024, 2, 1)], "test_end": [dt.date(2024, 2, 28)]}))
    got = {r.check_name: r.passed for r in checks.split_audit(f).collect()}
    assert got == {"boundaries_present": True, "split_order": True, "full_test_month": False}


def test_sink_rewrites_only_its_partitions(spark, make):
    path = scratch_path(spark, "sink")
    df = make(pd.DataFrame({"run_date": ["d1", "d1", "d2"], "target": ["a", "b", "a"], "v": [1.0, 2.0, 3.0]}))
    sinks.write_daily(df, path)
    sinks.write_daily(df.where("run_date = 'd2'").withColumn("v", F.lit(9.0)), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1.0, 2.0, 9.0]


def test_manifest_union(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ds,hour,target_day,y,pred_y\n2024-01-01 01:00:00,1,2024-01-01,10,11\n")
    (tmp_path / "b.csv").write_text("timestamp,target_day,rt_actual,rt_hat\n2024-01-02 00:00:00,2024-01-01,20,21\n")
    (tmp_path / "m.csv").write_text(f"adapter,source,task\nboosted_trees,{tmp_path}/a.csv,dayahead\ndelta_net,{tmp_path}/b.csv,\n")
    got = {r.model_name: r for r in adapters.load_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert got["boosted_trees"].task == "dayahead" and got["boosted_trees"].y_pred == 11.0
    assert got["delta_net"].hour_business == 24 and got["delta_net"].period == "17_24" and str(got["delta_net"].target_day) == "2024-01-01"
    with pytest.raises(ValueError, match="no source"):
        adapters.union_manifest([])


def test_shared_folder_without_setting():
    from hourpanel import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "local[2]", "app-test"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    assert session.shared_dir(Session()) == session.shared_dir(Session()) and session.shared_dir(Session()).startswith("/tmp/spark-")
