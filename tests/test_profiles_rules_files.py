"""Profiles from value counts, rules for gaps in one pass, CSV files with marks and files that nothing decodes."""

import numpy as np
import pandas as pd
import pytest

from hourpanel.operators import fusion, reports
from hourpanel.sources import sinks, tables


def test_profile_equals_pandas(spark):
    rng = np.random.default_rng(5)
    x = [None if i % 7 == 0 else float(v) for i, v in enumerate(rng.integers(-3, 4, 300))]
    y = [float(v) for v in 1e6 + rng.normal(size=300)]
    pdf = pd.DataFrame({"g": ["a"] * 200 + ["b"] * 99 + [None], "x": x, "y": y})
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    got = reports.column_profile(spark.createDataFrame(rows, "g string, x double, y double"), ["x", "y"], ["g"]).collect()
    assert len(got) == 6
    for r in got:
        v = pdf[pdf["g"].isna() if r["g"] is None else pdf["g"] == r["g"]][r["field"]].astype(float)
        assert (r["n_total"], r["n_non_null"], r["n_unique"]) == (len(v), v.count(), v.nunique())
        for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            assert np.isclose(r[name], v.quantile(q))
        if v.count() > 1:
            assert np.isclose(r["mean"], v.mean()) and np.isclose(r["std"], v.std()) and np.isclose(r["zero_ratio"], (v == 0).mean())


def test_profile_of_nulls_and_of_nothing(spark):
    null = spark.createDataFrame([("a", None), ("a", None)], "g string, x double")
    (r,) = reports.column_profile(null, ["x"], ["g"]).collect()
    assert (r["n_total"], r["n_non_null"], r["n_unique"], r["mean"], r["q50"], r["missing_rate"]) == (2, 0, 0, None, None, 1.0)
    assert reports.column_profile(null.where("g = 'z'"), ["x"], ["g"]).count() == 0


def test_rules_in_one_pass_equal_single_rules(spark):
    rows = [("t", "p", d, h, m, None if (h + i) % 5 == 0 else float(h * 10 + i), float(h)) for d in (1, 2) for h in range(8) for i, m in enumerate("abc")]
    panel = spark.createDataFrame([*rows, (None, "p", 1, 0, "a", 4.0, 1.0)], "task string, period string, target_day int, h int, model_name string, y_pred double, y_true double")
    weights = spark.createDataFrame([("t", "p", "a", 0.5), ("t", "p", "b", 0.3)], "task string, period string, model_name string, weight double")
    by, point = ["task", "period"], ["task", "period", "target_day", "h"]
    both = fusion.fuse_rules(panel, weights, by, point).collect()
    assert len(both) == len(fusion.MISSING_RULES) * 17
    for rule in fusion.MISSING_RULES:
        one = fusion.fuse(panel, weights, by, point, rule)
        assert "rule" not in one.columns
        key = lambda r: (r["task"] or "", r["target_day"], r["h"])
        assert {key(r): r["y_fused"] for r in one.collect()} == {key(r): r["y_fused"] for r in both if r["rule"] == rule}
    with pytest.raises(ValueError):
        fusion.fuse_rules(panel, weights, by, point, ["no such rule"])


def test_marked_csv(spark, tmp_path):
    df = spark.createDataFrame([("d1", "价", 1), ("d2", "b", 2)], "run_date string, name string, n int")
    sinks.write_daily(df, str(tmp_path / "out"), ["run_date"], "csv", bom=True)
    files = list((tmp_path / "out").glob("*/*.csv"))
    assert len(files) == 2 and all(f.read_bytes().startswith(b"\xef\xbb\xbfname,n") for f in files)
    back = tables.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["name", "n"] and {tuple(r) for r in back.collect()} == {("价", "1"), ("b", "2")}
    with pytest.raises(ValueError):
        sinks.write_daily(df, str(tmp_path / "no"), ["run_date"], "parquet", bom=True)


def test_undecodable_files_are_named(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes("a,b\n1,价\n".encode("gbk"))
    (tmp_path / "bad.csv").write_bytes(b"a,b\n1,\xff\xff\n")
    with pytest.raises(tables.UndecodableFiles, match="bad.csv") as e:
        tables.read_csv(spark, str(tmp_path))
    assert len(e.value.files) == 1
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path), undecodable="skip").collect()] == [("1", "价")]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path), undecodable="maybe")
