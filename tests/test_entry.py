import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, bag

DATA = "/root/testdata/sf0.001"
SAMPLE = [
    "fusion_flagship", "smape_variants", "metrics_by_hour", "full_metrics_by_segment", "delta_history", "target_history", "tap_fold_specs",
    "bgew_weights", "fuse_missing_rules", "residual_stack", "intraday_applied", "ledger_append", "prediction_audit", "hysteresis_alarm", "best_single_by_folds",
]


def test_names_and_oracles():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) > 200
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in qs)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    assert bag(df.columns, rows) == bag([d[0] for d in res.description], res.fetchall())
