import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hourpanel.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4, "tests")


def hours(n, start="2024-01-01 01:00:00"):
    return pd.date_range(start, periods=n, freq="h")


@pytest.fixture(scope="session")
def make(spark):
    """pandas frame to Spark with zone-free timestamps."""

    def build(pdf):
        cols = []
        for c in pdf.columns:
            if str(pdf[c].dtype).startswith("datetime64"):
                kind = "timestamp_ntz"
            elif pdf[c].dtype == float:
                kind = "double"
            elif str(pdf[c].dtype).startswith("int"):
                kind = "bigint"
            elif pdf[c].dtype == bool:
                kind = "boolean"
            elif pdf[c].map(lambda v: isinstance(v, dt.date)).any():
                kind = "date"
            else:
                kind = "string"
            cols.append(f"`{c}` {kind}")
        rows = []
        for row in pdf.itertuples(index=False):
            out = []
            for v in row:
                if isinstance(v, pd.Timestamp):
                    v = v.to_pydatetime()
                elif isinstance(v, np.generic):
                    v = v.item()
                if isinstance(v, float) and v != v:
                    v = None
                out.append(v)
            rows.append(tuple(out))
        return spark.createDataFrame(rows, ", ".join(cols))

    return build


@pytest.fixture(scope="session")
def panel(make):
    """Two series, two models, 12 days."""
    rng = np.random.default_rng(7)
    rows = []
    for s in (0, 1):
        for ts in hours(12 * 24):
            day = (ts - pd.Timedelta(days=1)).date() if ts.hour == 0 else ts.date()
            hour = 24 if ts.hour == 0 else ts.hour
            y = float(100 + 40 * np.sin(hour) + rng.normal(0, 10))
            for m, b in (("a", 5.0), ("b", -15.0), ("c", 0.0)):
                rows.append((s, "realtime", m, day, day, ts, "1_8" if hour <= 8 else "9_16" if hour <= 16 else "17_24", hour, y, y + b + rng.normal(0, 3)))
    pdf = pd.DataFrame(rows, columns=["series_id", "task", "model_name", "target_day", "business_day", "ds", "period", "hour_business", "y_true", "y_pred"])
    return pdf, make(pdf)
