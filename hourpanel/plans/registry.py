"""How a query and its SQL twin are declared.

A query is a function from ``Tables`` to a DataFrame plus an output spec like
``"period:s smape:d n:i"``. The same spec shapes both sides (types, rounding,
names), so the Spark result and the SQL result can be compared value by value.
Type codes: s text, d double (6 decimals), i bigint, b boolean, t date or
timestamp as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixture


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[fixture.Tables], DataFrame]
    spec: str
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(self.build(fixture.Tables(spark, sf_dir)), self.spec)


REGISTRY: dict[str, Query] = {}


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Project onto the spec: fixed types, rounded doubles, dates as text."""
    cols = []
    for name, code in _fields(spec):
        c = F.col(name)
        if code == "d":
            r = F.round(c.cast("double"), 6)
            c = F.when(F.isnan(r), None).when(r == 0, F.lit(0.0)).otherwise(r)
        else:
            c = c.cast({"s": "string", "i": "bigint", "b": "boolean", "t": "string"}[code])
        cols.append(c.alias(name))
    return df.select(*cols)


def shape_sql(select: str, ctes: str, spec: str) -> str:
    cols = []
    for name, code in _fields(spec):
        if code == "d":
            d = f"CAST({name} AS DOUBLE)"
            cols.append(
                f"CASE WHEN isnan({d}) THEN NULL WHEN round({d}, 6) = 0 THEN 0.0::DOUBLE ELSE round({d}, 6) END AS {name}"
            )
        else:
            kind = {"s": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN", "t": "VARCHAR"}[code]
            cols.append(f"CAST({name} AS {kind}) AS {name}")
    own = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    head = "WITH RECURSIVE" if "UNION ALL BY STEP" in ctes else "WITH"  # marker: a step-by-step state in SQL
    own = own.replace("UNION ALL BY STEP", "UNION ALL")
    return f"{head} {fixture.BASE_CTES}{own},\nfinal_result AS (\n{select.strip()}\n)\nSELECT {', '.join(cols)} FROM final_result"


def query(name: str, spec: str, sql: str | None = None, ctes: str = ""):
    """Register the decorated builder; ``sql=None`` gives a rows-only check."""

    def keep(fn: Callable[[fixture.Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} declared twice")
        REGISTRY[name] = Query(name, fn, spec, shape_sql(sql, ctes, spec) if sql else None)
        return fn

    return keep
