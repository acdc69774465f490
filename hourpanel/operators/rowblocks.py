"""Row-ordered windows that do not depend on one task per series.

A plain window partitioned by series puts a whole series into one task. Here
each series is cut into blocks of ``size`` consecutive rows; a block also gets
the few rows before (or after) it that its frames look at. Results equal those
of the plain window, but a series with a third of all rows spreads over many
tasks. Unbounded look-back (forward fill, alarm state) keeps one summary row
per block and carries it over a small per-block table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

BLOCK_ROWS = 16384

IDX, BLK, OWN, BKT = "_row_idx", "_row_blk", "_row_own", "_row_bkt"


def with_row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = IDX,
    total: str | None = None,
    staged: bool = False,
) -> DataFrame:
    """0-based position of each row in its series, without sorting a series in one task.

    ``bucket`` must rise with ``order`` and hold few rows (the calendar day of
    the first order column). Rows per bucket are counted, the counts summed up
    over the small bucket table, and rows numbered inside their bucket only.
    """
    keys = list(keys)
    if staged:  # read twice below
        df = materialise(df, "index")
    tagged = df.withColumn(BKT, bucket)
    sizes = tagged.groupBy(*keys, BKT).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(BKT).rowsBetween(W.unboundedPreceding, -1)
    cols = [*keys, BKT, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    extra = []
    if total:
        cols.append(F.sum("_n").over(W.partitionBy(*keys)).alias(total))
        extra = [total]
    offsets = sizes.select(*cols)
    inside = W.partitionBy(*keys, BKT).orderBy(*order)
    return (
        tagged.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, BKT])
        .withColumn(name, F.col("_off") + F.col("_rn") - 1)
        .select(*df.columns, name, *extra)
    )


class RowBlocks:
    """Blocks with a halo; use ``rows``/``window`` for frames, then ``add``.

    The input is read twice (rows and row counts), so it is written to the
    shared folder first unless ``staged=False`` says it is a plain table scan.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: str = "ds",
        before: int = 0,
        after: int = 0,
        size: int = BLOCK_ROWS,
        bucket: Column | None = None,
        staged: bool = True,
    ):
        self.size = max(size, before, after, 1)
        self.keys = list(keys)
        if staged:
            df = materialise(df, "rows")
        indexed = with_row_index(df, self.keys, [order], F.to_date(order) if bucket is None else bucket)
        pos, blk = F.col(IDX) % self.size, (F.col(IDX) / self.size).cast("long")
        homes = [blk]
        if before:
            homes.append(F.when(pos >= self.size - before, blk + 1))
        if after:
            homes.append(F.when((pos < after) & (blk > 0), blk - 1))
        if len(homes) > 1:
            indexed = indexed.withColumn(BLK, F.explode(F.array_compact(F.array(*homes))))
        else:
            indexed = indexed.withColumn(BLK, blk)
        self.df = indexed.withColumn(OWN, F.col(BLK) == blk)

    def window(self):
        return W.partitionBy(*self.keys, BLK).orderBy(IDX)

    def rows(self, start: int, end: int):
        return self.window().rowsBetween(start, end)

    def add(self, exprs: Mapping[str, Column], keep_index: bool = False) -> DataFrame:
        """Add window columns and drop the halo; ``keep_index`` leaves the block columns for a fill."""
        out = self.df.withColumns(dict(exprs)).where(F.col(OWN)).drop(OWN)
        return out if keep_index else out.drop(IDX, BLK)


def lag(rb: RowBlocks, c: str | Column, k: int) -> Column:
    return F.lag(c, k).over(rb.window())


def lead(rb: RowBlocks, c: str | Column, k: int) -> Column:
    return F.lead(c, k).over(rb.window())


def rolling(
    rb: RowBlocks,
    c: str | Column,
    rows: int,
    fn=F.avg,
    min_rows: int | None = None,
    shift: int = 0,
) -> Column:
    """``fn`` over the last ``rows`` rows ending ``shift`` rows back.

    Null unless at least ``min_rows`` (default: all) of them are non-null.
    """
    x = F.col(c) if isinstance(c, str) else c
    frame = rb.rows(-(rows - 1 + shift), -shift)
    return F.when(F.count(x).over(frame) >= (rows if min_rows is None else min_rows), fn(x).over(frame))


def nearest_known(
    df: DataFrame,
    keys: Sequence[str],
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    order: str = "ds",
    strict: bool = False,
    size: int = BLOCK_ROWS,
    bucket: Column | None = None,
    keep_index: bool = False,
) -> DataFrame:
    """Last (``previous``) and next (``following``) non-null value of expressions, per row.

    ``strict`` leaves the row itself out. What crosses a block border comes from
    a table with one row per block. Frames that already carry block columns
    (``add(keep_index=True)``) are not indexed again.
    """
    previous, following = dict(previous or {}), dict(following or {})
    keys = list(keys)
    if BLK in df.columns:
        body = df
    else:
        body = RowBlocks(df, keys, order, size=size, bucket=bucket).df.drop(OWN)
    sources = {f"_src_{k}": v for k, v in {**previous, **following}.items()}
    body = materialise(body.withColumns(sources), "fill")
    at = {k: F.when(F.col(f"_src_{k}").isNotNull(), F.col(IDX)) for k in (*previous, *following)}
    summary = body.groupBy(*keys, BLK).agg(
        *[F.max_by(f"_src_{k}", at[k]).alias(f"_edge_{k}") for k in previous],
        *[F.min_by(f"_src_{k}", at[k]).alias(f"_edge_{k}") for k in following],
    )
    blocks = W.partitionBy(*keys).orderBy(BLK)
    ahead, behind = blocks.rowsBetween(1, W.unboundedFollowing), blocks.rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        BLK,
        *[F.last(f"_edge_{k}", ignorenulls=True).over(behind).alias(f"_carry_{k}") for k in previous],
        *[F.first(f"_edge_{k}", ignorenulls=True).over(ahead).alias(f"_carry_{k}") for k in following],
    )
    inside = W.partitionBy(*keys, BLK).orderBy(IDX)
    back = inside.rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    forth = inside.rowsBetween(1 if strict else 0, W.unboundedFollowing)
    found = {f"_in_{k}": F.last(f"_src_{k}", ignorenulls=True).over(back) for k in previous}
    found.update({f"_in_{k}": F.first(f"_src_{k}", ignorenulls=True).over(forth) for k in following})
    outs = {k: F.coalesce(F.col(f"_in_{k}"), F.col(f"_carry_{k}")) for k in (*previous, *following)}
    out = body.withColumns(found).join(carry, [*keys, BLK]).withColumns(outs)
    keep = [c for c in df.columns if c not in outs and c not in (IDX, BLK)]
    return out.select(*keep, *outs, *([IDX, BLK] if keep_index else []))


def forward_fill(df: DataFrame, keys: Sequence[str], exprs: Mapping[str, Column], **kw) -> DataFrame:
    """Last non-null value of each expression up to (``strict``: before) each row."""
    return nearest_known(df, keys, previous=exprs, **kw)
