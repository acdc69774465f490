"""Exact linear-interpolated quantiles and ranks for groups of any size.

The built-in exact ``percentile`` holds every distinct value of a group in one
task. Here a mergeable sketch first brackets each wanted rank, and only the
values inside the bracket (a few rows in ten thousand) are ordered; everything
below collapses to one count during map-side aggregation. The result is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

SKETCH_ACCURACY = 10_000
SMALL_GROUP = 50_000


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probs: Mapping[str, float],
    counts: str | None = None,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """One row per key with a column per name in ``probs``; null values are skipped.

    Groups of at most ``small_group`` rows are ordered whole, larger ones only
    inside the brackets; the stretches between brackets count as one value each.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("quantiles needs at least one key column")
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(*keys, v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    wanted = sorted(set(float(p) for p in probs.values()))
    pad, m = 4.0 / SKETCH_ACCURACY, len(wanted)
    edges = [max(0.0, p - pad) for p in wanted] + [min(1.0, p + pad) for p in wanted]
    bracket = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(SKETCH_ACCURACY)).alias("_e"),
    )
    small = F.col("_n") <= small_group
    cols = {}
    for i, p in enumerate(wanted):
        cols[f"_lo{i}"] = F.when(small | F.lit(p - pad <= 0), F.col("_min")).otherwise(F.col("_e")[i])
        cols[f"_hi{i}"] = F.when(small | F.lit(p + pad >= 1), F.col("_max")).otherwise(F.col("_e")[m + i])
    bracket = bracket.select(*keys, "_n", *[c.alias(n) for n, c in cols.items()])
    x = F.col("_v")
    inside, stretch = F.lit(False), F.lit(0)
    for i in range(m):
        inside = inside | x.between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        stretch = stretch + (x > F.col(f"_hi{i}")).cast("int")
    near = (
        base.join(bracket, keys)
        .select(*keys, "_n", "_v", F.when(inside, x).alias("_exact"), F.when(~inside, stretch).alias("_stretch"))
        .groupBy(*keys, "_n", "_exact", "_stretch")
        .agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_x"))
    )
    upto = W.partitionBy(*keys).orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    ranked = near.withColumn("_cum", F.sum("_k").over(upto))
    picks = []
    for i, p in enumerate(wanted):
        k = F.floor(F.lit(p) * (F.col("_n") - 1))
        picks.append(F.min(F.when(F.col("_cum") > k, F.col("_x"))).alias(f"_a{i}"))
        picks.append(F.min(F.when(F.col("_cum") > k + 1, F.col("_x"))).alias(f"_b{i}"))
    found = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)

    def at(i: int, p: float) -> Column:
        pos = F.lit(p) * (F.col("_n") - 1)
        a = F.col(f"_a{i}")
        return a + (pos - F.floor(pos)) * (F.coalesce(F.col(f"_b{i}"), a) - a)

    outs = [at(wanted.index(float(p)), float(p)).alias(n) for n, p in probs.items()]
    if counts:
        outs.append(F.col("_n").alias(counts))
    return found.select(*keys, *outs)


SPLITS = 256  # a power of two


def cumulative_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, Column],
    descending: bool = False,
    distinct: bool = False,
) -> DataFrame:
    """Running sums over the distinct values of a column, per key.

    Values are grouped first (``distinct``: they are already, and ``sums`` are plain columns), then spread over 256
    sketch-made ranges; range totals are summed on a small table. Output: keys, value, each sum
    (``name``), its running total up to and including the value (``cum_name``)
    and its total (``all_name``).
    """
    keys = list(keys)
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(value, F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)]), F.lit(1000)).alias("_cuts")
    )
    named = [e.alias(n) for n, e in sums.items()]
    known = df.where(F.col(value).isNotNull())
    flat = known.select(*keys, value, *named) if distinct else known.groupBy(*keys, value).agg(*named)
    placed = _cuts_below(flat.join(materialise(cuts, "cuts"), keys), {"_b": ("_cuts", value)}).drop("_cuts")  # of known size
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = placed.groupBy(*keys, "_b").agg(*[F.sum(n).alias(f"_s_{n}") for n in sums])
    prior = W.partitionBy(*keys).orderBy(way("_b")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_s_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(W.partitionBy(*keys)).alias(f"all_{n}") for n in sums],
    )
    inside = W.partitionBy(*keys, "_b").orderBy(way(value)).rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.withColumns({f"_r_{n}": F.sum(n).over(inside) for n in sums})
        .join(offsets, [*keys, "_b"])
        .select(
            *keys,
            value,
            *sums.keys(),
            *[(F.col(f"_o_{n}") + F.col(f"_r_{n}")).alias(f"cum_{n}") for n in sums],
            *[f"all_{n}" for n in sums],
        )
    )


def with_ranks(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Column]) -> DataFrame:
    """Adds one column per name in ``wanted``: the rank of its value within the key (1-based, ties share their mean, null
    for null).

    Sketch-made cuts place every value: equal to a cut, or between two. Between cuts lie few rows, none of them with a
    frequent value, and a window over that stretch orders them. A frequent value is a cut; its rows have the same rank,
    known from the counts of the stretches, so they are dealt out at random and no task holds a value. What is exchanged
    is keyed by the stretch, never by a value, and ranks stay on their rows.
    """
    keys, names = list(keys), list(wanted)
    probs = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
    placed = df.withColumns({f"_v_{n}": c.cast("double") for n, c in wanted.items()})
    cuts = placed.groupBy(*keys).agg(*[F.array_distinct(F.percentile_approx(f"_v_{n}", probs, F.lit(1000))).alias(f"_cuts_{n}") for n in names])
    placed = placed.join(materialise(cuts, "cuts"), keys)  # its size is known, so rows need not gather by key
    placed = _cuts_below(placed, {f"_b_{n}": (f"_cuts_{n}", f"_v_{n}") for n in names})
    placed = placed.withColumns({f"_b_{n}": _stretch(F.col(f"_cuts_{n}"), F.col(f"_b_{n}"), F.col(f"_v_{n}")) for n in names})
    placed = materialise(placed.drop(*[f"_cuts_{n}" for n in names]), "placed")
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), F.col(f"_b_{n}").alias("_at")) for n in names]))
    size = placed.select(*keys, cells.alias("_c")).select(*keys, "_c.*").where("_at is not null").groupBy(*keys, "_name", "_at").agg(F.count(F.lit(1)).alias("_n"))
    size = materialise(size, "sizes")
    mixed = {r[0] for r in size.where("_at % 2 = 0").select("_name").distinct().collect()}  # a name or none each
    before = W.partitionBy(*keys, "_name").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    size = size.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    tables = size.groupBy(*keys).agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col("_name") == n, F.struct("_at", F.struct("_o", "_n"))))).alias(f"_t_{n}") for n in names]
    )  # at most 2 * SPLITS stretches a name
    dense = lambda t: F.transform(F.sequence(F.lit(0), F.lit(2 * SPLITS)), lambda i: F.try_element_at(t, i))
    out = placed.join(materialise(tables.select(*keys, *[dense(F.col(f"_t_{n}")).alias(f"_t_{n}") for n in names]), "stretches"), keys)
    for n in names:
        here = F.get(f"_t_{n}", F.col(f"_b_{n}"))
        out = out.withColumns({f"_o_{n}": here["_o"], f"_n_{n}": here["_n"]})
    out = out.drop(*[f"_t_{n}" for n in names])
    # rows that need no order are spread by what they hold; columns whose values are all cuts need no window, but for the last
    out = out.withColumn("_any", 1 + F.pmod(F.xxhash64(*out.columns), F.lit(SPLITS)))
    names.sort(key=lambda n: n in mixed)
    for n in names:
        at = F.col(f"_b_{n}")
        if n not in mixed and n != names[-1]:
            own = F.when(at.isNotNull(), F.col(f"_o_{n}") + (F.col(f"_n_{n}") + 1) / 2)
            out = out.withColumn(n, own).drop(f"_o_{n}", f"_n_{n}", f"_b_{n}", f"_v_{n}")
            continue
        ordered = F.coalesce(at % 2 == 0, F.lit(False))
        out = out.withColumn("_spread", F.when(ordered, F.lit(0)).otherwise(F.col("_any")))
        part = [*keys, f"_b_{n}", "_spread"]
        rank = F.rank().over(W.partitionBy(*part).orderBy(f"_v_{n}"))
        ties = F.count(F.lit(1)).over(W.partitionBy(*part, f"_v_{n}"))
        own = F.when(ordered, F.col(f"_o_{n}") + rank + (ties - 1) / 2).when(at.isNotNull(), F.col(f"_o_{n}") + (F.col(f"_n_{n}") + 1) / 2)
        out = out.withColumn(n, own).drop("_spread", f"_o_{n}", f"_n_{n}", f"_b_{n}", f"_v_{n}")
    return out.select(*df.columns, *wanted)


def _cuts_below(df: DataFrame, wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Adds one column per ``{out: (cuts, value)}``: how many of the ascending cuts (under ``SPLITS``) lie below the value.

    A binary search, a projection for each halving: plain column expressions, no lambda over the elements.
    """
    df, step = df.withColumns({out: F.lit(0) for out in wanted}), SPLITS // 2
    while step:
        df = df.withColumns({out: F.col(out) + F.when(F.get(cuts, F.col(out) + step - 1) < F.col(v), step).otherwise(0) for out, (cuts, v) in wanted.items()})
        step //= 2
    return df


def _stretch(cuts: Column, below: Column, v: Column) -> Column:
    """2 x the number of cuts below v, and 1 more if v is a cut itself."""
    return F.when(v.isNotNull(), 2 * below + F.coalesce(F.get(cuts, below) == v, F.lit(False)).cast("int"))


def average_rank(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, ``rank`` (ties share their mean rank, 1-based) and ``n``."""
    cum = cumulative_counts(df, keys, value, {"c": F.count(F.lit(1))})
    return cum.select(
        *keys,
        value,
        (F.col("cum_c") - F.col("c") + (F.col("c") + 1) / 2).alias("rank"),
        F.col("all_c").alias("n"),
    )


def column_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str | Column, float]], counts: bool = False
) -> DataFrame:
    """Quantiles of several columns in one scan: ``{out: (column, prob)}`` per key."""
    keys = list(keys)
    cols: list[Column] = []
    where: dict[str, int] = {}
    place = {}
    for out, (c, p) in wanted.items():
        tag = c if isinstance(c, str) else str(c)
        if tag not in where:
            where[tag] = len(cols)
            cols.append((F.col(c) if isinstance(c, str) else c).cast("double"))
        place[out] = (where[tag], float(p))
    cells = F.array(*[F.struct(F.lit(i).alias("_qc"), c.alias("_x")) for i, c in enumerate(cols)])
    long = df.select(*keys, F.explode(cells).alias("_s")).select(*keys, "_s._qc", "_s._x")
    probs = sorted({p for _, p in place.values()})
    q = quantiles(long, [*keys, "_qc"], "_x", {f"_q{i}": p for i, p in enumerate(probs)})
    return q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_qc") == i, F.col(f"_q{probs.index(p)}"))).alias(out) for out, (i, p) in place.items()]
    )
