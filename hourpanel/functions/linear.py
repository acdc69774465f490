"""Small linear solves as folds over arrays: column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for a body that uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def eliminate(augmented: Column, k: int, width: int) -> Column:
    """Gauss-Jordan on k rows of ``width`` numbers in one array, without exchanging rows; for symmetric positive definite
    systems. The last ``width - k`` columns end as solutions; a zero pivot gives nulls."""

    def step(m: Column, p: Column) -> Column:
        def cell(pivot: Column) -> Column:
            def new(v: Column, i: Column) -> Column:
                row, column = F.floor(i / width), i % width
                scaled = F.get(m, p * width + column) / pivot
                return F.when(row == p, v / pivot).otherwise(v - F.get(m, (row * width + p).cast("int")) * scaled)

            return F.transform(m, new)

        return let(F.nullif(F.get(m, p * (width + 1)), F.lit(0.0)), cell)

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), augmented, step)


def solution(a: Callable[[Column, Column], Column], b: Callable[[Column], Column], k: int) -> Column:
    """x with sum over c of a(r, c) x(c) = b(r)."""
    width = k + 1
    cells = F.transform(F.sequence(F.lit(0), F.lit(k * width - 1)), lambda i: let(F.floor(i / width).cast("int"), lambda r: F.when(i % width == k, b(r)).otherwise(a(r, i % width))))
    return let(eliminate(cells, k, width), lambda m: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda r: F.get(m, r * width + k)))


def pin_and_share(v: Column, lo: float, hi: float) -> Column:
    """The published rule for entries in [lo, hi] and sum 1, for arrays of any length.

    Clipped entries move by one common amount to the sum; those that leave the bounds are pinned and the others move
    again, at most once an entry. Once an entry is pinned, the free ones take equal parts of what is left of 1. A rest goes
    to the largest entry that can take it whole.
    """
    low, high = F.lit(float(lo)), F.lit(float(hi))
    clip = lambda x: F.least(F.greatest(x, low), high)
    outside = lambda x: (x < low) | (x > high)
    entry = lambda w, free: F.struct(w.alias("w"), free.alias("free"))
    sum_of = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x["w"])
    n_free = lambda e: F.size(F.filter(e, lambda x: x["free"]))

    def step(state: Column, _: Column) -> Column:
        def moved(shift: Column) -> Column:
            some = F.exists(state["e"], lambda x: x["free"] & outside(x["w"] + shift))
            pinned = F.transform(state["e"], lambda x: F.when(x["free"] & outside(x["w"] + shift), entry(F.when(x["w"] + shift < low, low).otherwise(high), F.lit(False))).otherwise(x))
            shared = F.transform(state["e"], lambda x: F.when(x["free"], entry(x["w"] + shift, x["free"])).otherwise(x))
            return F.when(some, F.struct(pinned.alias("e"), F.lit(False).alias("done"))).otherwise(F.struct(shared.alias("e"), F.lit(True).alias("done")))

        return F.when(state["done"] | (n_free(state["e"]) == 0), state).otherwise(let((1.0 - sum_of(state["e"])) / n_free(state["e"]), moved))

    def filled(e: Column) -> Column:
        part = (1.0 - F.aggregate(e, F.lit(0.0), lambda acc, x: acc + F.when(x["free"], 0.0).otherwise(x["w"]))) / F.nullif(n_free(e), F.lit(0))
        return F.when(n_free(e).between(1, F.size(e) - 1), let(part, lambda p: F.transform(e, lambda x: F.when(x["free"], clip(p)).otherwise(x["w"])))).otherwise(F.transform(e, lambda x: x["w"]))

    def rest(w: Column) -> Column:
        def give(r: Column) -> Column:
            takers = F.filter(F.transform(w, lambda x, i: F.struct((-F.abs(x)).alias("o"), i.alias("i"), x.alias("x"))), lambda t: (t["x"] + r).between(low, high))
            to = F.array_min(takers)["i"]
            return F.when(F.abs(r) > 1e-8, F.transform(w, lambda x, i: F.when(i.eqNullSafe(to), x + r).otherwise(x))).otherwise(w)

        return let(1.0 - total(w), give)

    def run(w: Column) -> Column:
        start = F.struct(F.transform(w, lambda x: entry(x, F.lit(True))).alias("e"), F.lit(False).alias("done"))
        ends = F.aggregate(F.sequence(F.lit(1), F.size(w) + 1), start, step)
        shared = let(let(ends["e"], filled), rest)
        return F.when(F.size(w) == 1, F.array(F.lit(1.0))).when(F.abs(total(w) - 1.0) <= 1e-9, w).otherwise(shared)

    return let(F.transform(v, clip), run)
