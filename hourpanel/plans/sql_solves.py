"""SQL twins of the small solves: elimination step by step, the projection by windows, quadratic fits by trying supports."""

from __future__ import annotations

from collections.abc import Sequence


def _cells(n: int, body: str) -> str:
    return f"list_transform(range(0, {n}), lambda i: {body})"


def gram(source: str, keys: str, columns: Sequence[str], y: str = "y") -> str:
    """keys, g, b, s, sy, n of the rows of ``source``."""
    g = ", ".join(f"sum({a} * {b})" for a in columns for b in columns)
    return f"SELECT {keys}, [{g}] AS g, [{', '.join(f'sum({a} * {y})' for a in columns)}] AS b, [{', '.join(f'sum({a})' for a in columns)}] AS s, sum({y}) AS sy, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY {keys}"


def gauss(name: str, source: str, k: int, width: int) -> str:
    """CTEs ``name``0 .. ``name``k over ``source``, whose list m holds k rows of ``width`` numbers."""
    out = [f"{name}0 AS MATERIALIZED (SELECT * FROM {source})"]
    for p in range(k):
        pivot, here, top = f"m[{p * (width + 1) + 1}]", "m[i + 1]", f"m[{p * width + 1} + i % {width}]"
        body = f"CASE WHEN i // {width} = {p} THEN {here} / {pivot} ELSE {here} - m[(i // {width}) * {width} + {p + 1}] * ({top} / {pivot}) END"
        out.append(f"{name}{p + 1} AS MATERIALIZED (SELECT * EXCLUDE (m), {_cells(k * width, body)} AS m FROM {name}{p})")
    return ", ".join(out)


def ridge(name: str, source: str, k: int, alpha: str, centred: bool = False) -> str:
    """CTE ``name`` = source with w, the ridge weights of its (g, b, s, sy, n); centred: those beside an intercept c."""
    w, r, c = k + 1, f"(i // {k + 1})", f"(i % {k + 1})"
    cell = f"g[{r} * {k} + {c} + 1]" + (f" - s[{r} + 1] * s[{c} + 1] / n" if centred else "") + f" + CASE WHEN {r} = {c} THEN {alpha} ELSE 0 END"
    right = f"b[{r} + 1]" + (f" - s[{r} + 1] * sy / n" if centred else "")
    start = f"(SELECT *, {_cells(k * w, f'CASE WHEN {c} = {k} THEN {right} ELSE {cell} END')} AS m FROM {source})"
    found = _cells(k, f"m[i * {w} + {k + 1}]")
    level = f", (sy - list_sum(list_transform(range(1, {k + 1}), lambda i: w[i] * s[i]))) / n AS c" if centred else ""
    return f"{gauss(name + '_', start, k, w)}, {name} AS MATERIALIZED (SELECT * EXCLUDE (m){level} FROM (SELECT *, {found} AS w FROM {name}_{k}))"


def quadratic(name: str, source: str, k: int, alpha: float = 0.0, mixture: bool = True) -> str:
    """CTE ``name`` = source with w >= 0 that minimises w'(g + alpha)w / 2 - b'w; mixture: with sum 1. Every support is
    solved; of those with no negative weight the least objective is taken."""
    w, r, c = k + 2, f"(i // {k + 2})", f"(i % {k + 2})"
    held = lambda j: f"((u >> {j}) & 1) = 1"
    cell = f"CASE WHEN {c} = {k} THEN CASE WHEN {held(r)} THEN b[{r} + 1] ELSE 0 END WHEN {c} = {k + 1} THEN CASE WHEN {held(r)} THEN 1 ELSE 0 END WHEN {held(r)} AND {held(c)} THEN g[{r} * {k} + {c} + 1] + CASE WHEN {r} = {c} THEN {alpha} ELSE 0 END WHEN {r} = {c} THEN 1 ELSE 0 END::DOUBLE"
    start = f"(SELECT *, {_cells(k * w, cell)} AS m FROM (SELECT row_number() OVER () AS rid, * FROM {source}), (SELECT unnest(range({int(mixture)}, {2**k})) AS u))"
    at = lambda j: _cells(k, f"m[i * {w} + {k + j}]")
    level = "(1 - list_sum(p)) / list_sum(q)" if mixture else "0"
    x = f"list_transform(range(1, {k + 1}), lambda i: p[i] + ({level}) * q[i])"
    value = f"list_sum(list_transform(range(0, {k * k}), lambda i: x[i // {k} + 1] * x[i % {k} + 1] * (g[i + 1] + CASE WHEN i // {k} = i % {k} THEN {alpha} ELSE 0 END))) / 2 - list_sum(list_transform(range(1, {k + 1}), lambda i: b[i] * x[i]))"
    tried = f"SELECT *, {value} AS o FROM (SELECT *, {x} AS x FROM (SELECT *, {at(1)} AS p, {at(2)} AS q FROM {name}_{k}))"
    best = f"SELECT rid, arg_min(x, o) AS x FROM ({tried}) WHERE list_min(x) >= -1e-9 GROUP BY rid"
    clean = "list_transform(d.x, lambda v: greatest(v, 0))"
    return f"{gauss(name + '_', start, k, w)}, {name} AS MATERIALIZED (SELECT e.* EXCLUDE (m, u), {clean} AS w FROM {name}_0 e JOIN ({best}) d ON e.rid = d.rid WHERE u = {2**k - 1})"


def pin_and_share(name: str, source: str, keys: str, k: int, lo: float = -0.5, hi: float = 1.2) -> str:
    """CTE ``name`` (keys, i, w) from (keys, i, v): the published projection, one window pass a step."""
    part = f"PARTITION BY {keys}"
    out = [
        f"{name}_s0 AS MATERIALIZED (SELECT {keys}, i, least(greatest(v, {lo}), {hi}) AS w, true AS free, abs(sum(least(greatest(v, {lo}), {hi})) OVER ({part}) - 1) <= 1e-9 AS done, abs(sum(least(greatest(v, {lo}), {hi})) OVER ({part}) - 1) <= 1e-9 AS fits FROM {source})"
    ]
    for p in range(k + 1):
        out.append(
            f"""{name}_s{p + 1} AS MATERIALIZED (SELECT {keys}, i, CASE WHEN done OR nf = 0 OR NOT free THEN w WHEN o THEN CASE WHEN moved < {lo} THEN {lo} ELSE {hi} END WHEN hit THEN w ELSE moved END AS w,
                free AND (done OR nf = 0 OR NOT o) AS free, done OR nf = 0 OR NOT hit AS done, fits FROM (SELECT *, bool_or(o) OVER ({part}) AS hit FROM (SELECT *, free AND (moved < {lo} OR moved > {hi}) AS o FROM (
                SELECT *, w + (1 - sw) / CASE WHEN nf = 0 THEN 1 ELSE nf END AS moved FROM (SELECT *, sum(w) OVER ({part}) AS sw, count(*) FILTER (free) OVER ({part}) AS nf FROM {name}_s{p})))))"""
        )
    filled = f"SELECT *, CASE WHEN NOT fits AND free AND nf < nk THEN least(greatest((1 - pinned) / nf, {lo}), {hi}) ELSE w END AS w2 FROM (SELECT *, count(*) FILTER (free) OVER ({part}) AS nf, count(*) OVER ({part}) AS nk, coalesce(sum(w) FILTER (NOT free) OVER ({part}), 0) AS pinned FROM {name}_s{k + 1})"
    rest = f"SELECT *, 1 - sum(w2) OVER ({part}) AS r FROM ({filled})"
    order = f"row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN w2 + r BETWEEN {lo} AND {hi} THEN 0 ELSE 1 END, abs(w2) DESC, i) = 1 AND w2 + r BETWEEN {lo} AND {hi}"
    out.append(f"{name} AS MATERIALIZED (SELECT {keys}, i, CASE WHEN nk = 1 THEN 1 WHEN NOT fits AND abs(r) > 1e-8 AND {order} THEN w2 + r ELSE w2 END AS w FROM ({rest}))")
    return ", ".join(out)


def long(source: str, keys: str, k: int, value: str = "w") -> str:
    """Rows (keys, i, v) of a list column; i from 0."""
    return f"(SELECT {keys}, unnest(range(0, {k})) AS i, unnest({value}) AS v FROM {source})"


def named(models: Sequence[str]) -> str:
    """A table (i, model_name)."""
    return f"(VALUES {', '.join(f'({i}, {chr(39)}{m}{chr(39)})' for i, m in enumerate(models))}) names(i, model_name)"
