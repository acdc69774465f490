"""Clusters of vectors around integer centroids, nearest centroids found by the equal-average equal-variance search.

Vectors become whole numbers once (``floor(SCALE * x)``) and are written to the shared folder. A round is one pass over
them: each task holds the centroids sorted by component mean and looks for every vector outward from the vector's own mean.
With k components, sums S and deviations V (the norm of x less its mean), the squared distance is at least
``(Sx - Sc)^2 / k + (Vx - Vc)^2``; the first part alone ends a direction of the scan, both together reject a centroid, and
what is left gets its exact distance in integers. The float bounds are lowered by their rounding error, so no nearest
centroid and no tie is lost. A task adds up its vectors per cluster; only ``k`` sums a cluster and round are exchanged and
reach the driver, a bound of clusters x components that does not grow with the table.

Defined cases: a null vector, one of another length, or one with a null, NaN or infinite component is left out; repeated
rows count each; a row without vec_id is assigned like others but starts no centroid; fewer vectors than centroids give as
many clusters; an empty table gives no rows; other columns are ignored. A whole number beyond 2^27 in size raises an error,
as its squared distances may not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourpanel.session import materialise

SCALE, COMPONENTS, CLUSTERS, ROUNDS, SEED = 256, 64, 40, 5, 2
LARGEST = 1 << 27


class Centroids:
    """Centroids in the order of their component means."""

    def __init__(self, vectors: np.ndarray) -> None:
        sums = vectors.sum(axis=1)
        self.order = np.lexsort((np.arange(len(vectors)), sums))
        self.at, self.sums = vectors[self.order], sums[self.order].astype(np.float64)
        self.deviations = deviations(self.at)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row (ties: smaller number), and how many exact
        distances that took."""
        n, last, k = len(x), len(self.at) - 1, x.shape[1]
        sums, spread = x.sum(axis=1).astype(np.float64), deviations(x)
        up = np.searchsorted(self.sums, sums)  # next centroid of a mean not below the vector's
        down = up - 1
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.at))
        active, exact = np.arange(n), 0
        while len(active):
            lo, hi, s = down[active], up[active], sums[active]
            below = np.where(lo >= 0, s - self.sums[np.maximum(lo, 0)], np.inf)
            above = np.where(hi <= last, self.sums[np.minimum(hi, last)] - s, np.inf)
            downward = below <= above
            gap = np.minimum(below, above)
            limit = best[active] * (1 + 1e-9) + 1
            go = gap * gap / k <= limit  # else all farther means are rejected too, and gaps at the end are infinite
            active, downward, gap, limit = active[go], downward[go], gap[go], limit[go]
            if not len(active):
                break
            c = np.where(downward, down[active], up[active])
            down[active[downward]] -= 1
            up[active[~downward]] += 1
            near = gap * gap / k + (spread[active] - self.deviations[c]) ** 2 <= limit
            rows, c = active[near], c[near]
            d = ((x[rows] - self.at[c]) ** 2).sum(axis=1)
            exact += len(rows)
            c = self.order[c]
            better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], c[better]
        return number, best, exact


def deviations(x: np.ndarray) -> np.ndarray:
    """Norm of each row less its mean."""
    centred = x - x.mean(axis=1, keepdims=True)
    return np.sqrt((centred * centred).sum(axis=1))


def whole_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the kept vectors as whole numbers."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform(F.col("x"), lambda e: F.floor(e * scale).cast("double"))
    large = F.exists("w", lambda e: F.abs(e) > LARGEST)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == components) & ~F.coalesce(bad, F.lit(True)))
    fits = F.when(large, F.raise_error(F.lit("a component is too large for squared distances in a long"))).otherwise(F.col("w"))
    return kept.select("vec_id", whole.alias("w")).select("vec_id", fits.cast("array<bigint>").alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and vec_id; at most ``clusters`` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select("v", key.alias("h")).orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per cluster seen by this task how many vectors it has and their sums."""
    search, total, n = Centroids(centroids), np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            number, _, _ = search.nearest(x)
            order = np.argsort(number, kind="stable")
            held, start = np.unique(number[order], return_index=True)
            total[held] += np.add.reduceat(x[order], start, axis=0)
            n += np.bincount(number, minlength=len(n))
    held = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(list(total[held]), type=pa.list_(pa.int64()))], names=["cluster", "n", "s"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    search = Centroids(centroids)
    for batch in batches:
        if batch.num_rows:
            number, distance, _ = search.nearest(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the exact floor of each cluster's mean; an empty cluster's stays."""
    parts = vectors.select("v").mapInArrow(lambda it: _sums(it, centroids), "cluster int, n long, s array<bigint>")
    exact = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # a row per cluster
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of ``vectors`` (vec_id, embedding)."""
    spark: SparkSession = vectors.sparkSession
    kept = materialise(whole_vectors(vectors, components, scale), "vectors")
    at = first_centroids(kept, clusters, seed)
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(at):
        return spark.createDataFrame([], names)
    for _ in range(rounds):
        at = moved(kept, at)
    found = materialise(kept.mapInArrow(lambda it: _assigned(it, at), "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row per cluster
    digest = lambda c: hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(c, n, sum(inertia.values()), digest(c)) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same by comparing every vector with every centroid."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL
            ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {clusters})""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, unnest(best).c AS c, unnest(best).d AS d FROM (
                SELECT kept.r, any_value(kept.vec_id) AS vec_id, any_value(kept.v) AS v,
                    [min(struct_pack(d := list_sum(list_transform(range(1, {COMPONENTS + 1}), lambda i: (kept.v[i] - c{i}.v[i]) * (kept.v[i] - c{i}.v[i])))::BIGINT, c := c{i}.c))] AS best
                FROM kept, c{i} GROUP BY kept.r))"""
        )
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {COMPONENTS + 1})) AS i FROM a{i}) GROUP BY c, i)""")
            steps.append(f"""n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{i} GROUP BY c)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} ON c{i}.c = n{i}.c)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia,
            (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""


ORACLE_SQL = _oracle()
