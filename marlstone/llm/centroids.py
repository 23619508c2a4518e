"""Centroid clustering (Lloyd's rounds) with bounds that drift by geometry.

A vector keeps its cluster, an upper bound of the distance to its own centroid
and a lower bound of the distance to every other one.  When centroids move, the
upper bound grows by its centroid's drift.  The lower bound need not fall by the
whole drift of the others: all vectors of cluster i lie in a sphere about its
old centroid, and for a centroid that moved from a to b no point x of the sphere
comes closer by more than

    |x-a| - |x-b|  =  2 d p / (|x-a| + |x-b|)  <=  d cos(angle(x-m, b-a)),

where m is the middle of a and b, d their distance and p the component of x-m
along b-a.  In the plane through a, b and the sphere's middle the least such
angle is that of the middle less that under which the sphere is seen from m
(:func:`loosening`).  Where the whole sphere lies behind, the bound even rises.
A vector whose bounds stay apart keeps its cluster without a distance; then its
own distance is taken; what is still ambiguous is measured against every
centroid, exactly.

Arithmetic is exact: components and centroids are integers, distances are
squared integers.  Bounds are rounded outwards, and a tie is never decided by
them.  A round is a pass over a written table, and an aggregate with one row for
each cluster.

Edge cases: vectors of another length, null ones and ones with a null or
non-finite component are left out; ids may be null (they are drawn last) or
repeat; with fewer vectors than centroids every vector is one; an empty table
gives an empty result; a component beyond 2**27 is an error, as squares would
leave 64 bits; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shipped, tidy, written

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Largest size of a component: squares of differences, 64 of them, fit in 64 bits.
MOST = 2**27
#: Largest size at which floating-point products of components are exact.
EXACT = 2**22
#: How far bounds are rounded outwards.
SLACK = 1e-9

STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, distance long, scanned boolean"
_STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64()), ("scanned", pa.bool_())])


def whole_vectors(table: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of ``dims`` finite components, scaled and floored."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = table.where((F.size("embedding") == dims) & ~F.coalesce(F.exists("embedding", bad), F.lit(True)))
    far = lambda x: F.when(F.abs(x) <= MOST, x).otherwise(F.raise_error(F.lit("a component is too large")).cast("double"))
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(far(scale * x.cast("double"))).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """Vectors with the smallest hashes, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", h.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()  # one a cluster
    return np.array([r.v for r in rows], dtype=np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """``out[i, j]``: at most so much closer comes centroid j to any point within
    ``radius[i]`` of old centroid i, when it moves from ``old[j]`` to ``new[j]``."""
    a, b = old.astype(float), new.astype(float)
    drift = np.sqrt(((b - a) ** 2).sum(1))
    to = a[:, None, :] - (a + b)[None, :, :] / 2  # [i, j]: from j's middle to i's sphere
    far = np.sqrt((to**2).sum(2))
    along = (to * (b - a)[None]).sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip(along / (far * drift), -1, 1))
        seen = np.arcsin(np.clip(radius[:, None] / far, -1, 1))
    out = drift * np.cos(np.maximum(angle - seen, 0))
    near = np.maximum(far - radius[:, None], 0)
    out = np.where(out < 0, out * 2 * near / (2 * near + drift), out)  # what lies behind recedes less near the middle
    out = np.where(far > radius[:, None], out, drift)
    out = np.where(drift > 0, out, 0.0)
    return np.minimum(out + SLACK * (1 + np.abs(out)), drift * (1 + SLACK) + SLACK)


def squares(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids, exact."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        x, c = v.astype(float), centroids.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)


def assigner(centroids: np.ndarray, drift: np.ndarray | None, loose: np.ndarray | None, last: bool):
    """A pass over rows of vectors (the first) or of ``STATE``."""
    k, dims = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dims)
            own = np.full(n, -1, dtype=np.int64)
            if drift is None:
                cluster, upper, lower, scan = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.ones(n, bool)
            else:
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                upper = batch.column("upper").to_numpy() + drift[cluster]
                lower = batch.column("lower").to_numpy() - loose[cluster]
                ask = np.flatnonzero(last | (upper >= lower))
                own[ask] = ((v[ask] - centroids[cluster[ask]]) ** 2).sum(1)
                upper[ask] = np.sqrt(own[ask]) * (1 + SLACK) + SLACK
                scan = upper >= lower
            at = np.flatnonzero(scan)
            if len(at):
                d = squares(v[at], centroids)
                cluster[at] = d.argmin(1)  # of equals the first
                best = np.partition(d, min(1, k - 1), axis=1)
                own[at] = best[:, 0]
                upper[at] = np.sqrt(best[:, 0]) * (1 + SLACK) + SLACK
                lower[at] = np.sqrt(best[:, 1]) * (1 - SLACK) - SLACK if k > 1 else np.inf
            cols = [batch.column("vec_id"), batch.column("v"), cluster, upper, lower, pa.array(own, mask=own < 0), scan]
            yield pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, _STATE.types, strict=True)], schema=_STATE)

    return assign


def moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the clusters, floored, and radii about the old centroids."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("upper").alias("radius"), *sums).collect():  # one a cluster
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(centroids.shape[1])]
        radius[r.cluster] = r.radius
    return new, radius


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> tuple[DataFrame, np.ndarray, list[DataFrame]]:
    """``vectors`` (vec_id, v) as rows of ``STATE`` with exact distances, the
    final centroids, and the states of all rounds (for what was scanned)."""
    spark = vectors.sparkSession
    shipped(spark)
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], STATE), centroids, []
    state, states, bounds = vectors, [], (None, None)
    for r in range(rounds + 1):
        state = written(state.mapInArrow(tidy(assigner(centroids, *bounds, r == rounds)), STATE), f"round{r}")
        states.append(state)
        if r < rounds:
            new, radius = moved(state, centroids)
            loose = loosening(centroids, new, radius)
            np.fill_diagonal(loose, -np.inf)
            drift = np.sqrt(((new - centroids).astype(float) ** 2).sum(1)) * (1 + SLACK) + SLACK
            bounds, centroids = (drift, loose.max(1) if len(new) > 1 else np.zeros(1)), new
    return state, centroids, states


def op13_geometric_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    state, centroids, _ = clustered(vectors)
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    names = spark.createDataFrame(list(enumerate(shas)), "cluster int, centroid_sha256 string")
    per = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per = per.join(names, "cluster").crossJoin(F.broadcast(per.agg(F.sum("cluster_inertia").alias("inertia"))))  # a row a cluster, one row
    return state.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    kept = f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS cluster, v AS c FROM kept QUALIFY cluster < {CLUSTERS}),
ids AS (SELECT row_number() OVER () AS rid, * FROM kept)"""
    parts = [kept]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT rid, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM ids, c{r})")
        parts.append(f"a{r} AS (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({DIMS})) AS pos FROM a{r}) GROUP BY 1, 2)")
            parts.append(f"m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS m FROM s{r} GROUP BY 1)")
            parts.append(f"c{r + 1} AS (SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))")
    return f"""WITH {', '.join(parts)} SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
 sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)"""


OP13_SQL = _sql()
