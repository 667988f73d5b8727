"""Centroid clustering with Ptolemaic pivots.

Vectors become integers once and are written with their distances to a few fixed pivots.
For pivots p, s, a vector v and a centroid c, Ptolemy's inequality gives

    d(v, c) * d(p, s) >= |d(v, p) * d(c, s) - d(v, s) * d(c, p)|

so the cached distances bound d(v, c) from below without looking at the vector. A vector
first measures the centroid with the smallest bound; every centroid whose bound, rounded
down, is not above that distance survives and is measured exactly, in integers. The pivots
are starting centroids, taken farthest first.

A round is one pass without a shuffle of vectors: every task sums the vectors of each centroid
and sends one row per centroid and task; the driver receives a row per centroid.

Defined results: vectors that are null, of another length, or with a null or non-finite
component are left out; components are cut to +-``LIMIT`` so that squared distances fit a long; equal
distances go to the smaller number; repeated rows count each; null ids are clustered, and
start a centroid only after all others; with fewer vectors than ``k`` there are as many
centroids; an empty centroid stays where it is; further columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

K = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = 2
PIVOTS = 6
LIMIT = 2**26
#: Vectors measured at a time.
BLOCK = 4096
#: Relative room for the rounding of square roots and products.
ROOM = 1e-9


def quantised(vectors: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """The usable vectors as ``__llm_v``, each component floor(SCALE * x)."""
    x = F.col(vector)
    usable = x.isNotNull() & (F.size(x) == dimensions) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    whole = F.transform(
        x, lambda c: F.greatest(F.least(F.floor(F.least(F.greatest(c.cast("double"), F.lit(-1e15)), F.lit(1e15)) * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    )
    return vectors.where(usable).withColumn("__llm_v", whole)


def starting(vectors: DataFrame, k: int = K, seed: int = SEED, key: str = "vec_id") -> np.ndarray:
    """The ``k`` vectors whose hashed ids come first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = vectors.select(order.alias("h"), "__llm_v").orderBy(F.asc_nulls_last("h"), "__llm_v").limit(k).collect()
    return np.array([r["__llm_v"] for r in rows], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    difference = a - b
    return np.einsum("ij,ij->i", difference, difference)


def to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(vectors, p[None, :]) for p in pivots], axis=1).astype(np.float64))


def choose_pivots(start: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` different rows: the first, then always the one farthest from those chosen."""
    chosen = [0]
    nearest = squared(start, start[:1])
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(start, start[chosen[-1]][None, :]))
    return start[chosen]


def lower_bounds(near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Per vector and centroid, a distance that the true one is not below.

    ``near`` has the vectors' distances to the pivots. Each product is rounded down
    by ``ROOM`` of the larger one, which is far more than its floating-point error.
    """
    far = to_pivots(centroids, pivots)
    best = np.zeros((len(near), len(centroids)))
    for p in range(len(pivots)):
        # The triangle inequality, for the case of a single pivot.
        np.maximum(best, np.abs(near[:, p, None] - far[None, :, p]) - ROOM * (near[:, p, None] + far[None, :, p]), out=best)
        for s in range(p + 1, len(pivots)):
            between = float(np.sqrt(float(squared(pivots[p : p + 1], pivots[s : s + 1])[0])))
            one, other = near[:, p, None] * far[None, :, s], near[:, s, None] * far[None, :, p]
            bound = (np.abs(one - other) - ROOM * np.maximum(one, other)) / between
            np.maximum(best, bound * (1 - ROOM), out=best)
    return best


def nearest(
    vectors: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector, and how many distances were measured."""
    bounds = lower_bounds(near, centroids, pivots)
    cluster = bounds.argmin(axis=1)
    distance = squared(vectors, centroids[cluster])
    reach = np.sqrt(distance.astype(np.float64)) * (1 + ROOM)
    survives = bounds <= reach[:, None]
    survives[np.arange(len(vectors)), cluster] = False
    row, rival = np.nonzero(survives)
    measured = squared(vectors[row], centroids[rival])
    # Of all measured ones the smallest distance, then the smallest number.
    rows = np.concatenate([np.arange(len(vectors)), row])
    numbers, distances = np.concatenate([cluster, rival]), np.concatenate([distance, measured])
    order = np.lexsort((numbers, distances, rows))
    first = order[np.searchsorted(rows[order], np.arange(len(vectors)))]
    return numbers[first], distances[first], len(vectors) + len(row)


def _matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def with_pivots(vectors: DataFrame, pivots: np.ndarray, key: str = "vec_id") -> DataFrame:
    """(key, __llm_v, __llm_near): the vectors with their distances to the pivots."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = to_pivots(_matrix(batch.column(1), pivots.shape[1], np.int64), pivots)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(pivots))
            near = pa.ListArray.from_arrays(offsets, pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, near], names=[*batch.schema.names, "__llm_near"])

    return vectors.select(key, "__llm_v").mapInArrow(run, f"`{key}` {kind}, __llm_v array<int>, __llm_near array<double>")


def _assigned(
    batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            part = batch.slice(start, BLOCK)
            v = _matrix(part.column("__llm_v"), centroids.shape[1], np.int64)
            near = _matrix(part.column("__llm_near"), len(pivots), np.float64)
            yield part, v, *nearest(v, near, centroids, pivots)[:2]


def step(vectors: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means, empty ones unchanged.

    Sums stay whole numbers: a long per task, decimals between tasks, Python's on the driver.
    """
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, v, cluster, _ in _assigned(batches, centroids, pivots):
            np.add.at(sums, cluster, v)
            counts += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(counts)
        offsets = pa.array(np.arange(len(used) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.ListArray.from_arrays(offsets, pa.array(sums[used].ravel()))],
            names=["cluster", "n", "sums"],
        )

    parts = vectors.mapInArrow(run, "cluster long, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
    )
    moved = centroids.copy()
    for r in total.collect():
        moved[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(width)]
    return moved


def assign(vectors: DataFrame, centroids: np.ndarray, pivots: np.ndarray, key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance) of every vector, the distance squared."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance in _assigned(batches, centroids, pivots):
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(cluster, pa.int32()), pa.array(distance)], names=[key, "cluster", "distance"]
            )

    return vectors.mapInArrow(run, f"`{key}` {kind}, cluster int, distance long")


def clustered(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding",
    dimensions: int = DIMENSIONS, seed: int = SEED, n_pivots: int = PIVOTS,
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every usable vector, and the final centroids."""
    usable = quantised(vectors.select(key, vector), vector, dimensions).select(key, "__llm_v")
    centroids = starting(usable, k, seed, key)
    if not len(centroids):
        return usable.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    pivots = choose_pivots(centroids, n_pivots)
    kept = common.stage(with_pivots(usable, pivots, key), "vectors")
    for _ in range(rounds):
        centroids = step(kept, centroids, pivots)
    return common.stage(assign(kept, centroids, pivots, key), "clusters"), centroids


def op13(spark, sf) -> DataFrame:
    found, centroids = clustered(common.documents(spark, sf, "embeddings"))
    digests = [(i, sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = found.agg(F.sum("distance").alias("inertia"))
    # One row per centroid, and one row.
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(inertia, "cluster")
    return found.join(F.broadcast(named), "cluster").join(F.broadcast(total)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def sql(k: int = K, rounds: int = ROUNDS, width: int = DIMENSIONS) -> str:
    """The rounds written out one after the other."""
    floor = "greatest(least(floor({s} * x::DOUBLE), {m}), -{m})::BIGINT".format(s=SCALE, m=LIMIT)
    away = "list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = (
        "a{0} AS MATERIALIZED (SELECT v.row, v.vec_id, v.v, unnest(arg_min(struct_pack(cluster := c.cluster, distance := "
        + away + "), struct_pack(d := " + away + ", n := c.cluster))) FROM vectors v, c{0} c GROUP BY v.row, v.vec_id, v.v)"
    )
    steps = [near.format(0)]
    for i in range(1, rounds + 1):
        steps.append(
            f"m{i} AS (SELECT cluster, d, sum(v[d])::BIGINT AS s, count(*) AS n"
            f" FROM a{i - 1}, range(1, {width + 1}) r(d) GROUP BY cluster, d)"
        )
        steps.append(
            f"c{i} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{i - 1} c LEFT JOIN"
            f" (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS c FROM m{i} GROUP BY cluster) m USING (cluster))"
        )
        steps.append(near.format(i))
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: {floor}) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS cluster, v AS c
  FROM vectors QUALIFY cluster < {k}),
{", ".join(steps)}
SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} USING (cluster)"""


SQL = sql()

# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
