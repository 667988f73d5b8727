"""Centroid clustering."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"
rng = random.Random(67)


def vectors(n=300, spread=0.2):
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(7)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)], 0) for i in range(n)]
    rows += [(n + i, rows[3][1], 0) for i in range(150)]
    rows += [(7, rows[9][1], 0), (7, rows[9][1], 0), (None, rows[5][1], 0)]
    bad = [None, [], [0.0] * 63, [0.0] * 65, [None] + [0.0] * 63, [float("nan")] + [0.0] * 63, [float("inf")] * 64]
    return rows + [(5000 + i, b, None) for i, b in enumerate(bad)]


def expected(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted(
        ((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    )
    middle = [v for _, _, v in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        got = assign()
        for n in range(len(middle)):
            mine = [v for (_, v), (_, at) in zip(kept, got) if at == n]
            if mine:
                middle[n] = [sum(x) // len(mine) for x in zip(*mine)]
    got = assign()
    inertia = {n: sum(d for d, at in got if at == n) for n in range(len(middle))}
    return sorted(
        (str(i), n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, middle[n])).encode()).hexdigest())
        for (i, _), (d, n) in zip(kept, got)
    )


@pytest.mark.parametrize("n", [0, 12, 300])
def test_equals_plain_rounds(spark, table, saved, n):
    rows = vectors(300) if n == 300 else [r for r in vectors(20) if r[0] is not None][:n] + [(99, None, 1)]
    got = centroids.op13(spark, saved(embeddings=table(SCHEMA, *rows))).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == expected(rows)


@pytest.mark.parametrize("spread", [0.0, 0.01, 0.3, 3.0])
def test_bounds_prune_and_never_mislead(spread):
    v = np.array([[int(256 * x) for x in r[1]] for r in vectors(400, spread)[:500]], np.int64)
    middle = v[:40]
    for n_pivots in (1, 2, 6):
        pivots = centroids.choose_pivots(middle, n_pivots)
        near = centroids.to_pivots(v, pivots)
        true = ((v[:, None, :] - middle[None, :, :]) ** 2).sum(axis=2)
        assert (centroids.lower_bounds(near, middle, pivots) <= np.sqrt(true) + 1e-9).all()
        cluster, distance, measured = centroids.nearest(v, near, middle, pivots)
        assert (cluster == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
        if n_pivots == 6 and spread <= 0.01:
            assert measured < true.size / 2


def test_floor_of_negative_means_and_large_values(spark, table):
    rows = [(1, [-0.5 / 256] * 64, 0), (2, [3e38] * 64, 0), (3, [-3e38] * 64, 0), (4, [1.5 / 256] * 64, 0)]
    found, middle = centroids.clustered(table(SCHEMA, *rows).withColumns({"cluster": F.lit("x"), "__llm_v": F.lit(1)}), k=4, rounds=1)
    assert sorted(c[0] for c in middle.tolist()) == [-centroids.LIMIT, -1, 1, centroids.LIMIT] and found.count() == 4
    found, middle = centroids.clustered(table(SCHEMA, *rows[::3]), k=1, rounds=1)
    assert middle.tolist() == [[0] * 64]


def test_edge_tables(spark, table, saved):
    assert centroids.op13(spark, saved(embeddings=table(SCHEMA).limit(0))).count() == 0
