"""Ordered computations: block by block they must equal plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import ordering as o

def specs():
    return {
        "n": o.ordinal(),
        "total": o.running_sum(F.col("x")),
        "before": o.running_sum(F.col("x"), inclusive=False),
        "top": o.running_max(F.col("x"), inclusive=False),
        "latest": o.last_value(F.col("y")),
        "earlier": o.last_value(F.col("y"), inclusive=False),
        "coming": o.next_value(F.col("y")),
        "later": o.next_value(F.col("y"), inclusive=False),
    }


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of the rows and many small ones."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = 0 if i % 3 == 0 else rng.randrange(1, 60)
        rows.append((key, rng.randrange(400), i, rng.randrange(100), rng.choice([None, rng.randrange(9)])))
    return spark.createDataFrame(rows, "k int, t int, i int, x long, y int").repartition(7)


def plain(rows):
    """The same columns, by a loop."""
    out = {}
    groups = {}
    for r in sorted(rows, key=lambda r: (r.k, r.t, r.i)):
        groups.setdefault(r.k, []).append(r)
    for key, group in groups.items():
        for p, r in enumerate(group):
            back, front = group[: p + 1], group[p:]

            def first(items):
                return next((q.y for q in items if q.y is not None), None)

            out[key, r.t, r.i] = (
                p + 1,
                sum(q.x for q in back),
                sum(q.x for q in back[:-1]) if p else None,
                max(q.x for q in back[:-1]) if p else None,
                first(reversed(back)), first(reversed(back[:-1])), first(front), first(front[1:]),
            )
    return out


@pytest.mark.parametrize("max_rows", [10_000, 100])
def test_ordered(skewed, max_rows):
    got = o.ordered(skewed, ["k"], ["t", "i"], specs(), max_rows=max_rows).collect()
    want = plain(skewed.collect())
    assert len(got) == 3000
    assert {(r.k, r.t, r.i): tuple(r[n] for n in specs()) for r in got} == want


def test_size_check(skewed):
    assert o.has_large_group(skewed, ["k"], 999)
    assert not o.has_large_group(skewed, ["k"], 1000)


@pytest.mark.parametrize("max_rows", [10_000, 50])
def test_nearest_equals_brute_force(spark, max_rows):
    rng = random.Random(8)
    left = [(rng.choice([1, 1, 2, 3]), i, float(rng.randrange(200))) for i in range(400)]
    right = [(rng.choice([1, 2]), i, float(rng.randrange(0, 200, 7)), f"p{i}") for i in range(90)]
    ldf = spark.createDataFrame(left, "k int, i int, t double")
    rdf = spark.createDataFrame(right, "k int, j int, u double, path string")
    got = o.nearest(ldf, "t", rdf, "u", "j", ["path"], ["k"], max_rows=max_rows).collect()
    assert len(got) == 400
    for r in got:
        near = min(
            ((abs(u - r.t), j, p) for k, j, u, p in right if k == r.k), default=None
        )
        assert (tuple(r.near) if r.near else None) == near


def test_pile_of_equal_times(spark):
    """A third of the rows at one time can still be cut into blocks."""
    left = spark.range(3000).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.0).alias("t"))
    right = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("j"), (F.col("id") * 300.0).alias("u"))
    a = o.nearest(left, "t", right, "u", "j", [], ["k"], max_rows=100)
    b = o.nearest(left, "t", right, "u", "j", [], ["k"], max_rows=10_000)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
