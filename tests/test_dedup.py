"""Greedy duplicates against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import dedup as d

SCHEMA = "video_id int, frame_id long, path string, timestamp_sec double, phash long"


def loop(rows, threshold, limit):
    kept = {}
    for v, i, _, _, h in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        if h is None:
            continue
        mine = kept.setdefault(v, [])
        if len(mine) < limit and all(
            1.0 - bin((h ^ g) & (2**64 - 1)).count("1") / 64.0 <= threshold for _, g in mine
        ):
            mine.append((i, h))
    return {(v, i) for v, mine in kept.items() for i, _ in mine}


def rows(n=600, seed=1):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(25)]
    out = []
    for i in range(n):
        h = rng.choice(bases)
        for _ in range(rng.randrange(8)):
            h ^= 1 << rng.randrange(64)
        if i % 40 == 7:
            h = None
        elif h >= 2**63:
            h -= 2**64
        # Video 0 has a third of the frames.
        out.append((0 if i % 3 == 0 else rng.randrange(1, 5), i, f"p{i}", float(i // 2), h))
    return out


@pytest.mark.parametrize(
    "threshold,limit,fold,step",
    [
        (0.95, 200, 10_000, 1000), (0.95, 200, 50, 20), (0.9, 100, 50, 20), (0.7, 25, 10_000, 1000), (0.7, 25, 50, 3),
        (0.7, 5, 50, 10), (0.5, 3, 10_000, 1000), (1.0, 30, 50, 10),
    ],
)
def test_equals_loop(spark, threshold, limit, fold, step):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = d.deduplicate(df, threshold, limit, fold_rows=fold, round_rows=step)
    assert {(r.video_id, r.frame_id) for r in got.collect()} == loop(data, threshold, limit)


@pytest.mark.parametrize("threshold,block", [(0.95, 20), (0.95, 150), (0.9, 30), (0.99, 7)])
def test_blocks_equal_loop(spark, threshold, block):
    data = rows(900, seed=4)
    # A slow drift, where every frame is close to the next one only.
    drift, h = [], 0
    for i in range(60):
        drift.append((9, 10_000 + i, "d", float(i), h))
        h ^= 0b11 << (2 * (i % 31))
    df = spark.createDataFrame(data + drift, SCHEMA)
    got = d.deduplicate(df, threshold, float("inf"), fold_rows=40, round_rows=20, block_rows=block)
    assert {(r.video_id, r.frame_id) for r in got.collect()} == loop(data + drift, threshold, 10**9)
    some = d.deduplicate(df, threshold, 25, fold_rows=40, round_rows=20, block_rows=block)
    assert {(r.video_id, r.frame_id) for r in some.collect()} == loop(data + drift, threshold, 25)


def test_close_hashes_share_a_key(spark):
    rng = random.Random(8)
    pairs = []
    for d_max in (0, 1, 3, 6):
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), d_max):
                b ^= 1 << bit
            pairs.append((d_max, *[x - 2**64 if x >= 2**63 else x for x in (a, b)]))
    df = spark.createDataFrame(pairs, "d int, a long, b long")
    for d_max in (0, 1, 3, 6):
        mine = df.where(f"d = {d_max}")
        shared = F.size(F.array_intersect(d._keys(F.col("a"), d_max), d._keys(F.col("b"), d_max)))
        assert mine.where(shared == 0).isEmpty()


def test_distance_is_strict():
    assert d.largest_duplicate_distance(0.95) == 3
    assert d.largest_duplicate_distance(0.9) == 6
    assert d.largest_duplicate_distance(0.7) == 19
    assert d.largest_duplicate_distance(0.75) == 15
    assert d.largest_duplicate_distance(1.0) == -1


def test_failed_hashes(table):
    frames = table(SCHEMA, (1, 1, "a", 5.0, None), (1, 2, "b", 3.0, None), (2, 3, "c", 0.0, None), (2, 4, "d", 1.0, 7))
    assert {(r.video_id, r.frame_id) for r in d.deduplicate(frames).collect()} == {(1, 2), (2, 4)}
    assert {r.frame_id for r in d.unhashed(frames).collect()} == {1, 2, 3}


def test_dropped_frames_suppress_nothing(table):
    # b is close to a, c is close to b only: c stays.
    frames = table(SCHEMA, (1, 1, "a", 0.0, 0), (1, 2, "b", 1.0, 0b111), (1, 3, "c", 2.0, 0b111111))
    assert {r.frame_id for r in d.deduplicate(frames, 0.95).collect()} == {1, 3}


def test_nothing_similar_keeps_the_other_rules(table):
    frames = table(SCHEMA, (1, 1, "a", 1.0, 7), (1, 2, "b", 2.0, 8), (2, 3, "c", 1.0, None), (2, 4, "d", 2.0, None))
    assert sorted(r["frame_id"] for r in d.deduplicate(frames, 1.0).collect()) == [1, 2, 3]
    assert sorted(r["frame_id"] for r in d.deduplicate(frames, 1.0, 0).collect()) == [1, 3]
