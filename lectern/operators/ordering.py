"""Ordered computations per group that survive one very large group.

A plain ``Window.partitionBy(key)`` puts a whole group into one task. That is the
right plan while groups are small, so it is used whenever the largest group is
under a row bound. Past the bound the rows are range-partitioned on
(keys, order) and written once, which cuts a large group into ordered blocks of
ordinary partition size. Each function then runs inside the blocks, and a table
with one row per (group, block) carries totals and last values across them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut_lineage

MAX_GROUP_ROWS = 2_000_000

_ROW = "__row"
_BLOCK = "__block"


def has_large_group(df: DataFrame, keys: list[str], max_rows: int = MAX_GROUP_ROWS) -> bool:
    """True when some group of ``keys`` has more than ``max_rows`` rows.

    The count combines on the map side, so the check costs one pass over the
    key columns whatever the skew.
    """
    sizes = df.groupBy(*keys).count()
    return bool(sizes.where(F.col("count") > max_rows).limit(1).count())


def any_large_group(tables: list[DataFrame], key: str, max_rows: int = MAX_GROUP_ROWS) -> bool:
    """``has_large_group`` of several tables with the same key, in one aggregate."""
    keyed = [df.select(key, F.lit(i).alias("__table")) for i, df in enumerate(tables)]
    sizes = reduce(DataFrame.unionByName, keyed).groupBy(key, "__table").count()
    return not sizes.where(F.col("count") > max_rows).isEmpty()


@dataclass(frozen=True)
class Spec:
    kind: str
    value: Column | None = None
    inclusive: bool = True


def ordinal() -> Spec:
    """1-based position."""
    return Spec("ordinal")


def group_size() -> Spec:
    """Number of rows in the group."""
    return Spec("size")


def running_sum(value: Column, inclusive: bool = True) -> Spec:
    return Spec("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Spec:
    return Spec("max", value, inclusive)


def last_value(value: Column, inclusive: bool = True) -> Spec:
    """Latest non-null value at or before the row."""
    return Spec("last", value, inclusive)


def next_value(value: Column, inclusive: bool = True) -> Spec:
    """Earliest non-null value at or after the row."""
    return Spec("next", value, inclusive)


def _combine(kind: str, near: Column, far: Column) -> Column:
    if kind == "size":
        return far
    if kind in ("ordinal", "sum"):
        return F.when(near.isNull() & far.isNull(), None).otherwise(
            F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
        )
    if kind == "max":
        return F.greatest(near, far)
    return F.coalesce(near, far)


def _windowed(spec: Spec, partition: list[str], order: list[Column], reverse: list[Column]) -> Column:
    forward = Window.partitionBy(*partition).orderBy(*order)
    if spec.kind == "size":
        return F.count(F.lit(1)).over(Window.partitionBy(*partition))
    if spec.kind == "ordinal":
        return F.row_number().over(forward).cast("long")
    # "next" walks the reversed order: a frame that ends at the current row is
    # kept incrementally, one that starts there is recomputed for every row.
    base = Window.partitionBy(*partition).orderBy(*reverse) if spec.kind == "next" else forward
    frame = base.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
    if spec.kind == "sum":
        return F.sum(spec.value).over(frame)
    if spec.kind == "max":
        return F.max(spec.value).over(frame)
    return F.last(spec.value, ignorenulls=True).over(frame)


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: dict[str, Spec],
    *,
    large: bool | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add one column per spec, computed in ``order`` within ``keys``.

    ``order`` names columns, ascending, and should identify a row within its
    group. ``large`` skips the size check when the caller already knows.
    """
    if large is None:
        large = has_large_group(df, keys, max_rows)
    ascending = [F.col(c).asc() for c in order]
    descending = [F.col(c).desc() for c in order]
    if not large:
        return df.select(
            "*", *[_windowed(s, keys, ascending, descending).alias(n) for n, s in specs.items()]
        )

    blocks = cut_lineage(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(_ROW, F.monotonically_increasing_id())
    ).withColumn(_BLOCK, F.shiftright(_ROW, 33))

    totals, carried = [F.count(F.lit(1)).alias("__n")], []
    across = Window.partitionBy(*keys).orderBy(F.col(_BLOCK).asc())
    across_back = Window.partitionBy(*keys).orderBy(F.col(_BLOCK).desc())
    for name, spec in specs.items():
        cell = f"__t_{name}"
        if spec.kind in ("ordinal", "size"):
            totals.append(F.count(F.lit(1)).alias(cell))
        elif spec.kind == "sum":
            totals.append(F.sum(spec.value).alias(cell))
        elif spec.kind == "max":
            totals.append(F.max(spec.value).alias(cell))
        elif spec.kind == "last":
            totals.append(F.max_by(spec.value, F.when(spec.value.isNotNull(), F.col(_ROW))).alias(cell))
        else:
            totals.append(F.min_by(spec.value, F.when(spec.value.isNotNull(), F.col(_ROW))).alias(cell))
        base = across_back if spec.kind == "next" else across
        frame = base.rowsBetween(Window.unboundedPreceding, -1)
        if spec.kind == "size":
            frame = Window.partitionBy(*keys)
        agg = {
            "ordinal": F.sum(cell),
            "size": F.sum(cell),
            "sum": F.sum(cell),
            "max": F.max(cell),
        }.get(spec.kind, F.last(cell, ignorenulls=True))
        carried.append(agg.over(frame).alias(f"__far_{name}"))
    # One row per (group, block): at most groups + partitions rows in all.
    far = blocks.groupBy(*keys, _BLOCK).agg(*totals).select(*keys, _BLOCK, *carried)

    near = blocks.select(
        "*",
        *[
            _windowed(s, [*keys, _BLOCK], [F.col(_ROW).asc()], [F.col(_ROW).desc()]).alias(f"__near_{n}")
            for n, s in specs.items()
        ],
    )
    far = far.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, _BLOCK]})
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in [*keys, _BLOCK]]
    )
    return near.join(far, same, "left").select(
        *[F.col(c) for c in df.columns],
        *[
            _combine(s.kind, F.col(f"__near_{n}"), F.col(f"__far_{n}")).alias(n)
            for n, s in specs.items()
        ],
    )


def sweep(
    left: DataFrame,
    at: str,
    tracks: dict[str, tuple[DataFrame, str, list[str]]],
    keys: list[str],
    *,
    large: bool | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """As-of match of ``left`` rows against several tracks in one sorted pass.

    A track is (rows, time column, payload columns) with at most one row per
    (keys, time). Each left row gains ``<track>_prev`` (latest at or before
    ``at``) and ``<track>_next`` (earliest after ``at``), structs of the time
    and the payload. The union is sorted once, so no row pairs are built.
    """
    left_cols = [c for c in left.columns if c not in keys]
    events = left.select(
        *keys,
        F.col(at).cast("double").alias("__at"),
        F.lit(1).alias("__kind"),
        # Rows that share a time still get distinct sort keys, so a pile of
        # equal times can be cut into blocks too.
        F.xxhash64(*left_cols).alias("__tie"),
        F.struct(*left_cols).alias("__left"),
    )
    specs = {}
    for name, (rows, time, cols) in tracks.items():
        t = F.col(time).cast("double")
        points = rows.select(
            *keys,
            t.alias("__at"),
            F.lit(0).alias("__kind"),
            F.lit(0).cast("long").alias("__tie"),
            F.struct(t.alias("t"), *cols).alias(name),
        )
        events = events.unionByName(points, allowMissingColumns=True)
        specs[f"{name}_prev"] = last_value(F.col(name))
        specs[f"{name}_next"] = next_value(F.col(name))
    out = ordered(
        events, keys, ["__at", "__kind", "__tie"], specs, large=large, max_rows=max_rows
    )
    return out.where("__kind = 1").select(
        *keys, *[F.col(f"__left.{c}").alias(c) for c in left_cols], *specs.keys()
    )


def nearest(
    left: DataFrame,
    at: str,
    right: DataFrame,
    right_at: str,
    rank: str,
    payload: list[str],
    keys: list[str],
    *,
    large: bool | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """The right row closest in time to each left row; ties go to the lowest ``rank``.

    Adds ``near`` (struct of dist, rank and payload; null where the group has no
    right row).
    """
    # One right row per time: of several at the same time the lowest rank wins.
    points = (
        right.withColumn("__t", F.col(right_at).cast("double"))
        .groupBy(*keys, "__t")
        .agg(F.min(F.struct(F.col(rank).alias("rank"), *payload)).alias("row"))
    )
    cols = [F.col("row").alias("row")]
    swept = sweep(left, at, {"pt": (points, "__t", cols)}, keys, large=large, max_rows=max_rows)

    def candidate(side: str) -> Column:
        pt = F.col(f"pt_{side}")
        return F.when(
            pt.isNotNull(),
            F.struct(
                F.abs(pt["t"] - F.col(at)).alias("dist"),
                pt["row"]["rank"].alias("rank"),
                *[pt["row"][c].alias(c) for c in payload],
            ),
        )

    return swept.withColumn(
        "near", F.least(candidate("prev"), candidate("next"))
    ).drop("pt_prev", "pt_next")
