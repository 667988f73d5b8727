"""A sequential state per group, carried along sorted rows.

For work that no aggregate or window expresses: a hash over rows in order, a stack. Rows
come to a task sorted by group and order, as a stream of Arrow batches; the state of one
group is held at a time, and never the rows of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

OUT_ROWS = 10_000


class State(Protocol):
    def take(self, *values: Any) -> Iterator[tuple] | None:
        """Use one row (the columns after the keys); may give rows."""

    def end(self) -> Iterator[tuple] | None:
        """After the last row of the group; may give rows."""


def fold_partitions(rows: DataFrame, keys: list[str], start: Callable[[], State], schema: str) -> DataFrame:
    """Fold rows that lie sorted in their partitions, the keys being their first columns.

    ``schema`` names what ``take`` and ``end`` give; the keys stand before it.
    """
    n = len(keys)
    out = StructType([rows.schema[k] for k in keys] + StructType.fromDDL(schema).fields)
    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []

        def filled() -> pa.RecordBatch:
            columns = zip(*made) if made else [[] for _ in names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            made.clear()
            return batch

        now, state = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if state is None or row[:n] != now:
                    if state is not None:
                        made.extend((*now, *r) for r in state.end() or ())
                    now, state = row[:n], start()
                made.extend((*now, *r) for r in state.take(*row[n:]) or ())
                if len(made) >= OUT_ROWS:
                    yield filled()
        if state is not None:
            made.extend((*now, *r) for r in state.end() or ())
        yield filled()

    return rows.mapInArrow(run, out)


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], State], schema: str) -> DataFrame:
    """Fold the rows of every group in order; ``take`` gets the columns other than the keys."""
    rest = [c for c in rows.columns if c not in keys]
    placed = rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    return fold_partitions(placed, keys, start, schema)
