"""Python functions over many small groups: sorted by the JVM, walked in one Arrow stream per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT_ROWS = 8192
#: Rows for a task of costly Python work. Such tables are small in bytes, so tasks would be merged by size.
TASK_ROWS = 10_000


def spread(rows: int) -> int:
    """The number of tasks for that many rows."""
    return max(1, -(-rows // TASK_ROWS))


def over_groups(df: DataFrame, keys: list[str], columns: list[str], f: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """The rows that f(key, rows) returns for each group. A task holds one group at a time, so a group must be small by
    construction (aggregated forms, not records)."""
    wanted = StructType.fromDDL(schema)
    arrow, n = to_arrow_schema(wanted), len(keys)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow)], schema=arrow)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[:n] != key:
                    if held:
                        out += f(key, held)
                    key, held = row[:n], []
                held.append(row[n:])
            if len(out) >= OUT_ROWS:
                yield batch(out)
                out = []
        if held:
            out += f(key, held)
        if out:
            yield batch(out)

    return df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(walk, schema)
