"""Problem 3: the N best items of every group, also of groups with millions of items.

Method: partition lower bounds. Each task walks its rows in runs of bounded size. In a run, the N-th best distinct item of
a group is a lower bound for the group's final N-th best score, since N distinct items of at least that score exist; a
run only passes on the rows that reach its own bound, at most N (plus ties) for each group, so a group with a third of
all rows leaves each run as N rows. The highest bound of each group is joined to what is left, rows below it go, and the
survivors are ranked. Bounds, survivors and ranks all meet on one exchange by group.

Null and NaN scores, and rows with a null group or item, do not count. A pair stored more than once counts once with its
highest score. Ties: item ascending. Groups with fewer than N items give all they have; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task holds at once.
RUN_ROWS = 1_000_000


def _best_of_run(group: np.ndarray, item: np.ndarray, score: np.ndarray, n: int):
    """The rows of a run that are among the n best distinct items of their group there, and the group's bound (NaN where
    the run has fewer than n items of it)."""
    # the highest score of each pair first, the pairs once
    o = np.lexsort((-score, item, group))
    group, item, score = group[o], item[o], score[o]
    if len(group):
        first = np.ones(len(group), bool)
        first[1:] = (group[1:] != group[:-1]) | (item[1:] != item[:-1])
        group, item, score = group[first], item[first], score[first]
    o = np.lexsort((item, -score, group))
    group, item, score = group[o], item[o], score[o]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    rank = np.arange(len(group)) - np.repeat(starts, sizes)
    full = sizes >= n
    bound = np.full(len(starts), np.nan)
    bound[full] = score[starts[full] + n - 1]
    keep = rank < n
    return group[keep], item[keep], score[keep], np.repeat(bound, sizes)[keep]


def _bounded_runs(n: int, run_rows: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            t = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3)]
            *cols, bound = _best_of_run(*t, n)
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(bound, from_pandas=True)], names=["g", "i", "s", "bound"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= run_rows:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return walk


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """(group, item, score, rk): the first n distinct items of each group by score descending, then item ascending.

    group and item are integers. Only these three columns of df are read."""
    if n < 1:
        raise ValueError("n is at least 1")
    g, i, s = F.col(group).cast("long").alias("g"), F.col(item).cast("long").alias("i"), F.col(score).cast("double").alias("s")
    rows = df.select(g, i, s).filter("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    rows = rows.withColumn("s", F.col("s") + F.lit(0.0))
    left = rows.mapInArrow(_bounded_runs(n, run_rows), "g long, i long, s double, bound double")
    left = left.repartition("g")
    kept = left.withColumn("b", F.max("bound").over(Window.partitionBy("g"))).filter("b IS NULL OR s >= b")
    pairs = kept.groupBy("g", "i").agg(F.max("s").alias("s"))
    w = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))
    ranked = pairs.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rk")
