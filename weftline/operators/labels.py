"""Truth, folds and samples that both engines agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truth(lists: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """(id, cid): one row for each id of a comma-joined list; empty lists give none."""
    ids = F.filter(F.split(F.coalesce(list_col, F.lit("")), ","), lambda x: F.trim(x) != "")
    return lists.select(id_col, F.explode(ids).alias("cid")).withColumn("cid", F.trim("cid")).distinct()


def portable_hash(c: Column, seed: int) -> Column:
    """Eight hex digits of an md5 as a number: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string"))), 1, 8), 16, 10).cast("long")


def part_of(c: Column, seed: int, n: int) -> Column:
    """The number of a seeded part of n, from 0: inner splits of the folds."""
    return F.pmod(portable_hash(c, seed), F.lit(n))


#: Seed and parts of the inner splits: of fold A, of fold B, of fold C, and within the part of C that is fitted on.
INNER_A, INNER_B, SPLIT_C, INNER_C = (99, 5), (5, 10), (7, 5), (3, 10)


def fold_of(c: Column) -> Column:
    """A, B or C in 20, 50 and 30 percent of the ids."""
    k = F.pmod(portable_hash(c, 7), F.lit(10))
    return F.when(k < 2, "A").when(k < 7, "B").otherwise("C")


def negative_sample(pairs: DataFrame, label: str, percent: int = 35, seed: int = 99) -> DataFrame:
    """All positives and the given percentage of the negatives, chosen by hash."""
    h = F.pmod(portable_hash(F.concat_ws("|", "eid", "cid"), seed), F.lit(100))
    return pairs.filter((F.col(label) == 1) | (h < percent))
