"""Per-key results over keys of very unequal frequency.

Every aggregate here is algebraic (count, sum, min, max), so Spark's partial hash aggregation keeps one bounded table of
key states per task, spills it as mergeable states when memory runs out, and shuffles one row per key and task instead
of one per record. A key with a third of all rows then weighs as much in the shuffle as any other key: no salting is
needed, and no task ever holds the rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens_of(c: Column) -> Column:
    """The distinct non-empty tokens of a space-joined text; null gives an empty array."""
    return F.filter(F.array_distinct(F.split(F.coalesce(c, F.lit("")), " ")), lambda t: t != "")


def token_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    """(fld, tok): one row for each row of df, field and distinct token in it.

    Nulls and empty texts give no row; repeated rows of df each count. One scan serves all fields."""

    def of(f: str) -> Column:
        return F.transform(tokens_of(F.col(f)), lambda t: F.struct(F.lit(f).alias("fld"), t.alias("tok")))

    pairs = F.flatten(F.array(*[of(f) for f in fields]))
    return df.select(F.explode(pairs).alias("p")).select("p.fld", "p.tok")


def combine_by_key(rows: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Group rows by keys under algebraic aggregates. For a distinct count use distinct_by_key."""
    return rows.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def distinct_by_key(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The number of distinct values per key, as two algebraic steps.

    The first groups by key and value, so a heavy key is spread over all tasks; the second sums partial counts. Nulls in
    value are not counted; a key with nulls only gives 0."""
    return rows.groupBy(*keys, value).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count(value).alias(name))


def token_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(fld, tok, n_rows): the number of rows that hold the token. A row counts once per token; empty df gives no row."""
    return combine_by_key(token_rows(df, fields), ["fld", "tok"], n_rows=F.count(F.lit(1)))


def heavy_tokens(df: DataFrame, fields: list[str], share_pct: int) -> DataFrame:
    """(fld, tok, n_rows, n_all): tokens that at least share_pct percent of all rows of df hold.

    The total is one scalar that the plan computes itself; integers are compared, so the bound is exact."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return token_counts(df, fields).withColumn("n_all", total).filter(F.col("n_rows") * 100 >= F.col("n_all") * share_pct)


def heaviest_tokens(df: DataFrame, fields: list[str], k: int) -> DataFrame:
    """The k heaviest tokens of each field (ties: token ascending) with their rank, a report of bounded size.

    Ranking by the window would send all tokens of a field to one task; the first k by orderBy + limit of each field are
    k rows per task at most."""
    counts = token_counts(df, fields)
    tops = [counts.filter(F.col("fld") == f).orderBy(F.desc("n_rows"), F.asc("tok")).limit(k) for f in fields]
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    w = Window.partitionBy("fld").orderBy(F.desc("n_rows"), F.asc("tok"))
    return top.withColumn("rk", F.row_number().over(w))
