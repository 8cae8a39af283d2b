"""Queries of problem 2: keys of very unequal frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import combine
from weftline.sources.tables import RECORDS, union_tables

FIELDS = ["n_core", "a_words"]


def _records(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return union_tables(spark, d, RECORDS, *FIELDS, *more)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return combine.heavy_tokens(_records(spark, d), FIELDS, 5).select("fld", "tok")


def p2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return combine.token_counts(_records(spark, d), FIELDS)


def p2_token_records(spark: SparkSession, d: str) -> DataFrame:
    """Distinct records per token: repeated deliveries of an eid count once."""
    df = _records(spark, d, "eid")
    rows = [df.select(F.lit(f).alias("fld"), F.explode(combine.tokens_of(F.col(f))).alias("tok"), "eid") for f in FIELDS]
    return combine.distinct_by_key(rows[0].unionByName(rows[1]), ["fld", "tok"], "eid", "n_records")


def p2_heaviest(spark: SparkSession, d: str) -> DataFrame:
    return combine.heaviest_tokens(_records(spark, d), FIELDS, 20)


QUERIES = {f.__name__: f for f in (p2_found, p2_token_counts, p2_token_records, p2_heaviest)}

_ALL = "all_rows AS (" + " UNION ALL ".join(f"SELECT eid, n_core, a_words FROM {t}" for t in RECORDS) + ")"
_TOKS = """toks AS (
  SELECT 'n_core' AS fld, eid, unnest(list_distinct(string_split(n_core, ' '))) AS tok FROM all_rows
  UNION ALL SELECT 'a_words', eid, unnest(list_distinct(string_split(a_words, ' '))) FROM all_rows)"""
_COUNTS = "counts AS (SELECT fld, tok, count(*) AS n_rows FROM toks WHERE tok <> '' GROUP BY fld, tok)"

SQL = {
    "p2_found": f"WITH {_ALL}, {_TOKS}, {_COUNTS} SELECT fld, tok FROM counts WHERE n_rows * 100 >= 5 * (SELECT count(*) FROM all_rows)",
    "p2_token_counts": f"WITH {_ALL}, {_TOKS}, {_COUNTS} SELECT fld, tok, n_rows FROM counts",
    "p2_token_records": f"WITH {_ALL}, {_TOKS} SELECT fld, tok, count(DISTINCT eid) AS n_records FROM toks WHERE tok <> '' GROUP BY fld, tok",
    "p2_heaviest": f"""WITH {_ALL}, {_TOKS}, {_COUNTS}, r AS (
      SELECT fld, tok, n_rows, CAST(row_number() OVER (PARTITION BY fld ORDER BY n_rows DESC, tok) AS INTEGER) AS rk FROM counts)
      SELECT fld, tok, n_rows, rk FROM r WHERE rk <= 20""",
}
