"""Parquet tables of a directory, and the record sources built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

RECORDS = ("train_s1", "train_s2", "train_s3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...], *cols: str) -> DataFrame:
    """The rows of several tables of one schema, cut to cols before the union so that each scan reads only those."""
    parts = [table(spark, sf_dir, n).select(*cols) for n in names]
    return reduce(DataFrame.unionByName, parts)
