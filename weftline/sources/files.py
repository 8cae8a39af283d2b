"""Tab-separated files, match lists, and stages that are kept on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import fixed as V

RAW = ["entity_id", "business_name", "business_address", "country"]


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A file with a header and no quoting; every column a string, nothing null."""
    columns = columns or RAW
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.options(sep="\t", header=True, quote="", escape="", enforceSchema=False, mode="PERMISSIVE").schema(schema).csv(path).na.fill("")


def match_lists(ids: DataFrame, pairs: DataFrame, id_col: str = "eid", cid_col: str = "cid", name: str = "matched_entity_ids") -> DataFrame:
    """(id, list): one row for every id, its distinct partners sorted and comma-joined, empty where it has none."""
    lists = pairs.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set(F.col(cid_col).cast("string"))), ",").alias(name))
    return ids.select(id_col).distinct().join(lists, id_col, "left").withColumn(name, F.coalesce(name, F.lit("")))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", nullValue="").csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; computed and written only where it is not there yet."""
    if not exists(spark, path.rstrip("/") + "/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_ids(df: DataFrame, source: int, by: str = "entity_id") -> DataFrame:
    """df with eid: dense from the source's offset (0, 1e8, 2e8) in the order of an id column.

    The rank of a row is the number of rows in earlier range partitions plus its place in its own, so no window over the
    whole table is needed."""
    from weftline.session import cut

    parts = cut(df.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id()}), "ids")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("_first")).collect()  # one row per partition
    before, start = [], 0
    for r in sorted(sizes, key=lambda r: r["_p"]):
        before.append((r["_p"], start - r["_first"]))
        start += r["n"]
    if start > V.SECOND_SOURCE and source < 3:
        raise ValueError(f"source {source} has {start} records, ids of a source have room for {V.SECOND_SOURCE}")
    shift = df.sparkSession.createDataFrame(before, "_p int, _shift long")
    eid = (F.col("_k") + F.col("_shift") + F.lit({1: 0, 2: V.SECOND_SOURCE, 3: V.THIRD_SOURCE}[source])).alias("eid")
    return parts.join(F.broadcast(shift), "_p").select(eid, *df.columns)
