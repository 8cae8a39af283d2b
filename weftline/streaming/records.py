"""Records as a stream: files of a table arrive, each record counts once, the counts stay up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import shared_dir


def arriving(spark: SparkSession, paths: list[str], late: str = "60 days", files: int = 64) -> DataFrame:
    """The records of parquet tables (folders or patterns) as they arrive; a record delivered again within the watermark is
    dropped."""
    parts = [spark.readStream.schema(spark.read.parquet(p).schema).option("maxFilesPerTrigger", files).parquet(p) for p in paths]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    return rows.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["eid"])


def upkeep(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Counts per key, kept by a stateful aggregate and written once all that is there has arrived."""
    spark = rows.sparkSession
    table = f"counts_{uuid.uuid4().hex}"
    q = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).writeStream.outputMode("complete").format("memory").queryName(table)
    q.option("checkpointLocation", f"{shared_dir(spark)}/{table}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(table)


def append_new(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Append the records that are new since the last call to a table, once each."""
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
