"""Queries of the subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import match, mix, names, pack, places, spans, topn
from weftline.session import cut
from weftline.sources.tables import table


#: How far a share may be from the plan (a leaf ends within half a text), and a budget that makes small sources fall short.
SHARE_ERROR, SHORT_BUDGET = 0.01, 3.0


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    one, two, three = (table(spark, d, t) for t in ("train_s1", "train_s2", "train_s3"))
    return match.match(one, [two, three])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("eid", "cid")


def p3_top8(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "train_scored"), "eid", "cid", "bscore", 8)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_top8(spark, d).select("eid", "cid")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_organisation(table(spark, d, "test_s2"))


def p4_organisations(spark: SparkSession, d: str) -> DataFrame:
    return names.organisations(table(spark, d, "test_s2"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return places.same_location(table(spark, d, "test_s3"))


def p5_locations(spark: SparkSession, d: str) -> DataFrame:
    return places.locations(table(spark, d, "test_s3"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return pack.report(p6_pack(spark, d), table(spark, d, "pack_sizes"))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing: all texts placed, no container above its capacity, no text of at most the capacity split."""
    docs, sizes = table(spark, d, "documents"), table(spark, d, "pack_sizes")
    p = cut(pack.pack(docs, sizes), "packed").join(sizes.select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity_tokens").alias("cap")), "pack_id")
    boxes = p.groupBy("pack_id", "container", "cap").agg(F.sum("n_tokens").alias("t")).groupBy("pack_id").agg(F.count_if(F.col("t") > F.col("cap")).alias("over"))
    texts = p.groupBy("pack_id", "doc_id", "cap").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k")).groupBy("pack_id").agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("t") <= F.col("cap")) & (F.col("k") > 1)).alias("split"))
    return texts.join(boxes, "pack_id").select("pack_id", "texts", "over", "split")


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a mix: no text more often than its source allows, and the share of every source that has texts as planned."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    m = mix.Mix(docs, targets)
    over = cut(m.selection(), "mixed").join(targets.select("source", "max_repeats"), "source").groupBy("source").agg(F.count_if(F.col("times") > F.col("max_repeats")).alias("over"))
    off = F.abs(F.col("planned_share") - F.col("actual_share")) > SHARE_ERROR
    return m.shares().filter("target_share > 0 AND planned_share > 0").join(over, "source", "left").select("source", F.coalesce("over", F.lit(0)).alias("over"), off.alias("off"))


def p7_short(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a budget that is larger than the small sources can give: the others take over what those lack."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    first = mix.Mix(docs, targets)
    return mix.Mix(docs, targets, budget=SHORT_BUDGET * first.budget).shares()


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).selection()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_span_pairs(table(spark, d, "documents"))


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_span_classes(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p3_found, p3_top8, p4_found, p4_organisations, p5_found, p5_locations, p6_pack, p6_report, p6_checked, p7_mix, p7_shares, p7_checked, p7_short, p8_found, p8_shared, p8_classes)}

_TOP8 = """WITH best AS (SELECT eid, cid, max(bscore) AS bscore FROM train_scored WHERE bscore IS NOT NULL AND NOT isnan(bscore) GROUP BY eid, cid),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY eid ORDER BY bscore DESC, cid) AS INTEGER) AS rk FROM best)"""

SQL = {
    "p3_found": f"{_TOP8} SELECT eid, cid FROM r WHERE rk <= 8",
    "p3_top8": f"{_TOP8} SELECT eid, cid, bscore, rk FROM r WHERE rk <= 8",
    "p6_checked": "SELECT CAST(pack_id AS INTEGER) AS pack_id, (SELECT count(DISTINCT doc_id) FROM documents) AS texts, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS split FROM pack_sizes",
    "p7_checked": "SELECT source, CAST(0 AS BIGINT) AS over, false AS off FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text <> '')",
}
