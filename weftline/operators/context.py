"""Competition among pairs, the decision, and its evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import fixed as V


def row(n: int | None, by: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def survivors(pairs: DataFrame, score: str, least: float = V.STAGE_TWO_LEAST, most: int = V.STAGE_TWO_TOP) -> DataFrame:
    """Pairs of at least the score, the first few of each record."""
    w = Window.partitionBy("eid").orderBy(F.desc(score), "cid")
    return pairs.filter(F.col(score) >= least).withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= most).drop("_rk")


def context(pairs: DataFrame, score: str) -> DataFrame:
    """Eight features of the rivals of each pair, in both directions. The rival of a record is its second best pair, for the
    best as for all others; 0 where it has one pair only."""
    e, c, s = Window.partitionBy("eid"), Window.partitionBy("cid"), F.col(score)
    by_c = c.orderBy(F.desc(score), "eid")
    whole = by_c.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rival = F.coalesce(F.nth_value(score, 2).over(whole), F.lit(0.0))
    first = pairs.withColumns({"cx_rank_s1": F.row_number().over(e.orderBy(F.desc(score), "cid")), "cx_gap_s1": F.round(s - F.max(s).over(e), 6), "cx_n_s1": F.count(F.lit(1)).over(e), "cx_sum_s1": F.round(F.sum(s).over(e), 6)})
    second = first.withColumn("cx_rank_c", F.row_number().over(by_c))
    return second.withColumns({"cx_gap_rival_c": F.round(s - rival, 6), "cx_gap_best_c": F.round(s - F.max(s).over(c), 6), "cx_n_c": F.count(F.lit(1)).over(c)})


def decide(pairs: DataFrame, score: str, least: float) -> DataFrame:
    """Each candidate record with its best record of source 1, where that is at least the threshold."""
    w = Window.partitionBy("cid").orderBy(F.desc(score), "eid")
    return pairs.withColumn("_rk", F.row_number().over(w)).filter((F.col("_rk") == 1) & (F.col(score) >= least)).drop("_rk")


def per_record(predicted: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """(eid, nt, np, tp) for all records, those without truth or prediction included."""
    p = predicted.select("eid", "cid").withColumn("p", F.lit(1))
    t = truth.select("eid", "cid").withColumn("t", F.lit(1))
    both = p.join(t, ["eid", "cid"], "full").groupBy("eid").agg(F.count("t").alias("nt"), F.count("p").alias("np"), F.count(F.expr("t + p")).alias("tp"))
    return ids.select("eid").join(both, "eid", "left").fillna(0, ["nt", "np", "tp"])


def f_half(counts: DataFrame) -> DataFrame:
    """counts with f: 1 where nothing is true and nothing predicted, else 1.25 tp / (0.25 nt + np)."""
    f = F.when((F.col("nt") == 0) & (F.col("np") == 0), 1.0).otherwise(1.25 * F.col("tp") / (0.25 * F.col("nt") + F.col("np")))
    return counts.withColumn("f", f)


def macro_f_half(predicted: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    return f_half(per_record(predicted, truth, ids)).agg(F.round(F.avg("f"), 6).alias("f05"), F.count(F.lit(1)).alias("records"))


def metrics(predicted: DataFrame, candidates: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """Pair precision and recall, candidate recall, candidates per record, and the bound of a perfect matcher."""

    p, t = predicted.select("eid", "cid").withColumn("p", F.lit(1)), truth.select("eid", "cid").withColumn("t", F.lit(1))
    c = candidates.select("eid", "cid").withColumn("c", F.lit(1))
    per = c.join(p, ["eid", "cid"], "full").join(t, ["eid", "cid"], "full").groupBy("eid").agg(
        F.count("t").alias("nt"), F.count("p").alias("np"), F.count(F.expr("p + t")).alias("tp"), F.count("c").alias("nc"), F.count(F.expr("c + t")).alias("tc"))
    per = ids.select("eid").join(per, "eid", "left").fillna(0, ["nt", "np", "tp", "nc", "tc"])

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0)).cast("double")

    def f(tp: str, n: str) -> Column:
        return F.avg(F.when((F.col("nt") == 0) & (F.col(n) == 0), 1.0).otherwise(F.try_divide(1.25 * F.col(tp), 0.25 * F.col("nt") + F.col(n))))

    each = F.coalesce(F.try_divide(F.sum("nc"), F.count(F.lit(1))), F.lit(0.0)).cast("double")
    return per.agg(share("tp", "np").alias("precision"), share("tp", "nt").alias("recall"), share("tc", "nt").alias("candidate_recall"), each.alias("candidates_per_record"),
                   F.coalesce(f("tc", "tc"), F.lit(0.0)).alias("perfect_f05"), F.coalesce(f("tp", "np"), F.lit(0.0)).alias("f05"))


def threshold_sweep(pairs: DataFrame, score: str, truth: DataFrame, ids: DataFrame, low: float, high: float, step: float) -> DataFrame:
    """(thr, f05) for each threshold of the grid from low to below high. One pass: a pair counts for every threshold up to its score, so the winners
    carry the grid as an array of a few dozen values; no cross join with the records."""
    grid = [round(low + i * step, 6) for i in range(math.ceil((high - low) / step - 1e-9))]
    won = decide(pairs, score, -1e300).join(truth.select("eid", "cid").withColumn("t", F.lit(1)), ["eid", "cid"], "left")
    over = F.filter(F.array(*map(F.lit, grid)), lambda g: g <= F.col(score))
    hits = won.select("eid", "t", F.explode(over).alias("thr")).groupBy("eid", "thr").agg(F.count(F.lit(1)).alias("np"), F.count("t").alias("tp"))
    nt = truth.groupBy("eid").agg(F.count(F.lit(1)).alias("nt"))
    # a record without pairs at a threshold has f = 1 without truth, else 0
    base = ids.select("eid").join(nt, "eid", "left").fillna(0, ["nt"])
    totals = base.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("nt") == 0).alias("free"))
    got = hits.join(base, "eid").groupBy("thr").agg(F.sum(1.25 * F.col("tp") / (0.25 * F.col("nt") + F.col("np"))).alias("f"), F.count_if(F.col("nt") == 0).alias("spoiled"))
    every = ids.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, grid))).alias("thr")).join(got, "thr", "left").fillna(0, ["f", "spoiled"])
    n, free = totals.select("n").scalar(), totals.select("free").scalar()
    return every.select("thr", F.round((F.col("f") + free - F.col("spoiled")) / n, 6).alias("f05"))


def best_threshold(sweep: DataFrame, last: bool = False) -> DataFrame:
    """The threshold of the highest f05; where equal the smallest, or the largest with last."""
    sign = 1 if last else -1
    return sweep.agg(F.max(F.struct("f05", (sign * F.col("thr")).alias("m"))).alias("b")).select((sign * F.col("b.m")).alias("thr"), "b.f05")


def recall_threshold(pairs: DataFrame, score: str, truth: DataFrame, keep: float = 0.995, most: int = V.STAGE_TWO_TOP) -> DataFrame:
    """(thr): the score that keeps the given share of the true pairs, as an order statistic. A true pair that is not among the
    first pairs of its record is lost whatever the threshold and counts against the share.

    Counts per rounded score are cumulated, not rows: the window runs over distinct scores."""
    t = truth.select("eid", "cid")
    w = Window.partitionBy("eid").orderBy(F.desc(score), "cid")
    top = pairs.select("eid", "cid", score).withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= most)
    true = top.join(t, ["eid", "cid"], "left_semi").groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("k"))
    every = pairs.join(t, ["eid", "cid"], "left_semi").agg(F.count(F.lit(1))).scalar()
    kept = true.agg(F.sum("k")).scalar()
    allowed = F.greatest(F.floor((1 - F.lit(keep)) * every + 1e-9) - (every - kept), F.lit(0))
    low = true.withColumn("upto", F.sum("k").over(Window.orderBy("s")))
    return low.filter(F.col("upto") > allowed).agg(F.min("s").alias("thr"))
