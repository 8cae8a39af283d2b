"""Second pass: what confident partners of a record say about further candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import fixed as V
from weftline.operators.blocking import Blocking, cosine, top_candidates
from weftline.operators.context import decide


def confident(pairs: DataFrame, score: str, least: float = V.SURE) -> DataFrame:
    """(eid, sib, p): candidates that surely belong to their best record."""
    return decide(pairs, score, least).select("eid", F.col("cid").alias("sib"), F.col(score).alias("p"))


def sibling_probe(sure: DataFrame, cand: DataFrame, most: int = V.SIBLING_PROBE, known: Blocking | None = None) -> DataFrame:
    """(sib, cid, sps, scos): each sure candidate looked up among the candidates of its country, itself left out. The keys of the
    candidates are taken from known, a blocking against the same candidates, where there is one."""
    ids = sure.select(F.col("sib").alias("eid")).distinct()
    b = Blocking.among(ids, known) if known else Blocking(cand.join(ids, "eid", "left_semi"), cand)
    got = cosine(top_candidates(b.pairs, most), b.w1, b.w2)
    return got.select(F.col("eid").alias("sib"), "cid", F.col("ps").alias("sps"), F.col("bscore").alias("scos"))


def evidence(sure: DataFrame, probed: DataFrame) -> DataFrame:
    """(eid, cid, sib_bscore, sib_ps, sib_hits, best_sib): the best and the number of siblings that point to a candidate."""
    best = F.max(F.struct("scos", (-F.col("sib")).alias("m")))
    rows = sure.select("eid", "sib").join(probed, "sib").groupBy("eid", "cid")
    return rows.agg(F.max("scos").alias("sib_bscore"), F.max("sps").alias("sib_ps"), F.count(F.lit(1)).alias("sib_hits"), best.alias("b")).select("eid", "cid", "sib_bscore", "sib_ps", "sib_hits", (-F.col("b.m")).alias("best_sib"))


SCORES = ["ps", "bscore", "bscore_name", "bscore_num", "rank_s1", "rank_c", "prank_s1"]


def universe(pairs: DataFrame, ev: DataFrame, sure: DataFrame, scores: DataFrame, most_new: int = V.SIBLING_TOP) -> DataFrame:
    """Pairs of the first pass and, of each record, the best new ones by sibling evidence, with the scores of the first pass
    (all columns of pairs), the evidence, and the blocking scores where blocking had the pair."""
    ev = ev.join(sure.select("eid", F.col("sib").alias("cid")), ["eid", "cid"], "left_anti")
    w = Window.partitionBy("eid").orderBy(F.desc("sib_bscore"), "cid")
    new = ev.join(pairs.select("eid", "cid"), ["eid", "cid"], "left_anti").withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= most_new)
    keys = pairs.select("eid", "cid").unionByName(new.select("eid", "cid"))
    return keys.join(pairs, ["eid", "cid"], "left").join(ev, ["eid", "cid"], "left").join(scores.select("eid", "cid", *SCORES), ["eid", "cid"], "left")


def competition(uni: DataFrame, sure: DataFrame, score: str) -> DataFrame:
    """The universe with what other records and the sure partners of a record mean for each pair.

    Sizes and maxima are aggregates joined back, not windows, so a record with very many pairs is in no single task."""
    sizes = uni.groupBy("eid").agg(F.count(F.lit(1)).alias("u_n_s1"))
    best = uni.groupBy("cid").agg(F.count(F.lit(1)).alias("u_n_c"), F.round(F.coalesce(F.max(score), F.lit(0.0)), 6).alias("c_best_p3"))
    n = sure.groupBy("eid").agg(F.count(F.lit(1)).alias("n_conf"), F.count_if(F.col("sib") >= V.THIRD_SOURCE).alias("n_conf_s3"))
    owner = sure.select(F.col("sib").alias("cid"), F.col("eid").alias("owner"), F.col("p").alias("op"))
    is_s3 = F.col("cid") >= V.THIRD_SOURCE
    d = uni.join(sizes.join(n, "eid", "left"), "eid").join(best.join(owner, "cid", "left"), "cid").fillna(0, ["n_conf", "n_conf_s3", "sib_hits"])
    return d.select(
        *uni.columns, F.col(score).isNull().cast("int").alias("is_new"), "u_n_s1", "u_n_c",
        F.round(F.col("c_best_p3") - F.coalesce(score, F.lit(0.0)), 6).alias("c_best_other_gap"), "c_best_p3",
        "n_conf", "n_conf_s3", is_s3.cast("int").alias("is_s3"), F.when(is_s3, F.col("n_conf_s3")).otherwise(F.col("n_conf") - F.col("n_conf_s3")).alias("n_conf_same_src"),
        F.when(F.col("owner") != F.col("eid"), F.col("op")).alias("other_conf_p3"),
    )


def narrow(uni: DataFrame, score: str, most: int = V.SIBLING_TOP_LATER, least: float = V.SIBLING_LEAST) -> DataFrame:
    """All pairs of the first pass; new ones only among the record's first by sibling evidence (old pairs rank too). The ranks
    come from a group limit, so only a few pairs of a record are ever sorted together."""
    w = Window.partitionBy("eid").orderBy(F.desc_nulls_last("sib_bscore"), "cid")
    first = uni.select("eid", "cid", "sib_bscore").withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= most).select("eid", "cid", F.lit(True).alias("first"))
    d = uni.join(first, ["eid", "cid"], "left")
    return d.filter(F.col(score).isNotNull() | (F.col("first") & (F.col("sib_bscore") >= least))).drop("first")


def unseen(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Records whose country does not occur in the known ones."""
    return ids.join(known.select("country").distinct(), "country", "left_anti")


def pseudo_labels(pairs: DataFrame, score: str, low: float = V.PSEUDO_LOW, high: float = V.PSEUDO_HIGH) -> DataFrame:
    """(eid, cid, y): labels from sure scores; records with any pair between the bounds are left out whole."""
    s = F.col(score)
    open_ = pairs.filter((s > low) & (s < high)).select("eid").distinct()
    first = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc(score), "eid")) == 1
    y = F.when((s >= high) & F.col("first"), 1).when(s <= low, 0)
    return pairs.withColumn("first", first).join(open_, "eid", "left_anti").select("eid", "cid", y.alias("y")).na.drop(subset=["y"])


def rewrite(old: DataFrame, new: DataFrame, where: DataFrame, id_col: str, value: str) -> DataFrame:
    """old with the value of new for the ids in where (empty where new has none), all other rows as they were."""
    n = new.select(id_col, F.col(value).alias("_new"))
    d = old.join(where.select(id_col).distinct().withColumn("_hit", F.lit(True)), id_col, "left").join(n, id_col, "left")
    return d.select(id_col, F.when(F.col("_hit"), F.coalesce("_new", F.lit(""))).otherwise(F.col(value)).alias(value))
