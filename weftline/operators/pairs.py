"""Cheap features of record pairs: native array expressions only, no Python, no shuffle beyond the two joins to the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import fixed as V
from weftline.operators.blocking import tokens

FEATURES = (
    "ps bscore bscore_name bscore_num rank_s1 rank_c prank_s1 best_s1 best_c second_c second_s1 n_s1_for_c n_c_for_s1 rel_s1 rel_c margin_c margin_s1 is_s3 "
    "nm_jacc nm_ovl sk_jacc sk_ovl aw_jacc aw_ovl num_jacc num_ovl hn_eq concat_eq legal_eq legal_conflict addr_empty2 indic2 n_tok1 n_tok2 n_aw1 n_aw2 n_num1 n_num2"
).split()


def side(rec: DataFrame, id_col: str, n: int) -> DataFrame:
    """One side's token arrays."""
    cols = {"tn": "n_core", "tk": "n_skel", "ta": "a_words", "tu": "a_nums", "tl": "n_legal"}
    arrays = [tokens(c).alias(f"{k}{n}") for k, c in cols.items()]
    return rec.select(F.col("eid").alias(id_col), *arrays, F.replace("n_core", F.lit(" "), F.lit("")).alias(f"cc{n}"), (F.col("a_norm") == "").alias(f"ae{n}"), F.col("indic").alias(f"in{n}"))


def shares(a: str, b: str) -> tuple[Column, Column]:
    """Jaccard and overlap of two token lists whose sizes count repeats; 0 where a side is empty."""
    both, x, y = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return F.round(F.coalesce(F.try_divide(both, x + y - both), F.lit(0.0)), 6), F.round(F.coalesce(F.try_divide(both, F.least(x, y)), F.lit(0.0)), 6)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def cheap_features(ranked: DataFrame, one: DataFrame, cand: DataFrame) -> DataFrame:
    """eid, cid and the 38 features of FEATURES."""
    d = ranked.join(side(one, "eid", 1), "eid").join(side(cand, "cid", 2), "cid")
    out: dict[str, Column] = {}
    for n, t in (("nm", "tn"), ("sk", "tk"), ("aw", "ta"), ("num", "tu")):
        out[f"{n}_jacc"], out[f"{n}_ovl"] = shares(f"{t}1", f"{t}2")
    out["rel_s1"] = F.round(F.coalesce(F.try_divide("bscore", "best_s1"), F.lit(0.0)), 6)
    out["rel_c"] = F.round(F.coalesce(F.try_divide("bscore", "best_c"), F.lit(0.0)), 6)
    out["margin_c"] = F.round(F.col("bscore") - F.when(F.col("rank_c") == 1, F.col("second_c")).otherwise(F.col("best_c")), 6)
    out["margin_s1"] = F.round(F.col("bscore") - F.when(F.col("rank_s1") == 1, F.col("second_s1")).otherwise(F.col("best_s1")), 6)
    out["is_s3"] = flag(F.col("cid") >= V.THIRD_SOURCE)
    out["hn_eq"] = flag(F.get("tu1", F.lit(0)) == F.get("tu2", F.lit(0)))
    out["concat_eq"] = flag((F.col("cc1") == F.col("cc2")) & (F.col("cc1") != ""))
    out["legal_eq"] = flag(F.array_sort("tl1") == F.array_sort("tl2"))
    out["legal_conflict"] = flag((F.size("tl1") > 0) & (F.size("tl2") > 0) & ~F.arrays_overlap("tl1", "tl2"))
    out["addr_empty2"], out["indic2"] = flag(F.col("ae2")), flag(F.col("in2"))
    for n, t in (("n_tok", "tn"), ("n_aw", "ta"), ("n_num", "tu")):
        out[f"{n}1"], out[f"{n}2"] = F.size(f"{t}1"), F.size(f"{t}2")
    return d.withColumns(out).select("eid", "cid", *FEATURES)
