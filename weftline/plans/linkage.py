"""Queries of record linkage over the record tables, from keys to match lists.

Source 1 is train_s1, the candidates are train_s2 and train_s3; repeated deliveries of a record count once. Where a stage
starts from scored pairs, those are train_scored: each (eid, cid) with its highest scores. There are no labels; where a
stage needs truth, a candidate is true if its country, core name and first number equal those of a record of source 1."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import fixed as V
from weftline.operators import blocking as B
from weftline.operators import collective, context, dictionary, labels
from weftline.operators.pairs import cheap_features, FEATURES, shares
from weftline.sources.files import match_lists
from weftline.sources.tables import table, union_tables

COLS = ["eid", "entity_id", "country", "n_norm", "n_core", "n_legal", "n_skel", "a_norm", "a_words", "a_nums", "indic"]
TEXT = COLS[2:-1]


def clean(df: DataFrame) -> DataFrame:
    return df.select("eid", "entity_id", *[F.coalesce(c, F.lit("")).alias(c) for c in TEXT], F.coalesce("indic", F.lit(False)).alias("indic")).distinct()


def one(spark: SparkSession, d: str) -> DataFrame:
    return clean(table(spark, d, "train_s1").select(*COLS))


def cand(spark: SparkSession, d: str) -> DataFrame:
    return clean(union_tables(spark, d, ("train_s2", "train_s3"), *COLS))


def block(spark: SparkSession, d: str) -> B.Blocking:
    return B.Blocking(one(spark, d), cand(spark, d))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(eid, cid, ps, bscore, bscore_name, bscore_num), once for each pair with a score."""
    rows = table(spark, d, "train_scored").filter("bscore IS NOT NULL AND NOT isnan(bscore)")
    return rows.groupBy("eid", "cid").agg(*[F.round(F.coalesce(F.max(F.nanvl(c, F.lit(None))), F.lit(0.0)), 6).alias(c) for c in ("ps", "bscore", "bscore_name", "bscore_num")])


def truth(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in labels (eid, cid): equal country, core name and first number; the smallest eid where several."""
    key = [F.col("country"), F.col("n_core"), F.split("a_nums", " ")[0].alias("h")]
    full = "n_core <> '' AND a_nums <> '' AND country <> ''"
    a = one(spark, d).filter(full).select(*key, "eid").groupBy("country", "n_core", "h").agg(F.min("eid").alias("eid"))
    return cand(spark, d).filter(full).select(*key, F.col("eid").alias("cid")).join(a, ["country", "n_core", "h"]).select("eid", "cid")


# SQL: one chain of common table expressions; a query names the last it needs.
_REC = "SELECT DISTINCT eid, entity_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in TEXT) + ", coalesce(indic, false) AS indic FROM"
_R1 = f"{_REC} train_s1"
_R2 = f"{_REC} (FROM train_s2 UNION ALL FROM train_s3)"


def _keys(name: str, of: str) -> str:
    t = lambda c: f"(SELECT eid, country, unnest(string_split({c}, ' ')) AS t FROM {of})"
    stop = ", ".join(f"'{w}'" for w in V.ADDRESS_STOP)
    return f"""{name} AS (SELECT * FROM (
      SELECT eid, country, 'n' AS kt, 'n' || t AS key FROM {t("n_core")} WHERE length(t) >= 2
      UNION SELECT eid, country, 'k', 'k' || t FROM {t("n_skel")} WHERE length(t) >= 3
      UNION SELECT eid, country, 'c', 'c' || replace(n_core, ' ', '') FROM {of}
      UNION SELECT eid, country, 'a', 'a' || t FROM {t("a_words")} WHERE length(t) >= 3 AND t NOT IN ({stop})
      UNION SELECT eid, country, 'h', 'h' || t FROM {t("a_nums")} WHERE length(t) >= 1) WHERE length(key) > 2)"""


def _weigh(name: str, keys: str, df: str) -> str:
    return f"""{name} AS (SELECT k.*, coalesce(f.df, 0) AS df, round(ln(s.n + 1) - ln(coalesce(f.df, 0) + 1), 6) AS w
      FROM {keys} k LEFT JOIN {df} f USING (country, key) JOIN sizes s USING (country))"""


def _compound(name: str, w: str) -> str:
    return f"""{name}_r AS (SELECT eid, country, kt, key, row_number() OVER (PARTITION BY eid, kt ORDER BY df, key) AS rk FROM {w} WHERE kt IN ('n', 'a', 'h')),
    {name} AS (
      SELECT a.eid, a.country, 'x' AS kt, '1|' || a.key || '|' || b.key AS key FROM {name}_r a JOIN {name}_r b USING (eid) WHERE a.kt = 'n' AND b.kt = 'a' AND a.rk <= {V.RAREST_NAME} AND b.rk <= {V.RAREST_ADDRESS}
      UNION ALL SELECT a.eid, a.country, 'x', '2|' || a.key || '|' || b.key FROM {name}_r a JOIN {name}_r b USING (eid) WHERE a.kt = 'h' AND b.kt = 'a' AND a.rk <= {V.RAREST_NUMBER} AND b.rk <= {V.RAREST_ADDRESS}
      UNION ALL SELECT a.eid, a.country, 'x', '3|' || a.key || '|' || b.key FROM {name}_r a JOIN {name}_r b USING (eid) WHERE a.kt = 'n' AND b.kt = 'h' AND a.rk <= {V.RAREST_NAME} AND b.rk <= {V.RAREST_NUMBER}
      UNION ALL SELECT a.eid, a.country, 'm', '4|' || a.key || '|' || b.key FROM {name}_r a JOIN {name}_r b USING (eid) WHERE a.kt = 'n' AND b.kt = 'n' AND a.key < b.key AND a.rk <= {V.RAREST_IN_PAIRS} AND b.rk <= {V.RAREST_IN_PAIRS})"""


def chain(r1: str = _R1, r2: str = _R2, top: int = V.TOP_PROBE) -> str:
    kinds = ", ".join(f"'{k}'" for k in V.NAME_KINDS)
    return f"""r1 AS ({r1}), r2 AS ({r2}), {_keys("k1", "r1")}, {_keys("k2", "r2")},
    df AS (SELECT country, key, count(*) AS df FROM k2 GROUP BY ALL), sizes AS (SELECT country, count(*) AS n FROM r2 GROUP BY ALL),
    {_weigh("w1", "k1", "df")}, {_weigh("w2", "k2", "df")}, {_compound("c1", "w1")}, {_compound("c2", "w2")},
    dfx AS (SELECT country, key, count(*) AS df FROM c2 GROUP BY ALL), {_weigh("x1", "c1", "dfx")},
    every AS (SELECT eid, country, kt, key, df, w FROM w1 UNION ALL SELECT eid, country, kt, key, df, w FROM x1),
    probes AS (
      SELECT eid, country, kt, key, df, w FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY df, key) AS rk FROM every WHERE df BETWEEN 1 AND {V.MOST_DF}) WHERE rk <= {V.PROBES}
      UNION SELECT eid, country, kt, key, df, w FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY df, key) AS rk FROM every WHERE df BETWEEN 1 AND {V.NAME_MOST_DF} AND kt IN ({kinds})) WHERE rk <= {V.NAME_PROBES}),
    posting AS (SELECT country, key, eid AS cid FROM k2 UNION ALL SELECT country, key, eid FROM c2),
    probed AS (SELECT eid, cid, country, round(sum(w), 6) AS ps, round(sum(CASE WHEN kt IN ({kinds}) THEN w ELSE 0.0 END), 6) AS psn
      FROM probes JOIN posting USING (country, key) WHERE cid <> eid GROUP BY ALL),
    top AS (SELECT eid, cid, country, ps, psn FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY ps DESC, cid) AS rk FROM probed) WHERE rk <= {top}
      UNION SELECT eid, cid, country, ps, psn FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY psn DESC, cid) AS rk FROM probed WHERE psn > 0) WHERE rk <= {V.TOP_NAME}),
    n1 AS (SELECT eid, sqrt(sum(w * w)) AS n1 FROM w1 GROUP BY ALL), n2 AS (SELECT eid AS cid, sqrt(sum(w * w)) AS n2 FROM w2 GROUP BY ALL),
    dots AS (SELECT t.eid, t.cid, sum(a.w * a.w) AS d, sum(CASE WHEN a.kt IN ('n', 'k', 'c') THEN a.w * a.w ELSE 0.0 END) AS dn, sum(CASE WHEN a.kt = 'h' THEN a.w * a.w ELSE 0.0 END) AS dh
      FROM top t JOIN w1 a ON a.eid = t.eid JOIN w2 b ON b.eid = t.cid AND b.key = a.key GROUP BY ALL),
    scored AS (SELECT eid, cid, country, ps, psn, round(coalesce(d / nullif(n1 * n2, 0), 0), 6) AS bscore, round(coalesce(dn / nullif(n1 * n2, 0), 0), 6) AS bscore_name,
      round(coalesce(dh / nullif(n1 * n2, 0), 0), 6) AS bscore_num FROM top LEFT JOIN dots USING (eid, cid) LEFT JOIN n1 USING (eid) LEFT JOIN n2 USING (cid))"""


def _ranked(of: str) -> str:
    return f"""ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY eid ORDER BY bscore DESC, cid) AS INTEGER) AS rank_s1, CAST(row_number() OVER (PARTITION BY cid ORDER BY bscore DESC, eid) AS INTEGER) AS rank_c,
      CAST(row_number() OVER (PARTITION BY eid ORDER BY ps DESC, cid) AS INTEGER) AS prank_s1, max(bscore) OVER (PARTITION BY eid) AS best_s1, max(bscore) OVER (PARTITION BY cid) AS best_c,
      coalesce(nth_value(bscore, 2) OVER (PARTITION BY eid ORDER BY bscore DESC, cid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS second_s1,
      coalesce(nth_value(bscore, 2) OVER (PARTITION BY cid ORDER BY bscore DESC, eid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS second_c,
      count(*) OVER (PARTITION BY eid) AS n_c_for_s1, count(*) OVER (PARTITION BY cid) AS n_s1_for_c FROM {of})"""


_PAIRS = "p AS (SELECT eid, cid, " + ", ".join(f"round(coalesce(max(CASE WHEN isnan({c}) THEN NULL ELSE {c} END), 0.0), 6) AS {c}" for c in ("ps", "bscore", "bscore_name", "bscore_num")) + " FROM train_scored WHERE bscore IS NOT NULL AND NOT isnan(bscore) GROUP BY eid, cid)"
_KEY = "country, n_core, string_split(a_nums, ' ')[1] AS h"
_FULL = "n_core <> '' AND a_nums <> '' AND country <> ''"
_TRUTH = f"""truth AS (SELECT eid, cid FROM (SELECT {_KEY}, eid AS cid FROM r2 WHERE {_FULL}) JOIN (SELECT {_KEY}, min(eid) AS eid FROM r1 WHERE {_FULL} GROUP BY ALL) USING (country, n_core, h))"""
_RECS = f"r1 AS ({_R1}), r2 AS ({_R2})"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_RECS} SELECT 1 AS side, * FROM r1 UNION ALL SELECT 2, * FROM r2")
def er_records(spark, d):
    return one(spark, d).select(F.lit(1).alias("side"), "*").unionByName(cand(spark, d).select(F.lit(2).alias("side"), "*"))


@query(f"WITH {chain()} SELECT eid, country, kt, key FROM k1 UNION ALL SELECT eid, country, kt, key FROM k2")
def er_single_keys(spark, d):
    return B.single_keys(one(spark, d).unionByName(cand(spark, d)))


@query(f"WITH {chain()} SELECT * FROM df")
def er_doc_freq(spark, d):
    return B.document_frequency(B.single_keys(cand(spark, d)))


@query(f"WITH {chain()} SELECT eid, key, kt, df, w FROM w1")
def er_idf(spark, d):
    return block(spark, d).w1.select("eid", "key", "kt", "df", "w")


@query(f"WITH {chain()} SELECT eid, kt, key FROM c1 WHERE kt = 'x'")
def er_compound_keys(spark, d):
    return B.compound_keys(block(spark, d).w1).filter("kt = 'x'").select("eid", "kt", "key")


@query(f"WITH {chain()} SELECT eid, kt, key FROM c2 WHERE kt = 'm'")
def er_name_pairs(spark, d):
    return block(spark, d).c2.filter("kt = 'm'").select("eid", "kt", "key")


@query(f"WITH {chain()} SELECT eid, kt, key, df, w FROM probes")
def er_probe(spark, d):
    return block(spark, d).probes.select("eid", "kt", "key", "df", "w")


@query(f"WITH {chain()} SELECT eid, cid, ps, psn FROM probed")
def er_probe_pairs(spark, d):
    return block(spark, d).pairs.select("eid", "cid", "ps", "psn")


@query(f"WITH {chain()} SELECT eid, cid, ps, psn FROM top")
def er_probe_topk(spark, d):
    return block(spark, d).top.select("eid", "cid", "ps", "psn")


@query(f"WITH {chain()} SELECT eid, cid, bscore, bscore_name, bscore_num FROM scored")
def er_cosine(spark, d):
    return block(spark, d).scored.select("eid", "cid", "bscore", "bscore_name", "bscore_num")


_RANKS = "eid, cid, rank_s1, rank_c, prank_s1, best_s1, best_c, second_s1, second_c, n_c_for_s1, n_s1_for_c"


@query(f"WITH {_PAIRS}, {_ranked('p')} SELECT {_RANKS} FROM ranked")
def er_ranks(spark, d):
    return B.add_ranks(pairs(spark, d)).select(*_RANKS.split(", "))


@query(f"WITH {chain()}, {_ranked('scored')} SELECT {_RANKS} FROM ranked")
def er_blocking(spark, d):
    return block(spark, d).ranked.select(*_RANKS.split(", "))


@query(f"WITH {_PAIRS}, {_ranked('p')} SELECT eid, cid, bscore FROM ranked WHERE rank_s1 <= {V.PRUNE_RANK} AND bscore >= {V.PRUNE_SHARE} * best_s1 AND rank_c <= {V.PRUNE_MUTUAL}")
def er_prune(spark, d):
    return B.prune(B.add_ranks(pairs(spark, d))).select("eid", "cid", "bscore")


def _sql_shares(a: str, b: str) -> tuple[str, str]:
    both = f"len(list_intersect({a}, {b}))"
    return f"round(coalesce({both} / nullif(len({a}) + len({b}) - {both}, 0), 0.0), 6)", f"round(coalesce({both} / nullif(least(len({a}), len({b})), 0), 0.0), 6)"


def _side(name: str, of: str, n: int) -> str:
    t = lambda c: f"list_filter(string_split({c}, ' '), lambda x: x <> '')"
    cols = ", ".join(f"{t(c)} AS {k}{n}" for k, c in {"tn": "n_core", "tk": "n_skel", "ta": "a_words", "tu": "a_nums", "tl": "n_legal"}.items())
    return f"{name} AS (SELECT eid AS {'eid' if n == 1 else 'cid'}, {cols}, replace(n_core, ' ', '') AS cc{n}, a_norm = '' AS ae{n}, indic AS in{n} FROM {of})"


def _cheap() -> str:
    s = {k: _sql_shares(f"{t}1", f"{t}2") for k, t in (("nm", "tn"), ("sk", "tk"), ("aw", "ta"), ("num", "tu"))}
    f = {f"{k}_{m}": v for k, x in s.items() for m, v in zip(("jacc", "ovl"), x)}
    f |= {
        "rel_s1": "round(coalesce(bscore / nullif(best_s1, 0), 0.0), 6)", "rel_c": "round(coalesce(bscore / nullif(best_c, 0), 0.0), 6)",
        "margin_c": "round(bscore - CASE WHEN rank_c = 1 THEN second_c ELSE best_c END, 6)", "margin_s1": "round(bscore - CASE WHEN rank_s1 = 1 THEN second_s1 ELSE best_s1 END, 6)",
        "is_s3": "CAST(cid >= 200000000 AS INTEGER)", "hn_eq": "CAST(coalesce(tu1[1] = tu2[1], false) AS INTEGER)", "concat_eq": "CAST(cc1 = cc2 AND cc1 <> '' AS INTEGER)",
        "legal_eq": "CAST(list_sort(tl1) = list_sort(tl2) AS INTEGER)", "legal_conflict": "CAST(len(tl1) > 0 AND len(tl2) > 0 AND len(list_intersect(tl1, tl2)) = 0 AS INTEGER)",
        "addr_empty2": "CAST(ae2 AS INTEGER)", "indic2": "CAST(in2 AS INTEGER)",
    } | {f"{a}{n}": f"CAST(len({t}{n}) AS INTEGER)" for a, t in (("n_tok", "tn"), ("n_aw", "ta"), ("n_num", "tu")) for n in (1, 2)}
    return ", ".join(f"{f[c]} AS {c}" if c in f else c for c in FEATURES)


@query(f"WITH {_RECS}, {_PAIRS}, {_ranked('p')}, {_side('s1', 'r1', 1)}, {_side('s2', 'r2', 2)} SELECT eid, cid, {_cheap()} FROM ranked JOIN s1 USING (eid) JOIN s2 USING (cid)")
def er_cheap_features(spark, d):
    return cheap_features(B.add_ranks(pairs(spark, d)), one(spark, d), cand(spark, d))


@query(f"WITH {_RECS}, {_PAIRS}, {_side('s1', 'r1', 1)}, {_side('s2', 'r2', 2)} SELECT eid, cid, {_sql_shares('tn1', 'tn2')[0]} AS jacc, {_sql_shares('tn1', 'tn2')[1]} AS ovl FROM p JOIN s1 USING (eid) JOIN s2 USING (cid)")
def er_jaccard_overlap(spark, d):
    a = one(spark, d).select("eid", B.tokens("n_core").alias("t1"))
    b = cand(spark, d).select(F.col("eid").alias("cid"), B.tokens("n_core").alias("t2"))
    j, o = shares("t1", "t2")
    return pairs(spark, d).select("eid", "cid").join(a, "eid").join(b, "cid").select("eid", "cid", j.alias("jacc"), o.alias("ovl"))


_CX = """cx AS (SELECT eid, cid, bscore, CAST(row_number() OVER e AS INTEGER) AS cx_rank_s1, round(bscore - max(bscore) OVER (PARTITION BY eid), 6) AS cx_gap_s1, count(*) OVER (PARTITION BY eid) AS cx_n_s1,
  round(sum(bscore) OVER (PARTITION BY eid), 6) AS cx_sum_s1, CAST(row_number() OVER c AS INTEGER) AS cx_rank_c,
  round(bscore - CASE WHEN count(*) OVER (PARTITION BY cid) > 1 THEN list_sort(list(bscore) OVER (PARTITION BY cid), 'DESC')[2] ELSE 0.0 END, 6) AS cx_gap_rival_c,
  round(bscore - max(bscore) OVER (PARTITION BY cid), 6) AS cx_gap_best_c, count(*) OVER (PARTITION BY cid) AS cx_n_c
  FROM sv WINDOW e AS (PARTITION BY eid ORDER BY bscore DESC, cid), c AS (PARTITION BY cid ORDER BY bscore DESC, eid))"""
_SV = f"sv AS (SELECT eid, cid, bscore FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY bscore DESC, cid) AS rk FROM p WHERE bscore >= {V.STAGE_TWO_LEAST}) WHERE rk <= {V.STAGE_TWO_TOP})"


@query(f"WITH {_PAIRS}, {_SV} SELECT * FROM sv")
def er_stage_two(spark, d):
    return context.survivors(pairs(spark, d), "bscore").select("eid", "cid", "bscore")


@query(f"WITH {_PAIRS}, {_SV}, {_CX} SELECT * FROM cx")
def er_context(spark, d):
    return context.context(context.survivors(pairs(spark, d), "bscore").select("eid", "cid", "bscore"), "bscore")


def _decided(least: float, name: str = "decided", of: str = "p") -> str:
    return f"{name} AS (SELECT eid, cid, bscore FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY bscore DESC, eid) AS rk FROM {of}) WHERE rk = 1 AND bscore >= {least})"


LEAST = 0.5


def decided(spark, d):
    return context.decide(pairs(spark, d), "bscore", LEAST).select("eid", "cid", "bscore")


@query(f"WITH {_PAIRS}, {_decided(LEAST)} SELECT * FROM decided")
def er_decide(spark, d):
    return decided(spark, d)


@query(f"WITH {_RECS}, {_TRUTH} SELECT * FROM truth")
def er_truth(spark, d):
    return truth(spark, d)


_COUNTS = """counts AS (SELECT i.eid, coalesce(t.nt, 0) AS nt, coalesce(q.np, 0) AS np, coalesce(b.tp, 0) AS tp FROM (SELECT eid FROM r1) i LEFT JOIN (SELECT eid, count(*) AS nt FROM truth GROUP BY eid) t USING (eid)
  LEFT JOIN (SELECT eid, count(*) AS np FROM decided GROUP BY eid) q USING (eid) LEFT JOIN (SELECT eid, count(*) AS tp FROM decided JOIN truth USING (eid, cid) GROUP BY eid) b USING (eid))"""
_F = "CASE WHEN nt = 0 AND np = 0 THEN 1.0 ELSE 1.25 * tp / (0.25 * nt + np) END"


@query(f"WITH {_RECS}, {_PAIRS}, {_TRUTH}, {_decided(LEAST)}, {_COUNTS} SELECT round(avg(CAST({_F} AS DOUBLE)), 6) AS f05, count(*) AS records FROM counts")
def er_f05(spark, d):
    return context.macro_f_half(decided(spark, d), truth(spark, d), one(spark, d))


_GRID = "grid AS (SELECT unnest([CAST(round({low} + 0.025 * i, 6) AS DOUBLE) FOR i IN range({n})]) AS thr)"


def _sweep(low: float, n: int) -> str:
    return f"""WITH {_RECS}, {_PAIRS}, {_TRUTH}, {_decided(-1)}, {_GRID.format(low=low, n=n)}, np AS (SELECT thr, eid, count(*) AS np, count(t.cid) AS tp FROM grid JOIN decided ON bscore >= thr LEFT JOIN truth t USING (eid, cid) GROUP BY thr, eid),
  nt AS (SELECT eid, count(*) AS nt FROM truth GROUP BY eid), alls AS (SELECT thr, eid, coalesce(nt, 0) AS nt FROM grid, r1 LEFT JOIN nt USING (eid))
  SELECT thr, round(avg(CASE WHEN nt = 0 AND np IS NULL THEN 1.0 ELSE 1.25 * coalesce(tp, 0) / (0.25 * nt + coalesce(np, 0)) END), 6) AS f05 FROM alls LEFT JOIN np USING (thr, eid) GROUP BY thr"""


@query(_sweep(0.2, 28))
def er_threshold_sweep(spark, d):
    """The grid of the first pass: 28 thresholds, 0.9 is none of them."""
    return context.threshold_sweep(pairs(spark, d), "bscore", truth(spark, d), one(spark, d), 0.2, 0.9, 0.025)


@query(_sweep(0.3, 26))
def er_threshold_sweep_later(spark, d):
    """The grid of the second pass."""
    return context.threshold_sweep(pairs(spark, d), "bscore", truth(spark, d), one(spark, d), 0.3, 0.95, 0.025)


@query(f"""WITH {_RECS}, {_PAIRS}, {_TRUTH}, t AS (SELECT eid, cid, bscore, row_number() OVER (PARTITION BY eid ORDER BY bscore DESC, cid) AS rk FROM p), pos AS (SELECT rk, bscore FROM t JOIN truth USING (eid, cid)),
  pp AS (SELECT list(bscore ORDER BY bscore) AS v FROM pos WHERE rk <= {V.STAGE_TWO_TOP}), k AS (SELECT CAST(floor(0.005 * count(*) + 1e-9) AS BIGINT) - (count(*) - count(*) FILTER (rk <= {V.STAGE_TWO_TOP})) AS k FROM pos)
  SELECT CASE WHEN k > 0 THEN v[k + 1] ELSE v[1] END AS thr FROM pp, k""")
def er_recall_threshold(spark, d):
    return context.recall_threshold(pairs(spark, d), "bscore", truth(spark, d))


_M = f"""(SELECT count(*) FROM decided JOIN truth USING (eid, cid)) / (SELECT count(*) FROM decided) AS precision, (SELECT count(*) FROM decided JOIN truth USING (eid, cid)) / (SELECT count(*) FROM truth WHERE eid IN (SELECT eid FROM r1)) AS recall"""


@query(f"""WITH {_RECS}, {_PAIRS}, {_TRUTH}, {_decided(LEAST)}, {_COUNTS}, hit AS (SELECT eid, count(*) AS tp FROM p JOIN truth USING (eid, cid) GROUP BY eid)
  SELECT CAST(round({_M.split(" AS precision")[0]}, 6) AS DOUBLE) AS precision, CAST(round(sum(tp) / sum(nt), 6) AS DOUBLE) AS recall,
  CAST(round((SELECT sum(tp) FROM hit) / sum(nt), 6) AS DOUBLE) AS candidate_recall, CAST(round((SELECT count(*) FROM p) / count(*), 6) AS DOUBLE) AS candidates_per_record,
  CAST(round((SELECT avg(CASE WHEN c.nt = 0 THEN 1.0 ELSE 1.25 * coalesce(h.tp, 0) / (0.25 * c.nt + coalesce(h.tp, 0)) END) FROM counts c LEFT JOIN hit h USING (eid)), 6) AS DOUBLE) AS perfect_f05,
  CAST(round(avg(CAST({_F} AS DOUBLE)), 6) AS DOUBLE) AS f05 FROM counts""")
def er_metrics(spark, d):
    m = context.metrics(decided(spark, d), pairs(spark, d), truth(spark, d), one(spark, d))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


# Collective pass, with bscore in the place of the model's probability.
SURE = 0.7


def _sure(spark, d):
    return collective.confident(pairs(spark, d), "bscore", SURE)


_SURE = f"{_decided(SURE, 'sure0')}, sure AS (SELECT eid, cid AS sib, bscore AS p FROM sure0)"


@query(f"WITH {_PAIRS}, {_SURE} SELECT * FROM sure")
def er_confident(spark, d):
    return _sure(spark, d)


_PROBE = f"WITH {_PAIRS}, {_SURE}, {chain(f'SELECT * FROM ({_R2}) WHERE eid IN (SELECT sib FROM sure)', _R2, V.SIBLING_PROBE)}, sibs AS (SELECT eid AS sib, cid, ps AS sps, bscore AS scos FROM scored)"


@query(f"{_PROBE} SELECT * FROM sibs")
def er_siblings(spark, d):
    return collective.sibling_probe(_sure(spark, d), cand(spark, d))


_EV = """ev AS (SELECT eid, cid, max(scos) AS sib_bscore, max(sps) AS sib_ps, count(*) AS sib_hits, first(sib ORDER BY scos DESC, sib) AS best_sib FROM sure JOIN sibs USING (sib) GROUP BY eid, cid)"""
# The scores of the first pass have no model here: p2 is ps, p3 is bscore.
_UNI = f"""{_ranked('p')}, ev2 AS (SELECT ev.* FROM ev ANTI JOIN sure ON ev.eid = sure.eid AND ev.cid = sure.sib), op AS (SELECT eid, cid, ps AS p2, bscore AS p3 FROM p),
  fresh AS (SELECT eid, cid FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY sib_bscore DESC, cid) AS rk FROM ev2 ANTI JOIN op USING (eid, cid)) WHERE rk <= {V.SIBLING_TOP}),
  uni AS (SELECT k.eid, k.cid, p2, p3, sib_bscore, sib_ps, sib_hits, best_sib, {", ".join("ranked." + c for c in collective.SCORES)}
    FROM (SELECT eid, cid FROM op UNION ALL FROM fresh) k LEFT JOIN op USING (eid, cid) LEFT JOIN ev2 USING (eid, cid) LEFT JOIN ranked USING (eid, cid))"""
_BASE = f"{_PROBE}, {_EV}, {_UNI}"


def _evidence(spark, d, sure):
    return collective.evidence(sure, collective.sibling_probe(sure, cand(spark, d)))


def _universe(spark, d):
    p, sure = pairs(spark, d), _sure(spark, d)
    return collective.universe(p.select("eid", "cid", F.col("ps").alias("p2"), F.col("bscore").alias("p3")), _evidence(spark, d, sure), sure, B.add_ranks(p))


@query(f"{_PROBE}, {_EV} SELECT * FROM ev")
def er_evidence(spark, d):
    return _evidence(spark, d, _sure(spark, d))


@query(f"{_BASE} SELECT * FROM uni")
def er_universe(spark, d):
    return _universe(spark, d)


@query(f"""{_BASE}, n AS (SELECT eid, count(*) AS n_conf, count(*) FILTER (sib >= {V.THIRD_SOURCE}) AS n_conf_s3 FROM sure GROUP BY eid), own AS (SELECT sib AS cid, eid AS owner, p AS op FROM sure)
  SELECT uni.* REPLACE (coalesce(sib_hits, 0) AS sib_hits), CAST(p3 IS NULL AS INTEGER) AS is_new, count(*) OVER (PARTITION BY eid) AS u_n_s1, count(*) OVER (PARTITION BY cid) AS u_n_c,
  round(max(coalesce(p3, 0.0)) OVER (PARTITION BY cid) - coalesce(p3, 0.0), 6) AS c_best_other_gap, round(max(coalesce(p3, 0.0)) OVER (PARTITION BY cid), 6) AS c_best_p3,
  coalesce(n_conf, 0) AS n_conf, coalesce(n_conf_s3, 0) AS n_conf_s3, CAST(cid >= {V.THIRD_SOURCE} AS INTEGER) AS is_s3,
  CASE WHEN cid >= {V.THIRD_SOURCE} THEN coalesce(n_conf_s3, 0) ELSE coalesce(n_conf, 0) - coalesce(n_conf_s3, 0) END AS n_conf_same_src, CASE WHEN owner <> eid THEN op END AS other_conf_p3
  FROM uni LEFT JOIN n USING (eid) LEFT JOIN own USING (cid)""")
def er_competition(spark, d):
    return collective.competition(_universe(spark, d), _sure(spark, d), "p3")


@query(f"{_BASE} SELECT eid, cid, p3, sib_bscore FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY sib_bscore DESC NULLS LAST, cid) AS rk FROM uni) WHERE p3 IS NOT NULL OR (rk <= {V.SIBLING_TOP_LATER} AND sib_bscore >= {V.SIBLING_LEAST})")
def er_narrow(spark, d):
    return collective.narrow(_universe(spark, d), "p3").select("eid", "cid", "p3", "sib_bscore")


LOW, HIGH = 0.3, 0.6  # bounds that fit a cosine


@query(f"""WITH {_PAIRS}, q AS (SELECT *, bool_or(bscore > {LOW} AND bscore < {HIGH}) OVER (PARTITION BY eid) AS mid, row_number() OVER (PARTITION BY cid ORDER BY bscore DESC, eid) AS rk FROM p)
  SELECT eid, cid, y FROM (SELECT eid, cid, CASE WHEN bscore >= {HIGH} AND rk = 1 THEN 1 WHEN bscore <= {LOW} THEN 0 END AS y FROM q WHERE NOT mid) WHERE y IS NOT NULL""")
def er_pseudo_labels(spark, d):
    return collective.pseudo_labels(pairs(spark, d), "bscore", LOW, HIGH)


_KNOWN = "known AS (SELECT DISTINCT country FROM r2 WHERE indic)"


@query(f"WITH {_RECS}, {_KNOWN}, t AS ({_REC} test_s2) SELECT eid, country FROM t WHERE country NOT IN (FROM known)")
def er_unseen_country(spark, d):
    """Records of countries that no candidate with Indic script is from."""
    test = clean(table(spark, d, "test_s2").select(*COLS))
    return collective.unseen(test, cand(spark, d).filter("indic")).select("eid", "country")


_LISTS = "lists AS (SELECT i.eid, coalesce(l.v, '') AS matched_entity_ids FROM (SELECT eid FROM r1) i LEFT JOIN (SELECT eid, string_agg(CAST(cid AS VARCHAR), ',' ORDER BY CAST(cid AS VARCHAR)) AS v FROM decided GROUP BY eid) l USING (eid))"


@query(f"WITH {_RECS}, {_PAIRS}, {_decided(LEAST)}, {_LISTS} SELECT * FROM lists")
def er_match_lists(spark, d):
    return match_lists(one(spark, d), decided(spark, d))


@query(f"WITH {_RECS}, {_PAIRS}, {_SV}, c AS (SELECT eid, string_agg(CAST(cid AS VARCHAR), ',' ORDER BY CAST(cid AS VARCHAR)) AS v FROM sv GROUP BY eid) SELECT r1.eid, coalesce(v, '') AS candidate_entity_ids FROM r1 LEFT JOIN c USING (eid)")
def er_candidate_lists(spark, d):
    return match_lists(one(spark, d), context.survivors(pairs(spark, d), "bscore"), name="candidate_entity_ids")


@query(f"""WITH {_RECS}, {_PAIRS}, {_decided(LEAST)}, {_LISTS}, {_decided(0.7, 'strict')}, s AS (SELECT eid, string_agg(CAST(cid AS VARCHAR), ',' ORDER BY CAST(cid AS VARCHAR)) AS v FROM strict GROUP BY eid)
  , {_KNOWN} SELECT eid, CASE WHEN country NOT IN (FROM known) THEN coalesce(s.v, '') ELSE matched_entity_ids END AS matched_entity_ids FROM lists JOIN r1 USING (eid) LEFT JOIN s USING (eid)""")
def er_rewrite_rows(spark, d):
    ids = one(spark, d)
    old = match_lists(ids, decided(spark, d))
    new = match_lists(ids, context.decide(pairs(spark, d), "bscore", 0.7))
    return collective.rewrite(old, new, collective.unseen(ids, cand(spark, d).filter("indic")), "eid", "matched_entity_ids")


_H = lambda seed, x: f"CAST('0x' || substr(md5('{seed}:' || {x}), 1, 8) AS BIGINT)"


@query(f"WITH {_RECS} SELECT eid, CASE WHEN {_H(7, 'CAST(eid AS VARCHAR)')} % 10 < 2 THEN 'A' WHEN {_H(7, 'CAST(eid AS VARCHAR)')} % 10 < 7 THEN 'B' ELSE 'C' END AS fold FROM r1")
def er_folds(spark, d):
    return one(spark, d).select("eid", labels.fold_of(F.col("eid")).alias("fold"))


_INNER = {"inner_a": labels.INNER_A, "inner_b": labels.INNER_B, "split_c": labels.SPLIT_C, "inner_c": labels.INNER_C}


@query(f"WITH {_RECS} SELECT eid, " + ", ".join(f"{_H(seed, 'CAST(eid AS VARCHAR)')} % {n} AS {c}" for c, (seed, n) in _INNER.items()) + " FROM r1")
def er_inner_folds(spark, d):
    return one(spark, d).select("eid", *[labels.part_of(F.col("eid"), *x).alias(c) for c, x in _INNER.items()])


@query(f"WITH {_RECS}, {_PAIRS}, {_TRUTH}, l AS (SELECT p.eid, p.cid, CAST(t.cid IS NOT NULL AS INTEGER) AS y FROM p LEFT JOIN truth t ON t.eid = p.eid AND t.cid = p.cid) SELECT * FROM l WHERE y = 1 OR {_H(99, '(CAST(eid AS VARCHAR) || chr(124) || CAST(cid AS VARCHAR))')} % 100 < 35")
def er_negative_sample(spark, d):
    t = truth(spark, d).withColumn("y", F.lit(1))
    return labels.negative_sample(pairs(spark, d).select("eid", "cid").join(t, ["eid", "cid"], "left").fillna(0, ["y"]), "y")


_PRIOR = sorted(V.LEGAL) + [w for x in V.NAME_WORDS.values() for w in x.split()]
_PRIOR_SQL = ", ".join(f"('{w}')" for w in _PRIOR)


@query(f"""WITH r AS ({_R1} UNION {_REC} test_s2), w AS (SELECT unnest(string_split(n_norm, ' ')) AS word FROM r), n AS (SELECT word, sum(n) AS n FROM (SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{{2,}}') GROUP BY word
  UNION ALL SELECT word, 50 * count(*) FROM (VALUES {_PRIOR_SQL}) v(word) GROUP BY word) GROUP BY word HAVING sum(n) >= 3) SELECT word, CAST(n AS BIGINT) AS n, round(-ln(n / (SELECT sum(n) FROM n)), 3) AS cost FROM n""")
def er_vocab_cost(spark, d):
    rec = one(spark, d).unionByName(clean(table(spark, d, "test_s2").select(*COLS))).distinct()
    return dictionary.word_costs(rec, "n_norm", _PRIOR)


@query(f"WITH r AS ({_R1} UNION ALL {_R2}), w AS (SELECT country, unnest(list_distinct(string_split(a_words, ' '))) AS word FROM r), n AS (SELECT country, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL) SELECT country, word, n FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, word) AS rk FROM n) WHERE rk <= 400")
def er_addr_common(spark, d):
    return dictionary.common_words(one(spark, d).unionByName(cand(spark, d)), "a_words")


_BOTH = "list_filter(string_split({s}.n_norm || ' ' || {s}.a_norm, ' '), lambda x: x <> '')"


@query(f"""WITH {_RECS}, {_TRUTH}, l AS (SELECT {_BOTH.format(s="b")} AS ts, {_BOTH.format(s="a")} AS us FROM truth JOIN r1 a USING (eid) JOIN r2 b ON b.eid = cid), v AS (SELECT unnest(ts) AS t, unnest(us) AS u FROM l WHERE len(ts) = len(us)),
  c AS (SELECT t, u, count(*) AS n FROM v GROUP BY ALL) SELECT t, u, n FROM (SELECT *, sum(n) OVER (PARTITION BY t) AS alls, row_number() OVER (PARTITION BY t ORDER BY n DESC, u) AS rk FROM c) WHERE rk = 1 AND n >= 3 AND n >= 0.6 * alls AND t <> u AND u <> '<none>'""")
def er_word_votes(spark, d):
    """Votes of the words in the same place of two matched records with as many words."""

    def words(rec, id_col, name):
        return rec.select(F.col("eid").alias(id_col), F.filter(F.split(F.concat("n_norm", F.lit(" "), "a_norm"), " "), lambda t: t != "").alias(name))

    both = truth(spark, d).join(words(one(spark, d), "eid", "us"), "eid").join(words(cand(spark, d), "cid", "ts"), "cid").filter("size(us) = size(ts)")
    return dictionary.majority_votes(both.select(F.explode(F.arrays_zip("ts", "us")).alias("z")).select(F.col("z.ts").alias("t"), F.col("z.us").alias("u")))
