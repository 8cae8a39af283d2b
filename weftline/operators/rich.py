"""Rich features of record pairs: 58 string comparisons that have no native counterpart, one Arrow pass over the pairs.

What depends on the corpus is joined to the records first (word costs per core token, address words without the country's
common ones), so the Python side needs no dictionary and nothing that grows is sent to all tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import batch as B
from weftline.functions import fixed as V
from weftline.functions import similarity as S
from weftline.functions.text import skeleton
from weftline.operators.blocking import tokens

FEATURES = (
    "nm_ratio nm_tsort nm_tset nm_partial core_ratio core_tsort core_tset core_partial core_jw core_lev concat_ratio concat_eq concat_partial core_jacc core_ovl skel_jacc skel_ovl "
    "first_tok_eq first_tok_jw tok_cover1 tok_cover2 n_core1 n_core2 len_core1 len_core2 legal1 legal2 legal_eq legal_conflict ad_ratio ad_tset ad_tsort ad_partial adw_tset adw_jacc adw_ovl "
    "num_jacc num_ovl num_any hn_eq zip_eq zip_conflict n_nums1 n_nums2 addr_empty2 addr_len1 addr_len2 indic2 uniq_idf1 uniq_idf2 uniq_idf_max acro_12 acro_21 hn_absdiff hn_near street_tset street_jacc legal_ext_conflict"
).split()
SIDE = ["n_norm", "n_core", "n_legal", "a_norm", "a_words", "a_nums", "indic", "street", "costs"]
NO_COST = 20.0


def with_costs(rec: DataFrame, costs: DataFrame, none: float = NO_COST) -> DataFrame:
    """rec with costs: the cost of each core token in order; words without one get the given cost."""
    pos = rec.select("eid", F.posexplode(tokens("n_core")).alias("pos", "word")).join(costs.select("word", "cost"), "word", "left")
    lists = pos.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("cost", F.lit(none)).alias("cost")))), lambda x: x["cost"]).alias("costs"))
    return rec.join(lists, "eid", "left").withColumn("costs", F.coalesce("costs", F.array().cast("array<double>")))


def with_street(rec: DataFrame, common: DataFrame) -> DataFrame:
    """rec with street: its address words without the common ones of its country."""
    pos = rec.select("eid", "country", F.posexplode(tokens("a_words")).alias("pos", "word")).join(common.select("country", "word"), ["country", "word"], "left_anti")
    words = pos.groupBy("eid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("street"))
    return rec.join(words, "eid", "left").withColumn("street", F.coalesce("street", F.lit("")))


def acronym(of: list[str], toks: list[str]) -> bool:
    """Whether the initials of the first name stand in the second as a token or as all of it."""
    short = "".join(t[0] for t in of)
    return len(of) >= 2 and (short in toks or short == "".join(toks))


def features(sides: list[list]) -> dict[str, list | np.ndarray]:
    """The values of FEATURES for many pairs: SIDE of all first records, then SIDE of all second ones. Similarities of whole
    texts are taken for all pairs at once, what needs only sets of tokens pair by pair."""
    n1, c1, _, d1, w1, _, _, s1, _, n2, c2, _, d2, w2, _, indic2, s2, _ = sides
    split = {c: c.split() for s in (c1, c2) for c in set(s)}
    bones = {t: skeleton(t) for t in {t for toks in split.values() for t in toks}}
    g1, g2 = (["".join(split[c]) for c in s] for s in (c1, c2))
    pairs1 = [(split[a], split[b]) for a, b in zip(c1, c2)]
    cover1, cover2 = B.covered(pairs1), B.covered([(b, a) for a, b in pairs1])
    rest = [_tokens(*p, bones, x, y) for *p, x, y in zip(*sides, cover1, cover2)]
    out = dict(zip(_TOKENS, zip(*rest))) if rest else dict.fromkeys(_TOKENS, ())
    for k, x, y in (("nm", n1, n2), ("core", c1, c2), ("ad", d1, d2)):
        out[f"{k}_ratio"], out[f"{k}_partial"] = B.ratios_and_partial(x, y)
        out[f"{k}_tsort"], out[f"{k}_tset"] = B.token_sort_ratios(x, y), B.token_set_ratios(x, y)
    out["ad_partial"] = np.where([bool(x and y) for x, y in zip(d1, d2)], out["ad_partial"], 0.0)
    out["concat_ratio"], out["concat_partial"] = B.ratios_and_partial(g1, g2)
    out["concat_eq"] = [x == y != "" for x, y in zip(g1, g2)]
    out["core_jw"], out["core_lev"] = B.jaro_winklers(c1, c2), B.levenshteins(c1, c2)
    out["first_tok_jw"] = B.jaro_winklers(*([(p[i] or [""])[0] for p in pairs1] for i in (0, 1)))
    out["adw_tset"] = B.token_set_ratios(w1, w2)
    out["street_tset"] = np.where([bool(x and y) for x, y in zip(s1, s2)], B.token_set_ratios(s1, s2), -1.0)
    out["tok_cover1"], out["tok_cover2"] = [x for x, _ in cover1], [x for x, _ in cover2]
    out["len_core1"], out["len_core2"], out["addr_len1"], out["addr_len2"] = (list(map(len, s)) for s in (g1, g2, d1, d2))
    out["addr_empty2"], out["indic2"] = [x == "" for x in d2], list(map(bool, indic2))
    return {f: out[f] for f in FEATURES}


_TOKENS = (
    "core_jacc core_ovl skel_jacc skel_ovl first_tok_eq n_core1 n_core2 legal1 legal2 legal_eq legal_conflict adw_jacc adw_ovl num_jacc num_ovl num_any hn_eq zip_eq zip_conflict n_nums1 n_nums2 "
    "uniq_idf1 uniq_idf2 uniq_idf_max acro_12 acro_21 hn_absdiff hn_near street_jacc legal_ext_conflict"
).split()


def _tokens(n1, c1, lg1, d1, w1, nums1, i1, s1, costs1, n2, c2, lg2, d2, w2, nums2, i2, s2, costs2, bones, cover1, cover2) -> tuple[float, ...]:
    """The values of _TOKENS for two records."""
    t1, t2, u1, u2 = c1.split(), c2.split(), nums1.split(), nums2.split()
    l1, l2 = set(lg1.split()), set(lg2.split())
    e1, e2 = (lg | (V.MORE_LEGAL & set(n.split())) for lg, n in ((l1, n1), (l2, n2)))
    z1, z2 = ({x for x in u if len(x) >= 5} for u in (u1, u2))
    cost1, cost2 = dict(zip(t1, costs1)), dict(zip(t2, costs2))
    rare1, rare2 = [cost1.get(t, NO_COST) for t in cover1[1]], [cost2.get(t, NO_COST) for t in cover2[1]]
    num = S.jaccard_and_overlap(u1, u2)
    gap = abs(int(u1[0]) - int(u2[0])) if u1 and u2 else None
    return (
        *S.jaccard_and_overlap(t1, t2), *S.jaccard_and_overlap([bones[t] for t in t1], [bones[t] for t in t2]), bool(t1 and t2 and t1[0] == t2[0]),
        len(t1), len(t2), bool(l1), bool(l2), l1 == l2, bool(l1 and l2 and not l1 & l2), *S.jaccard_and_overlap(w1.split(), w2.split()),
        *num, num[0] > 0, bool(u1 and u2 and u1[0] == u2[0]), bool(z1 & z2), bool(z1 and z2 and not z1 & z2), len(u1), len(u2),
        sum(rare1), sum(rare2), max(rare1 + rare2, default=0.0), acronym(t2, t1), acronym(t1, t2),
        -1.0 if gap is None else math.log1p(gap), gap is not None and 0 < gap <= 10,
        S.jaccard_and_overlap(s1.split(), s2.split())[0] if s1 and s2 else -1.0, bool(e1 and e2 and not e1 & e2),
    )


def pair_features(a: dict, b: dict) -> tuple[float, ...]:
    """The values of FEATURES for two records."""
    return tuple(v[0] for v in features([[r[c]] for r in (a, b) for c in SIDE]).values())


def _compute(extra: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features([c.to_pylist() for c in batch.columns[extra:]])
            out = [pa.array(np.asarray(v, np.float64)) for v in found.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:extra], *out], names=[*batch.schema.names[:extra], *FEATURES])

    return walk


def rich_features(pairs: DataFrame, one: DataFrame, cand: DataFrame, prefix: str = "") -> DataFrame:
    """(eid, cid, FEATURES): both sides need the columns of SIDE (see with_costs and with_street).

    The number of tasks is set here, since pairs are small in bytes and would be merged into few tasks by size."""
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    a = one.select("eid", *[F.col(c).alias(f"{c}_1") for c in SIDE])
    b = cand.select(F.col("eid").alias("cid"), *[F.col(c).alias(f"{c}_2") for c in SIDE])
    rows = pairs.select("eid", "cid").join(a, "eid").repartition(tasks, "cid").join(b, "cid").select("eid", "cid", *[f"{c}_1" for c in SIDE], *[f"{c}_2" for c in SIDE])
    out = rows.mapInArrow(_compute(2), "eid long, cid long, " + ", ".join(f"{f} double" for f in FEATURES))
    return out.select("eid", "cid", *[F.col(f).alias(prefix + f) for f in FEATURES]) if prefix else out
