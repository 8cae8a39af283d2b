"""Queries of text normalisation, similarities, learned dictionaries, models and the record stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import fixed as V
from weftline.functions import native, udfs
from weftline.operators import context, dictionary, passes, rich
from weftline.operators.blocking import tokens
from weftline.plans import linkage as L
from weftline.sources.files import match_lists
from weftline.sources.tables import RECORDS
from weftline.streaming import records as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT DISTINCT eid, coalesce(n_skel, '') AS n_skel FROM (FROM train_s1 UNION ALL FROM train_s2 UNION ALL FROM train_s3)")
def er_skeleton(spark, d):
    rec = L.one(spark, d).unionByName(L.cand(spark, d))
    toks = F.transform(F.filter(tokens("n_core"), lambda t: F.length(t) >= 3), native.skeleton)
    return rec.select("eid", F.array_join(F.filter(toks, lambda t: t != ""), " ").alias("n_skel"))


_TOKS = "toks AS (SELECT DISTINCT unnest(string_split(coalesce(n_core, '') || ' ' || coalesce(a_norm, ''), ' ')) AS tok FROM (FROM train_s2 UNION ALL FROM train_s3))"


def _toks(spark, d):
    return L.cand(spark, d).select(F.explode(F.split(F.concat_ws(" ", "n_core", "a_norm"), " ")).alias("tok")).filter("tok <> ''").distinct()


@query(f"""WITH {_TOKS} SELECT tok, CASE WHEN regexp_full_match(tok, '[a-z]+') OR regexp_matches(tok, '{V.ORDINAL}') OR length(regexp_replace(tok, '[^a-z]', '', 'g')) = 0 OR 2 * length(regexp_replace(tok, '[^a-z]', '', 'g')) < length(tok)
  THEN tok ELSE translate(tok, '{V.LOOKALIKE_FROM}', '{V.LOOKALIKE_TO}') END AS fixed FROM toks WHERE tok <> ''""")
def er_homoglyph(spark, d):
    return _toks(spark, d).select("tok", native.undo_lookalikes(F.col("tok")).alias("fixed"))


@query("SELECT DISTINCT eid, replace(coalesce(n_core, ''), ' ', '') AS label FROM train_s1 WHERE n_core <> ''")
def er_domain(spark, d):
    glued = F.replace("n_core", F.lit(" "), F.lit(""))
    url = F.concat(F.when(F.col("eid") % 2 == 0, "https://www.").otherwise(""), glued, F.when(F.col("eid") % 3 == 0, ".co.in trading").otherwise(".com"))
    return L.one(spark, d).filter("n_core <> ''").select("eid", native.domain_label(url).alias("label"))


@query("SELECT DISTINCT eid, coalesce(a_nums, '') AS a_nums FROM (FROM train_s1 UNION ALL FROM train_s2 UNION ALL FROM train_s3)")
def er_addr_numbers(spark, d):
    return L.one(spark, d).unionByName(L.cand(spark, d)).select("eid", native.address_numbers(F.col("a_norm")).alias("a_nums"))


@query("SELECT DISTINCT eid, coalesce(a_words, '') AS a_words FROM (FROM train_s1 UNION ALL FROM train_s2 UNION ALL FROM train_s3)")
def er_addr_words(spark, d):
    words = F.filter(tokens("a_norm"), lambda t: ~t.rlike("^[0-9]+$"))
    return L.one(spark, d).unionByName(L.cand(spark, d)).select("eid", F.array_join(words, " ").alias("a_words"))


def _inlist(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


_SPLIT = "list_filter(string_split(n_norm, ' '), lambda x: x <> '')"


@query(f"""WITH r AS (SELECT DISTINCT eid, coalesce(n_norm, '') AS n_norm FROM (FROM train_s1 UNION ALL FROM train_s2 UNION ALL FROM train_s3))
  SELECT eid, array_to_string(list_filter({_SPLIT}, lambda x: x NOT IN ({_inlist(V.LEGAL)})), ' ') AS core, array_to_string(list_sort(list_distinct(list_filter({_SPLIT}, lambda x: x IN ({_inlist(V.LEGAL - V.NOT_A_FORM)})))), ' ') AS legal FROM r""")
def er_name_split(spark, d):
    core, legal = native.split_name(F.col("n_norm"))
    return L.one(spark, d).unionByName(L.cand(spark, d)).select("eid", core.alias("core"), legal.alias("legal"))


_STATES = [p for t in (V.US_STATES, V.IN_STATES) for p in sorted(t.items(), key=lambda p: (-len(p[0]), p[0]))]
_NAMES = [n for n, _ in _STATES]
_PLACED = f"SELECT DISTINCT eid, coalesce(a_norm, '') || ' ' || ([{', '.join(repr(n) for n in _NAMES)}])[eid % {len(_NAMES)} + 1] AS s FROM train_s1"


def _nested(expr: str) -> str:
    for name, code in _STATES:
        expr = f"regexp_replace({expr}, '\\b{name}\\b', '{code}', 'g')"
    return expr


@query(f"WITH r AS ({_PLACED}) SELECT eid, {_nested('s')} AS address FROM r")
def er_state_codes(spark, d):
    state = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("eid") % len(_NAMES) + 1).cast("int"))
    return L.one(spark, d).select("eid", native.state_codes(F.concat("a_norm", F.lit(" "), state)).alias("address"))


_LATIN, _DEVANAGARI = "kgntdpfbmrlvsj", "कगनतदपफबमरलवसज"


@query(f"""WITH t AS (SELECT DISTINCT unnest(string_split(n_skel, ' ')) AS tok FROM train_s1) SELECT tok, regexp_replace(regexp_replace(tok, '([a-z])', '\\1a', 'g'), 'a$', '') AS latin FROM t WHERE regexp_full_match(tok, '[{_LATIN}]+')""")
def er_translit(spark, d):
    toks = L.one(spark, d).select(F.explode(tokens("n_skel")).alias("tok")).filter(F.col("tok").rlike(f"^[{_LATIN}]+$")).distinct()
    return toks.select("tok", udfs.transliterate(F.translate("tok", _LATIN, _DEVANAGARI)).alias("latin"))


@query("SELECT DISTINCT eid, coalesce(n_norm, '') AS folded FROM train_s1")
def er_fold(spark, d):
    dressed = F.translate(F.upper("n_norm"), "AEIOUCN", "ÀÉÎÖÛÇÑ")
    return L.one(spark, d).select("eid", udfs.fold(dressed).alias("folded"))


@query()
def er_merge_initials(spark, d):
    apart = F.regexp_replace("n_norm", r"\b([a-z])([a-z])\b", "$1 $2")
    return L.one(spark, d).select("eid", udfs.merge_initials(apart).alias("merged"))


@query()
def er_segment(spark, d):
    """Names written as one token, split by the vocabulary of all names."""
    rec = L.one(spark, d)
    costs = dictionary.word_costs(rec, "n_core", sorted(V.LEGAL))
    glued = rec.select("eid", F.replace("n_core", F.lit(" "), F.lit("")).alias("tok"))
    found = dictionary.splits(glued.select("tok").distinct(), costs)
    return glued.join(found, "tok", "left").select("eid", F.coalesce("words", "tok").alias("words"))


@query()
def er_normalise(spark, d):
    """The whole normalisation over a raw source: names and addresses of source 1 in another dress."""
    raw = L.one(spark, d).select("entity_id", F.initcap("n_norm").alias("business_name"), F.upper("a_norm").alias("business_address"), F.concat(F.lit(" "), F.upper("country")).alias("country"))
    return udfs.normalised(raw)


@query()
def er_translit_votes(spark, d):
    """What words of Indic records mean, voted by the matched names."""
    a = L.one(spark, d).select("eid", F.col("n_norm").alias("u"))
    b = L.cand(spark, d).filter("indic").select(F.col("eid").alias("cid"), F.col("n_norm").alias("t"))
    best = context.decide(L.pairs(spark, d), "bscore", L.LEAST)
    return dictionary.majority_votes(dictionary.aligned_votes(best.join(a, "eid").join(b, "cid"), "t", "u"))


# Pair similarities on the survivors of the first stage.
def _survivors(spark, d):
    return context.survivors(L.pairs(spark, d), "bscore").select("eid", "cid")


_JOINED = f"WITH {L._RECS}, {L._PAIRS}, {L._SV}, j AS (SELECT sv.eid, sv.cid, a.country, b.country AS country2, " + ", ".join(f"{s}.{c} AS {c}_{k}" for s, k in (("a", 1), ("b", 2)) for c in ("n_norm", "n_core", "n_legal", "a_norm", "a_words", "a_nums", "indic")) + " FROM sv JOIN r1 a ON a.eid = sv.eid JOIN r2 b ON b.eid = sv.cid)"


def _names(spark, d):
    a = L.one(spark, d).select("eid", F.col("n_core").alias("n1"))
    b = L.cand(spark, d).select(F.col("eid").alias("cid"), F.col("n_core").alias("n2"))
    return _survivors(spark, d).join(a, "eid").join(b, "cid")


@query(f"{_JOINED} SELECT eid, cid, round(CASE WHEN n_core_1 = '' AND n_core_2 = '' THEN 0.0 ELSE jaro_winkler_similarity(n_core_1, n_core_2) END, 6) AS jw FROM j")
def er_jaro_winkler(spark, d):
    return _names(spark, d).select("eid", "cid", F.round(udfs.jaro_winkler("n1", "n2"), 6).alias("jw"))


@query(f"{_JOINED} SELECT eid, cid, CAST(levenshtein(n_core_1, n_core_2) AS INTEGER) AS lev FROM j")
def er_levenshtein(spark, d):
    return _names(spark, d).select("eid", "cid", F.levenshtein("n1", "n2").alias("lev"))


@query()
def er_ratios(spark, d):
    fs = {f: getattr(udfs, f)("n1", "n2") for f in ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio")}
    return _names(spark, d).select("eid", "cid", *[F.round(c, 4).alias(f) for f, c in fs.items()])


def _sides(spark, d):
    one, cand = L.one(spark, d), L.cand(spark, d)
    costs = dictionary.word_costs(one, "n_norm", L._PRIOR)
    common = dictionary.common_words(one.unionByName(cand), "a_words")
    return [rich.with_street(rich.with_costs(r, costs), common) for r in (one, cand)]


def _rich(spark, d):
    one, cand = _sides(spark, d)
    return rich.rich_features(_survivors(spark, d), one, cand)


@query()
def er_rich_features(spark, d):
    f = _rich(spark, d)
    return f.select("eid", "cid", *[F.round(c, 5).alias(c) for c in rich.FEATURES])


def _rich_sql() -> tuple[list[str], str]:
    t = lambda c, k: f"list_filter(string_split({c}_{k}, ' '), lambda x: x <> '')"
    jacc = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len(list_distinct({a})) + len(list_distinct({b})) - len(list_intersect({a}, {b}))) END"
    ovl = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / least(len(list_distinct({a})), len(list_distinct({b}))) END"
    alone = lambda a, b: f"list_filter({a}, lambda x: len(list_filter({b}, lambda y: x = y OR jaro_winkler_similarity(x, y) >= 0.9)) = 0)"
    n1, n2, w1, w2, u1, u2, l1, l2 = "n1", "n2", "w1", "w2", "u1", "u2", "l1", "l2"
    cost = lambda a: f"list_transform({a}, lambda x: coalesce(cmap[x], {rich.NO_COST}))"
    zips = lambda u: f"list_filter({u}, lambda x: length(x) >= 5)"
    acro = lambda a, b: f"(len({a}) >= 2 AND (list_contains({b}, array_to_string(list_transform({a}, lambda x: x[1]), '')) OR array_to_string(list_transform({a}, lambda x: x[1]), '') = array_to_string({b}, '')))"
    h = lambda u: f"CAST({u}[1] AS DOUBLE)"
    ext = lambda lg, k: f"list_distinct(list_concat({lg}, list_filter({t('n_norm', k)}, lambda x: x IN ({_inlist(V.MORE_LEGAL)}))))"
    f = {
        "core_jw": "CASE WHEN n_core_1 = '' AND n_core_2 = '' THEN 0.0 ELSE jaro_winkler_similarity(n_core_1, n_core_2) END", "core_lev": "levenshtein(n_core_1, n_core_2)", "concat_eq": "replace(n_core_1, ' ', '') = replace(n_core_2, ' ', '') AND n_core_1 <> ''",
        "core_jacc": jacc(n1, n2), "core_ovl": ovl(n1, n2), "first_tok_eq": "coalesce(n1[1] = n2[1], false)", "first_tok_jw": "coalesce(jaro_winkler_similarity(n1[1], n2[1]), 0.0)",
        "tok_cover1": "CASE WHEN len(n1) = 0 THEN 0.0 ELSE 1 - len(alone1) / len(n1) END", "tok_cover2": "CASE WHEN len(n2) = 0 THEN 0.0 ELSE 1 - len(alone2) / len(n2) END",
        "n_core1": "len(n1)", "n_core2": "len(n2)", "len_core1": "length(replace(n_core_1, ' ', ''))", "len_core2": "length(replace(n_core_2, ' ', ''))", "legal1": "len(l1) > 0", "legal2": "len(l2) > 0",
        "legal_eq": "list_sort(l1) = list_sort(l2)", "legal_conflict": "len(l1) > 0 AND len(l2) > 0 AND len(list_intersect(l1, l2)) = 0", "adw_jacc": jacc(w1, w2), "adw_ovl": ovl(w1, w2),
        "num_jacc": jacc(u1, u2), "num_ovl": ovl(u1, u2), "num_any": "len(list_intersect(u1, u2)) > 0", "hn_eq": "coalesce(u1[1] = u2[1], false)", "zip_eq": f"len(list_intersect({zips(u1)}, {zips(u2)})) > 0",
        "zip_conflict": f"len({zips(u1)}) > 0 AND len({zips(u2)}) > 0 AND len(list_intersect({zips(u1)}, {zips(u2)})) = 0", "n_nums1": "len(u1)", "n_nums2": "len(u2)", "addr_empty2": "a_norm_2 = ''",
        "addr_len1": "length(a_norm_1)", "addr_len2": "length(a_norm_2)", "indic2": "indic_2", "uniq_idf1": f"coalesce(list_sum({cost('alone1')}), 0.0)", "uniq_idf2": f"coalesce(list_sum({cost('alone2')}), 0.0)",
        "uniq_idf_max": f"coalesce(list_max(list_concat({cost('alone1')}, {cost('alone2')})), 0.0)", "acro_12": acro(n2, n1), "acro_21": acro(n1, n2),
        "hn_absdiff": f"CASE WHEN len(u1) = 0 OR len(u2) = 0 THEN -1.0 ELSE ln(1 + abs({h(u1)} - {h(u2)})) END", "hn_near": f"coalesce(abs({h(u1)} - {h(u2)}) > 0 AND abs({h(u1)} - {h(u2)}) <= 10, false)",
        "street_jacc": f"CASE WHEN len(s1) = 0 OR len(s2) = 0 THEN -1.0 ELSE {jacc('s1', 's2')} END", "legal_ext_conflict": f"len({ext(l1, 1)}) > 0 AND len({ext(l2, 2)}) > 0 AND len(list_intersect({ext(l1, 1)}, {ext(l2, 2)})) = 0",
    }
    arrays = ", ".join(f"{t(c, k)} AS {x}{k}" for k in (1, 2) for x, c in (("n", "n_core"), ("w", "a_words"), ("u", "a_nums"), ("l", "n_legal")))
    costs = L.SQL["er_vocab_cost"].replace(f"WITH r AS ({L._R1} UNION {L._REC} test_s2),", f"WITH r AS ({L._R1}),")
    sql = f"""{_JOINED}, costs AS ({costs}), common AS ({L.SQL["er_addr_common"]}), cm AS (SELECT country, list(word) AS words FROM common GROUP BY country),
      ar AS (SELECT *, {arrays} FROM j), st AS (SELECT ar.*, list_filter(w1, lambda x: NOT coalesce(list_contains(m1.words, x), false)) AS s1, list_filter(w2, lambda x: NOT coalesce(list_contains(m2.words, x), false)) AS s2 FROM ar LEFT JOIN cm m1 ON m1.country = ar.country LEFT JOIN cm m2 ON m2.country = ar.country2),
      al AS (SELECT *, {alone("n1", "n2")} AS alone1, {alone("n2", "n1")} AS alone2 FROM st, (SELECT map(list(word), list(cost)) AS cmap FROM costs))
      SELECT eid, cid, {", ".join(f"round(CAST({e} AS DOUBLE), 5) AS {c}" for c, e in f.items())} FROM al"""
    return list(f), sql


_RICH_COLS, _RICH_TEXT = _rich_sql()


@query(_RICH_TEXT)
def er_rich_checked(spark, d):
    """The rich features that SQL can express, from the same operator as all of them."""
    f = _rich(spark, d)
    return f.select("eid", "cid", *[F.round(c, 5).alias(c) for c in _RICH_COLS])


def _passes(spark, d):
    return passes.Passes(L.one(spark, d), L.cand(spark, d), L.truth(spark, d))


@query()
def er_pipeline_pass1(spark, d):
    p = _passes(spark, d)
    first = p.first()
    return context.decide(first, "p3", p.least)


@query()
def er_pipeline_pass2(spark, d):
    p = _passes(spark, d)
    p.first()
    return match_lists(p.ids, context.decide(p.second(), "p", p.later_least))


@query(f"WITH {L._RECS}, {L._PAIRS}, {L._decided(L.LEAST)} SELECT a.entity_id AS source1_entity_id, string_agg(b.entity_id, ',' ORDER BY b.entity_id) AS matched_entity_ids FROM decided JOIN r1 a ON a.eid = decided.eid JOIN r2 b ON b.eid = cid GROUP BY ALL")
def er_entity_lists(spark, d):
    """Surrogate ids back to the ids of the sources."""
    a = L.one(spark, d).select("eid", F.col("entity_id").alias("source1_entity_id"))
    b = L.cand(spark, d).select(F.col("eid").alias("cid"), F.col("entity_id").alias("other"))
    pairs = L.decided(spark, d).join(a, "eid").join(b, "cid")
    return match_lists(pairs.select("source1_entity_id"), pairs, "source1_entity_id", "other")


@query("SELECT country, count(DISTINCT eid) AS records FROM (FROM train_s1 UNION ALL FROM train_s2 UNION ALL FROM train_s3) GROUP BY country")
def er_stream_records(spark, d):
    return stream.upkeep(stream.arriving(spark, [f"{d}/{t}.parque[t]" for t in RECORDS], late="36500 days"), ["country"], "records")
