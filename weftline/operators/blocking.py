"""Candidate generation: weighted single and compound keys, a bounded probe, a cosine over what is shared.

Records have eid, country and the normalised text columns; both sides are keyed by country, so no plan loops over countries.
Keys never leave a record as arrays longer than the record; frequencies and weights are joins on (country, key). A probe only
uses keys below a document frequency, so no posting list that is joined is longer than that, however skewed the words are.
Every rank has a tie-break by key or id, and ranks only compare rounded values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import fixed as V
from weftline.session import cut

DIGITS = 6


def tokens(c: str) -> Column:
    return F.filter(F.split(F.col(c), " "), lambda t: t != "")


def _kind(kt: str, toks: Column, least: int = 1) -> Column:
    return F.transform(F.filter(toks, lambda t: F.length(t) >= least), lambda t: F.struct(F.lit(kt).alias("kt"), F.concat(F.lit(kt), t).alias("key")))


def single_keys(rec: DataFrame) -> DataFrame:
    """(eid, country, kt, key): name tokens n, skeletons k, the joined name c, address words a, numbers h; each once."""
    words = F.filter(tokens("a_words"), lambda t: ~t.isin(V.ADDRESS_STOP))
    kinds = [_kind("n", tokens("n_core"), 2), _kind("k", tokens("n_skel"), 3), _kind("c", F.array(F.replace(F.col("n_core"), F.lit(" "), F.lit("")))), _kind("a", words, 3), _kind("h", tokens("a_nums"))]
    keys = F.array_distinct(F.filter(F.flatten(F.array(*kinds)), lambda x: F.length(x["key"]) > 2))
    return rec.select("eid", "country", F.explode(keys).alias("k")).select("eid", "country", "k.kt", "k.key")


def document_frequency(cand_keys: DataFrame) -> DataFrame:
    return cand_keys.groupBy("country", "key").agg(F.count(F.lit(1)).alias("df"))


def weighted(keys: DataFrame, df: DataFrame, sizes: DataFrame) -> DataFrame:
    """keys with df (0 where no candidate has the key) and w = ln(N + 1) - ln(df + 1), N the country's candidates."""
    k = keys.join(df, ["country", "key"], "left").withColumn("df", F.coalesce("df", F.lit(0)).cast("long"))
    return k.join(sizes, "country").withColumn("w", F.round(F.log(F.col("n") + 1) - F.log(F.col("df") + 1), DIGITS)).drop("n")


def country_sizes(cand: DataFrame) -> DataFrame:
    return cand.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def compound_keys(weighted_keys: DataFrame) -> DataFrame:
    """(eid, country, kt, key): pairs of a record's rarest tokens. Kind x: name with address, number with address, name with
    number; kind m: pairs of name tokens. One exchange by record; the pairs are made inside arrays."""
    per = weighted_keys.filter(F.col("kt").isin("n", "a", "h")).groupBy("eid", "country").agg(F.array_sort(F.collect_list(F.struct("df", "key", "kt"))).alias("all"))

    def rarest(kt: str, n: int) -> Column:
        return F.slice(F.transform(F.filter("all", lambda x: x["kt"] == kt), lambda x: x["key"]), 1, n)

    def crossed(tag: str, a: Column, b: Column) -> Column:
        return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.lit("x").alias("kt"), F.concat(F.lit(tag + "|"), x, F.lit("|"), y).alias("key")))))

    name, addr, num = rarest("n", V.RAREST_NAME), rarest("a", V.RAREST_ADDRESS), rarest("h", V.RAREST_NUMBER)
    four = F.array_sort(rarest("n", V.RAREST_IN_PAIRS))
    pairs = F.flatten(F.transform(four, lambda x: F.transform(F.filter(four, lambda y: y > x), lambda y: F.struct(F.lit("m").alias("kt"), F.concat(F.lit("4|"), x, F.lit("|"), y).alias("key")))))
    keys = F.flatten(F.array(crossed("1", name, addr), crossed("2", num, addr), crossed("3", name, num), pairs))
    return per.select("eid", "country", F.explode(keys).alias("k")).select("eid", "country", "k.kt", "k.key")


def probe_keys(keys: DataFrame) -> DataFrame:
    """The keys of each record that are looked up: the rarest of all kinds and the rarest that speak for the name. Both are
    counted in one pass, so the keys are made and sent by record once."""
    w = Window.partitionBy("eid").orderBy("df", "key").rowsBetween(Window.unboundedPreceding, 0)
    rare = F.col("df").between(1, V.MOST_DF)
    name = F.col("df").between(1, V.NAME_MOST_DF) & F.col("kt").isin(*V.NAME_KINDS)
    rows = keys.filter(rare | name).withColumns({"_rare": F.count_if(rare).over(w), "_name": F.count_if(name).over(w)})
    return rows.filter((rare & (F.col("_rare") <= V.PROBES)) | (name & (F.col("_name") <= V.NAME_PROBES))).drop("_rare", "_name").distinct()


def probe_pairs(probes: DataFrame, cand_keys: DataFrame) -> DataFrame:
    """(eid, cid, country, ps, psn): the weight of shared probe keys, of all and of those for the name. Sent by record, since
    few of a pair's keys meet in one task before and the ranks of a record come next."""
    posting = cand_keys.select("country", "key", F.col("eid").alias("cid"))
    met = probes.join(posting, ["country", "key"]).filter("cid <> eid")
    name = F.when(F.col("kt").isin(*V.NAME_KINDS), F.col("w")).otherwise(0.0)
    rows = met.select("eid", "cid", "country", "w", name.alias("wn")).repartition("eid")
    return rows.groupBy("eid", "cid", "country").agg(F.round(F.sum("w"), DIGITS).alias("ps"), F.round(F.sum("wn"), DIGITS).alias("psn"))


def top_candidates(pairs: DataFrame, most: int = V.TOP_PROBE, most_name: int = V.TOP_NAME) -> DataFrame:
    """Pairs among the first by ps or, with any name evidence, the first by psn: two ranks over one exchange."""

    def place(by: str) -> Column:
        return F.row_number().over(Window.partitionBy("eid").orderBy(F.desc(by), "cid"))

    rows = pairs.withColumns({"_ps": place("ps"), "_psn": place("psn")})
    return rows.filter((F.col("_ps") <= most) | ((F.col("psn") > 0) & (F.col("_psn") <= most_name))).drop("_ps", "_psn")


def cosine(pairs: DataFrame, one_keys: DataFrame, cand_keys: DataFrame) -> DataFrame:
    """pairs with bscore, bscore_name and bscore_num: cosines over single keys; 0 where a side has no weight.

    The keys of a record go along as one array, so a pair is one row throughout, not one for each of its keys."""
    square = F.col("w") * F.col("w")
    mine = one_keys.groupBy("eid").agg(F.sqrt(F.sum(square)).alias("n1"), F.array_sort(F.collect_list(F.struct("key", "kt", square.alias("q")))).alias("k1"))
    theirs = cand_keys.groupBy(F.col("eid").alias("cid")).agg(F.sqrt(F.sum(square)).alias("n2"), F.collect_list("key").alias("k2"))
    both = pairs.join(mine, "eid", "left").join(theirs, "cid", "left")
    met = both.withColumn("met", F.filter("k1", lambda x: F.array_contains("k2", x["key"]))).drop("k1", "k2")
    size = F.col("n1") * F.col("n2")

    def score(*kinds: str) -> Column:
        of = F.filter("met", lambda x: x["kt"].isin(*kinds)) if kinds else F.col("met")
        return F.round(F.coalesce(F.try_divide(F.aggregate(of, F.lit(0.0), lambda a, x: a + x["q"]), size), F.lit(0.0)), DIGITS)

    return met.select("eid", "cid", "country", "ps", "psn", score().alias("bscore"), score("n", "k", "c").alias("bscore_name"), score("h").alias("bscore_num"))


def add_ranks(pairs: DataFrame) -> DataFrame:
    """Ranks and rivals in both directions: two exchanges, by cid, where cosine leaves the pairs, and by eid. The runner-up of a
    lone pair is 0."""
    e, c = Window.partitionBy("eid"), Window.partitionBy("cid")
    by_e, by_c = e.orderBy(F.desc("bscore"), "cid"), c.orderBy(F.desc("bscore"), "eid")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    return pairs.withColumns(
        {
            "rank_c": F.row_number().over(by_c),
            "best_c": F.max("bscore").over(c),
            "second_c": F.coalesce(F.nth_value("bscore", 2).over(by_c.rowsBetween(*whole)), F.lit(0.0)),
            "n_s1_for_c": F.count(F.lit(1)).over(c),
        }
    ).withColumns(
        {
            "rank_s1": F.row_number().over(by_e),
            "prank_s1": F.row_number().over(e.orderBy(F.desc("ps"), "cid")),
            "best_s1": F.max("bscore").over(e),
            "second_s1": F.coalesce(F.nth_value("bscore", 2).over(by_e.rowsBetween(*whole)), F.lit(0.0)),
            "n_c_for_s1": F.count(F.lit(1)).over(e),
        }
    )


def prune(ranked: DataFrame) -> DataFrame:
    """Optional: few candidates per record, near its best, and mutual."""
    return ranked.filter((F.col("rank_s1") <= V.PRUNE_RANK) & (F.col("bscore") >= V.PRUNE_SHARE * F.col("best_s1")) & (F.col("rank_c") <= V.PRUNE_MUTUAL))


class Blocking:
    """All stages between two sides, each as a DataFrame. The weighted keys serve four stages each and are cut to the shared
    folder once; the rest stays one lazy plan."""

    def __init__(self, one: DataFrame, cand: DataFrame):
        self.sizes = country_sizes(cand)
        k2 = single_keys(cand)
        self.df = document_frequency(k2)
        self.w1, self.w2 = (cut(weighted(k, self.df, self.sizes), "keys") for k in (single_keys(one), k2))
        self.c2 = cut(compound_keys(self.w2), "keys")
        self._meet(compound_keys(self.w1))

    @classmethod
    def among(cls, ids: DataFrame, known: Blocking) -> Blocking:
        """The candidates with the given eid against all candidates of known, whose keys are taken over: a candidate's keys and
        weights are the same on either side."""
        b = cls.__new__(cls)
        b.sizes, b.df, b.w2, b.c2 = known.sizes, known.df, known.w2, known.c2
        b.w1 = cut(b.w2.join(ids, "eid", "left_semi"), "keys")
        b._meet(b.c2.join(ids, "eid", "left_semi"))
        return b

    def _meet(self, compounds: DataFrame) -> None:
        self.c1 = weighted(compounds, document_frequency(self.c2), self.sizes)
        self.probes = probe_keys(self.w1.unionByName(self.c1))
        # no key above the highest bound is looked up, so none such, however frequent, is shuffled
        rare = self.w2.filter(F.col("df") <= max(V.MOST_DF, V.NAME_MOST_DF)).select("eid", "country", "kt", "key")
        self.pairs = probe_pairs(self.probes, rare.unionByName(self.c2))
        self.top = top_candidates(self.pairs)
        self.scored = cosine(self.top, self.w1, self.w2)
        self.ranked = add_ranks(self.scored)
