"""Dictionaries learned from the tables: word costs, word votes, common words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import native, udfs
from weftline.functions.similarity import ratio
from weftline.operators.blocking import tokens


def word_costs(names: DataFrame, col: str, prior: list[str], boost: int = 50, least: int = 3) -> DataFrame:
    """(word, n, cost): -ln p of the alphabetic words of two letters or more; each listing in prior adds boost."""
    words = names.select(F.explode(tokens(col)).alias("word")).filter(F.col("word").rlike("^[a-z]{2,}$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    extra = names.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, prior)).cast("array<string>")).alias("word")).groupBy("word").agg((F.count(F.lit(1)) * boost).alias("n"))
    n = words.unionByName(extra).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    total = n.agg(F.sum("n")).scalar()
    return n.select("word", "n", F.round(-F.log(F.col("n") / total), 3).alias("cost"))


NONE = "<none>"


def _aligned(batches):
    for b in batches:
        t, u = [], []
        for mine, other in zip(*[c.to_pylist() for c in b.columns]):
            theirs = other.split()
            for tok in mine.split():
                if len(tok) >= 2 and not tok.isdigit():
                    best, score = NONE, 0.0
                    for o in theirs:
                        r = ratio(tok, o)
                        if r > score:
                            best, score = o, r
                    t.append(tok)
                    u.append(best if score >= 55 else NONE)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(u, pa.string())], names=["t", "u"])


def aligned_votes(pairs: DataFrame, mine: str, other: str) -> DataFrame:
    """(t, u): each word of a text with the most similar word of the matched text, the first where equal, or none where no
    word is similar enough."""
    return pairs.select(F.coalesce(mine, F.lit("")), F.coalesce(other, F.lit(""))).mapInArrow(_aligned, "t string, u string")


def majority_votes(pairs: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """(t, u, n): of (t, u) votes, the winner of each t with enough support; words that win for themselves are left out, and
    those whose winner is no word. Votes for no word count in the share."""
    votes = pairs.groupBy("t", "u").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("t")
    best = votes.withColumns({"all": F.sum("n").over(w), "rk": F.row_number().over(w.orderBy(F.desc("n"), "u"))})
    return best.filter((F.col("rk") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("all")) & (F.col("t") != F.col("u")) & (F.col("u") != NONE)).select("t", "u", "n")


def common_words(rec: DataFrame, col: str, k: int = 400) -> DataFrame:
    """(country, word, n): the k words of each country that most records hold (ties: word ascending)."""
    words = rec.select("country", F.explode(F.array_distinct(tokens(col))).alias("word")).groupBy("country", "word").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("country").orderBy(F.desc("n"), "word")
    return words.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).select("country", "word", "n")


def learned_words(raw_pairs: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """(t, u, n): what words of records in Indic script mean, voted by the texts of their true partners. raw_pairs has both texts
    of each field, mine and other; a text without Indic script takes no part."""
    votes = None
    for mine, other in fields:
        rows = raw_pairs.filter(F.col(mine).rlike("[\\u0900-\\u0D7F]")).select(udfs.pieces(F.col(mine)).alias("a"), udfs.pieces(F.col(other)).alias("b")).filter("b <> ''")
        got = aligned_votes(rows, "a", "b")
        votes = got if votes is None else votes.unionByName(got)
    return majority_votes(votes)


def bounded(words: DataFrame, most: int) -> dict[str, str]:
    """A dictionary (t, u) for the tasks, after a check of its size; no more than most + 1 rows reach the driver."""
    rows = words.select("t", "u").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary of more than {most} words")
    return {r.t: r.u for r in rows}


GLUED, LONGEST = 7, 20


def splits(tokens_: DataFrame, costs: DataFrame) -> DataFrame:
    """(tok, words): glued tokens and the words they stand for. tokens_: tok, each once.

    Only the words of the vocabulary that lie in a token meet it, by a join on its substrings, so no vocabulary is sent to the
    tasks, whatever its size."""
    glued = tokens_.filter((F.length("tok") >= GLUED) & F.col("tok").rlike("^[a-z]+$")).join(costs.select(F.col("word").alias("tok")), "tok", "left_anti")
    parts = F.expr(f"array_distinct(flatten(transform(sequence(1, length(tok) - 1), i -> transform(sequence(2, least({LONGEST}, length(tok) - i + 1)), n -> substring(tok, i, n)))))")
    met = glued.select("tok", F.explode(parts).alias("word")).join(costs.select("word", "cost"), "word").groupBy("tok").agg(F.map_from_entries(F.collect_list(F.struct("word", "cost"))).alias("known"))
    return met.select("tok", udfs.split_by("tok", "known").alias("words")).filter("words <> tok")


def without_glue(rec: DataFrame, costs: DataFrame) -> DataFrame:
    """Normalised records whose names have no glued tokens; names in Indic script stay as they are (column name_indic)."""
    toks = rec.filter("NOT name_indic").select("eid", F.posexplode(tokens("n_norm")).alias("pos", "tok"))
    found = splits(toks.select("tok").distinct(), costs)
    touched = toks.join(found.select("tok"), "tok", "left_semi").select("eid").distinct()
    new = toks.join(touched, "eid", "left_semi").join(found, "tok", "left").groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("words", "tok").alias("w")))).alias("ws"))
    new = new.select("eid", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("_norm"))
    core, legal = native.split_name(F.col("n_norm"))
    d = rec.join(new, "eid", "left").withColumn("n_norm", F.coalesce("_norm", "n_norm"))
    d = d.withColumns({"n_core": core, "n_legal": legal}).drop("_norm")
    return d.withColumn("n_skel", F.when(F.lit(True), udfs.skeletons(F.col("n_core")))).select(*rec.columns)
