"""The whole pipeline over raw files: python -m weftline.plans.job [train|predict|all] DATA OUT

DATA has {train,test}/{train,test}_source{1,2,3}.tsv and train/train_ground_truth.tsv. train leaves dictionaries, models and
thresholds under OUT/model; predict needs only those and writes one file of candidates and one of matches for each record of
source 1 of the test split. Stages that are there already (under OUT/stages) are not computed again."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import udfs
from weftline.operators import collective, context, dictionary, labels
from weftline.operators.passes import Passes, Settings
from weftline.session import cut
from weftline.sources import files

#: Words of the learned dictionary of Indic script, at most; it is sent to the tasks.
MOST_WORDS = 200_000
TEXTS = ["business_name", "business_address"]


def raw(spark: SparkSession, data: str, split: str, n: int) -> DataFrame:
    return files.read_tsv(spark, f"{data}/{split}/{split}_source{n}.tsv")


def true_ids(spark: SparkSession, data: str) -> DataFrame:
    lists = files.read_tsv(spark, f"{data}/train/train_ground_truth.tsv", ["source1_entity_id", "matched_entity_ids"])
    return labels.truth(lists, "source1_entity_id", "matched_entity_ids").withColumnRenamed("cid", "other")


def learn(spark: SparkSession, data: str, out: str, settings: Settings) -> None:
    """The dictionary of Indic words, from the raw texts of true pairs, and the vocabulary, from source 1 of both splits."""

    def words() -> DataFrame:
        one = raw(spark, data, "train", 1).select(F.col("entity_id").alias("source1_entity_id"), *[F.col(c).alias(f"{c}_1") for c in TEXTS])
        cand = raw(spark, data, "train", 2).unionByName(raw(spark, data, "train", 3)).select(F.col("entity_id").alias("other"), *TEXTS)
        indic = cand.filter(" OR ".join(f"{c} RLIKE '[\\u0900-\\u0D7F]'" for c in TEXTS))
        both = indic.join(true_ids(spark, data), "other").join(one, "source1_entity_id")
        return dictionary.learned_words(both, [(c, f"{c}_1") for c in TEXTS])

    files.kept(spark, f"{out}/model/words", words)
    known = dictionary.bounded(spark.read.parquet(f"{out}/model/words"), MOST_WORDS)

    def vocabulary() -> DataFrame:
        names = raw(spark, data, "train", 1).unionByName(raw(spark, data, "test", 1))
        return dictionary.word_costs(udfs.normalised(names, words=known), "n_norm", settings.prior)

    files.kept(spark, f"{out}/model/vocabulary", vocabulary)


def sources(spark: SparkSession, data: str, split: str, out: str) -> tuple[DataFrame, DataFrame]:
    """The normalised records of source 1, and of sources 2 and 3, with surrogate ids; needs what learn left."""
    known = dictionary.bounded(spark.read.parquet(f"{out}/model/words"), MOST_WORDS)
    costs = spark.read.parquet(f"{out}/model/vocabulary")

    def of(n: int) -> DataFrame:
        rec = udfs.normalised(files.with_ids(raw(spark, data, split, n), n), keep=("eid",), words=known)
        return dictionary.without_glue(cut(rec, "normalised"), costs).drop("name_indic")

    one, two, three = (files.kept(spark, f"{out}/stages/{split}_source{n}", lambda n=n: of(n)) for n in (1, 2, 3))
    return one, two.unionByName(three)


def truth(spark: SparkSession, data: str, one: DataFrame, cand: DataFrame) -> DataFrame:
    a = one.select("eid", F.col("entity_id").alias("source1_entity_id"))
    b = cand.select(F.col("eid").alias("cid"), F.col("entity_id").alias("other"))
    return cut(true_ids(spark, data).join(a, "source1_entity_id").join(b, "other").select("eid", "cid"), "truth")


def named(pairs: DataFrame, one: DataFrame, cand: DataFrame, name: str) -> DataFrame:
    """Match lists in the ids of the sources, one row for every record of source 1."""
    a = one.select("eid", F.col("entity_id").alias("source1_entity_id"))
    b = cand.select(F.col("eid").alias("cid"), F.col("entity_id").alias("other"))
    return files.match_lists(a, pairs.join(a, "eid").join(b, "cid"), "source1_entity_id", "other", name)


def train(spark: SparkSession, data: str, out: str, settings: Settings | None = None) -> Passes:
    """Fits both passes and leaves them under OUT/model, with the model adapted to countries that only the test split has."""
    settings = settings or Settings()
    learn(spark, data, out, settings)
    one, cand = sources(spark, data, "train", out)
    p = Passes(one, cand, truth(spark, data, one, cand), settings)
    p.first()
    p.second()
    p.save(f"{out}/model")
    test_one, test_cand = sources(spark, data, "test", out)
    new = collective.unseen(test_one.select("eid", "country"), one)
    if not new.isEmpty():
        _, full, scored = p.predict(test_one, test_cand)
        kept, fitted = p.adapt(full, cut(scored, "scored"), new)
        if kept:
            adapted = Passes.load(spark, f"{out}/model")
            adapted.later = fitted
            adapted.save(f"{out}/adapted")
            files.kept(spark, f"{out}/adapted/countries", lambda: new.select("country").distinct())
    return p


def predict(spark: SparkSession, data: str, out: str) -> None:
    """Candidates and matches of the test split from what train left. Records of the countries that a model was adapted to get
    its decisions, all others those of the first one."""
    p = Passes.load(spark, f"{out}/model")
    one, cand = sources(spark, data, "test", out)
    first, full, scored = p.predict(one, cand)
    scored = cut(scored, "scored")
    lists = named(context.decide(scored, "p", p.later_least), one, cand, "matched_entity_ids")
    if files.exists(spark, f"{out}/adapted/countries/_SUCCESS"):
        adapted = Passes.load(spark, f"{out}/adapted")
        again = named(context.decide(p.final(full, adapted.later), "p", p.later_least), one, cand, "matched_entity_ids")
        where = one.join(spark.read.parquet(f"{out}/adapted/countries"), "country", "left_semi").select(F.col("entity_id").alias("source1_entity_id"))
        lists = collective.rewrite(lists, again, where, "source1_entity_id", "matched_entity_ids")
    candidates = first.select("eid", "cid").union(scored.select("eid", "cid")).distinct()
    files.write_tsv(named(candidates, one, cand, "candidate_entity_ids"), f"{out}/candidates")
    files.write_tsv(lists, f"{out}/matches")


def run(spark: SparkSession, data: str, out: str, settings: Settings | None = None) -> Passes:
    p = train(spark, data, out, settings)
    predict(spark, data, out)
    return p


if __name__ == "__main__":
    {"train": train, "predict": predict, "all": run}[sys.argv[1]](SparkSession.builder.appName("weftline").getOrCreate(), *sys.argv[2:4])
