"""The two passes of matching as one job over DataFrames: candidates, cascade of models, collective second look, decision."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import fixed as V
from weftline.operators import blocking, collective, context, dictionary, labels, model, rich
from weftline.operators.pairs import FEATURES as CHEAP
from weftline.operators.pairs import cheap_features
from weftline.session import cut

CONTEXT = "cx_rank_s1 cx_gap_s1 cx_n_s1 cx_sum_s1 cx_rank_c cx_gap_rival_c cx_gap_best_c cx_n_c".split()


@dataclass
class Settings:
    """Rounds are upper bounds: each model stops where the error on its inner hold-out no longer falls."""

    stage_two_least: float | None = None  # from the labels where not given
    stage_two_top: int = V.STAGE_TWO_TOP
    least: float | None = None
    later_least: float | None = None
    sure: float = V.SURE
    rounds_two: int = 40
    rounds: int = 60
    depth_two: int = 5
    depth: int = 6
    prior: list[str] = field(default_factory=lambda: sorted(V.LEGAL) + [w for x in V.NAME_WORDS.values() for w in x.split()])


class Passes:
    """Fits on labelled records, then scores any records. Stages that are used again are cut to the shared folder.

    truth has the true (eid, cid). Fold A fits the cheap model and, on its inner part, chooses the score below which pairs go;
    fold B fits the rich model; fold C, which no model has seen, chooses the threshold of the first pass. Of fold C three fifths
    fit the second pass, two fifths choose its threshold and are the hold-out of self-training. Every model has an inner part of its
    fold for early stopping."""

    def __init__(self, one: DataFrame, cand: DataFrame, truth: DataFrame, settings: Settings | None = None):
        self.s = settings or Settings()
        self.costs = cut(dictionary.word_costs(one, "n_norm", self.s.prior), "costs")
        self.one, self.cand = self.prepared(one, cand)
        self.truth, self.ids = cut(truth.select("eid", "cid"), "truth"), self.one.select("eid")

    def prepared(self, one: DataFrame, cand: DataFrame) -> tuple[DataFrame, DataFrame]:
        common = cut(dictionary.common_words(one.unionByName(cand), "a_words"), "common")
        return tuple(cut(rich.with_street(rich.with_costs(r, self.costs), common), "records") for r in (one, cand))

    def labelled(self, df: DataFrame) -> DataFrame:
        return df.join(self.truth.select("eid", "cid").withColumn("y", F.lit(1)), ["eid", "cid"], "left").fillna(0, ["y"])

    @staticmethod
    def scored_pairs(blocks: blocking.Blocking) -> DataFrame:
        return cut(blocks.ranked, "scored")

    @staticmethod
    def held(part: tuple[int, int], of: int = 0):
        return labels.part_of(F.col("eid"), *part) == of

    def cascade(self, scored: DataFrame, one: DataFrame, cand: DataFrame) -> DataFrame:
        """The pairs that survive the cheap model, with rich and competition features."""
        cheap = cheap_features(scored, one, cand)
        alive = cut(context.survivors(model.score(self.stage_two, cheap, CHEAP, "p2"), "p2", self.stage_two_least, self.s.stage_two_top), "alive")
        feats = rich.rich_features(alive, one, cand)
        both = context.context(alive, "p2").drop(*[c for c in rich.FEATURES if c in CHEAP])
        return cut(both.join(feats, ["eid", "cid"]), "stage3")

    def chosen(self, pairs: DataFrame, score: str, where, low: float, high: float, last: bool = False) -> float:
        """The threshold of the highest f05 over the records that where holds for."""
        sweep = context.threshold_sweep(pairs.filter(where), score, self.truth.filter(where), self.ids.filter(where), low, high, 0.025)
        return context.best_threshold(sweep, last).collect()[0].thr

    def first(self) -> DataFrame:
        """Fit the first pass; (eid, cid, p2, p3) of the pairs that survive the cheap model."""
        fold = labels.fold_of(F.col("eid"))
        self.blocks = blocking.Blocking(self.one, self.cand)
        self.ranked = self.scored_pairs(self.blocks)
        self.scored = self.ranked.select("eid", "cid")
        known = cut(self.labelled(cheap_features(self.ranked, self.one, self.cand).filter(fold == "A")).withColumn("held", self.held(labels.INNER_A)), "fold_a")
        sampled = labels.negative_sample(known.filter("NOT held"), "y").unionByName(known.filter("held"))
        self.stage_two = model.fit(sampled, CHEAP, rounds=self.s.rounds_two, depth=self.s.depth_two, stop_early="held")
        self.stage_two_least = self.s.stage_two_least
        if self.stage_two_least is None:
            p2 = model.score(self.stage_two, known.filter("held"), CHEAP, "p2").select("eid", "cid", "p2")
            self.stage_two_least = context.recall_threshold(p2, "p2", self.truth, most=self.s.stage_two_top).collect()[0].thr or 0.0
        self.stage3 = both = self.cascade(self.ranked, self.one, self.cand)
        self.cols3 = [*dict.fromkeys([*CHEAP, "p2", *rich.FEATURES, *CONTEXT])]
        rows = self.labelled(both).filter(fold == "B").withColumn("held", self.held(labels.INNER_B))
        self.stage_three = model.fit(rows, self.cols3, rounds=self.s.rounds, depth=self.s.depth, stop_early="held")
        self.pass_one = cut(model.score(self.stage_three, both, self.cols3, "p3").select("eid", "cid", "p2", "p3"), "pass1")
        self.least = self.s.least if self.s.least is not None else self.chosen(self.pass_one, "p3", fold == "C", 0.2, 0.9)
        return self.pass_one

    def universe(self, pass_one: DataFrame, stage3: DataFrame, ranked: DataFrame, one: DataFrame, cand: DataFrame, blocks: blocking.Blocking | None = None) -> DataFrame:
        """The pairs of the second pass with their scores, competition features and the rich ones against record and best sibling.
        The rich features of the first pass (stage3) and the keys of its candidates (blocks) are taken over; only the rich
        features of new pairs are computed."""
        sure = cut(collective.confident(pass_one.select("eid", "cid", "p3"), "p3", self.s.sure), "sure")
        ev = collective.evidence(sure, cut(collective.sibling_probe(sure, cand, known=blocks), "siblings"))
        uni = cut(collective.competition(collective.universe(pass_one.select("eid", "cid", "p2", "p3"), ev, sure, ranked), sure, "p3"), "universe")
        known = stage3.select("eid", "cid", *rich.FEATURES)
        a = known.unionByName(rich.rich_features(uni.join(known.select("eid", "cid"), ["eid", "cid"], "left_anti"), one, cand))
        sib = uni.filter("best_sib IS NOT NULL").select(F.col("best_sib").alias("eid"), "cid").distinct()
        b = rich.rich_features(sib, cand, cand, "s_").withColumnRenamed("eid", "best_sib")
        return cut(uni.join(a, ["eid", "cid"]).join(b, ["best_sib", "cid"], "left"), "pass2")

    def second(self) -> DataFrame:
        """Fit the second pass on pairs of fold C only, since the rich model has seen fold B; choose its threshold on the rest of the
        fold. (eid, cid, p) of the pairs of all records, narrowed to those that may be decided."""
        full = self.universe(self.pass_one, self.stage3, self.ranked, self.one, self.cand, self.blocks)
        self.cols_later = model.numeric_columns(full)
        in_c = labels.fold_of(F.col("eid")) == "C"
        rows = self.labelled(full.filter(in_c)).withColumns({"held": self.held(labels.INNER_C), "fitted": labels.part_of(F.col("eid"), *labels.SPLIT_C) < 3})
        self.later_rows = cut(rows, "later_rows")
        self.later = model.fit(self.later_rows.filter("fitted"), self.cols_later, rounds=self.s.rounds, depth=self.s.depth, stop_early="held")
        self.later_least = self.s.later_least
        if self.later_least is None:
            p = model.score(self.later, self.later_rows.filter("NOT fitted"), self.cols_later, "p")
            self.later_least = self.chosen(p, "p", in_c & (labels.part_of(F.col("eid"), *labels.SPLIT_C) >= 3), 0.3, 0.95, last=True)
        return self.final(full)

    def final(self, full: DataFrame, fitted=None) -> DataFrame:
        return model.score(fitted or self.later, collective.narrow(full, "p3"), self.cols_later, "p").select("eid", "cid", "p")

    def predict(self, one: DataFrame, cand: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Both passes over other records: (first pass with p2 and p3, rows of the second pass, its scores p)."""
        one, cand = self.prepared(one, cand)
        blocks = blocking.Blocking(one, cand)
        ranked = self.scored_pairs(blocks)
        both = self.cascade(ranked, one, cand)
        p1 = cut(model.score(self.stage_three, both, self.cols3, "p3").select("eid", "cid", "p2", "p3"), "pass1")
        full = self.universe(p1, both, ranked, one, cand, blocks)
        return p1, full, self.final(full)

    def adapt(self, full: DataFrame, scored: DataFrame, where: DataFrame) -> tuple[bool, object]:
        """Self-training for records without labels (where): their sure scores become labels of half weight beside the rows the
        second pass was fitted on. The new model is kept only if the hold-out loses no more than the gate allows against the
        deployed one. Returns (kept, model)."""
        pseudo = collective.pseudo_labels(scored.join(where.select("eid"), "eid", "left_semi"), "p")
        cols = ["y", "held", *self.cols_later]
        extra = full.join(pseudo, ["eid", "cid"]).withColumn("held", F.lit(False)).select(*cols, F.lit(V.PSEUDO_WEIGHT).alias("w"))
        own = self.later_rows.filter("fitted").select(*cols, F.lit(1.0).alias("w"))
        new = model.fit(own.unionByName(extra), self.cols_later, weight="w", rounds=self.s.rounds, depth=self.s.depth, stop_early="held")
        held = self.later_rows.filter("NOT fitted")
        where_held = (labels.fold_of(F.col("eid")) == "C") & (labels.part_of(F.col("eid"), *labels.SPLIT_C) >= 3)

        def f(m) -> float:
            got = context.decide(self.final(held, m), "p", self.later_least)
            return context.macro_f_half(got, self.truth.filter(where_held), self.ids.filter(where_held)).collect()[0].f05 or 0.0

        keep = accepted(f(self.later), f(new))
        return keep, new if keep else self.later

    #: What save keeps and load gives back, beside the models and word costs.
    KEPT = ("stage_two_least", "least", "later_least", "cols3", "cols_later")
    MODELS = ("stage_two", "stage_three", "later")

    def save(self, path: str) -> None:
        """Models, thresholds, columns and word costs under a folder, so that another process can predict."""
        for m in self.MODELS:
            model.save(getattr(self, m), f"{path}/{m}")
        self.costs.write.mode("overwrite").parquet(f"{path}/costs")
        text = json.dumps({k: getattr(self, k) for k in self.KEPT} | {"sure": self.s.sure, "stage_two_top": self.s.stage_two_top})
        self.costs.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Passes:
        """For predict only: the labelled rows stay behind."""
        p = cls.__new__(cls)
        kept = json.loads(spark.read.text(f"{path}/settings").collect()[0].value)
        p.s = Settings(sure=kept.pop("sure"), stage_two_top=kept.pop("stage_two_top"))
        for k, v in kept.items():
            setattr(p, k, v)
        for m in cls.MODELS:
            setattr(p, m, model.load(f"{path}/{m}"))
        p.costs = spark.read.parquet(f"{path}/costs")
        return p


def accepted(before: float, after: float, drop: float = V.GATE_DROP) -> bool:
    return after >= before - drop
