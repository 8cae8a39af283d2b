"""Gradient-boosted scoring of pairs with MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands for a missing value: the trees can't take NaN.
MISSING = -9.0


def numeric_columns(df: DataFrame, leave: tuple[str, ...] = ("eid", "cid", "y", "w", "fold", "best_sib", "held", "fitted")) -> list[str]:
    return [c for c, t in df.dtypes if c not in leave and t in ("double", "float", "int", "bigint", "tinyint", "smallint", "boolean")]


def filled(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with a column for the trees beside each of cols, missing values replaced."""
    return df.withColumns({f"_f_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(MISSING)) for c in cols})


def fit(df: DataFrame, cols: list[str], label: str = "y", weight: str | None = None, rounds: int = 60, depth: int = 6, step: float = 0.1, stop_early: str | None = None, seed: int = 7) -> PipelineModel:
    """A boosted model on the labelled rows. stop_early names a boolean column of validation rows: boosting ends, within rounds,
    where the error on them no longer falls. Without any such row all rounds are run."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, subsamplingRate=0.8, maxBins=64)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if stop_early and not df.filter(stop_early).isEmpty():
        gbt = gbt.setValidationIndicatorCol(stop_early)
    elif stop_early:
        df = df.filter(~F.col(stop_early))
    rows = filled(df, cols).withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=[f"_f_{c}" for c in cols], outputCol="features"), gbt]).fit(rows)


def score(model: PipelineModel, df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """df with the probability of a match, rounded so that ranks on it are stable. No join: the columns go along."""
    out = model.transform(filled(df, cols))
    return out.select(*df.columns, F.round(vector_to_array("probability")[1], 6).alias(name))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, cols: list[str], k: int = 20) -> list[tuple[str, float]]:
    got = model.stages[-1].featureImportances.toArray()
    return sorted(((c, float(x)) for c, x in zip(cols, got)), key=lambda p: (-p[1], p[0]))[:k]
