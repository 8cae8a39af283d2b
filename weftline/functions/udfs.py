"""Arrow-batched column functions over the plain ones in text and similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import similarity, text


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _strings(f):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


transliterate = _strings(text.transliterate)
fold = _strings(text.fold)
merge_initials = _strings(lambda s: " ".join(text.merge_initials(s.split())))
undo_lookalikes = _strings(text.undo_lookalikes)
skeletons = _strings(text.skeletons)


def segmented(c: Column, cost: dict[str, float]) -> Column:
    """Glued tokens split by a vocabulary of at most a few hundred thousand words, sent with the function."""
    if len(cost) > 500_000:
        raise ValueError("a vocabulary of more than 500,000 words")
    return _strings(lambda s: " ".join(w for t in s.split() for w in text.split_glued(t, cost)))(c)


pieces = _strings(text.pieces)


@F.pandas_udf(T.StringType())
def split_by(tok: pd.Series, known: pd.Series) -> pd.Series:
    """Each token split into the known words that lie in it (a map of word to cost), in the names' own canonical words."""
    return pd.Series([text.canonical(text.split_glued(t, dict(k))) for t, k in zip(tok, known)])


def name_features(words: dict[str, str] | None = None):
    @F.pandas_udf(_struct("n_norm", "n_core", "n_legal"))
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text.name_features(x, words) for x in s], columns=["n_norm", "n_core", "n_legal"])

    return run


def address_features(words: dict[str, str] | None = None):
    @F.pandas_udf(_struct("a_norm", "a_words", "a_nums"))
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text.address_features(x, words) for x in s], columns=["a_norm", "a_words", "a_nums"])

    return run


def _pairs(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(f(x, y)) for x, y in zip(a, b)], dtype="float64")

    return run


ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler = map(_pairs, (similarity.ratio, similarity.token_sort_ratio, similarity.token_set_ratio, similarity.partial_ratio, similarity.jaro_winkler))


def normalised(raw, name: str = "business_name", address: str = "business_address", keep: tuple[str, ...] = (), words: dict[str, str] | None = None):
    """A raw source (see files.RAW) as normalised records: one Python pass for names and addresses; keep names columns
    that go along. words is a learned dictionary for Indic script. name_indic and indic tell where that script stood."""
    n, a = name_features(words)(F.col(name)).alias("n"), address_features(words)(F.col(address)).alias("a")
    in_name, in_address = (F.coalesce(c, F.lit("")).rlike("[\\u0900-\\u0D7F]") for c in (name, address))
    cols = ["entity_id", F.lower(F.trim("country")).alias("country"), n, a, in_name.alias("name_indic"), (in_name | in_address).alias("indic")]
    d = raw.select(*keep, *cols).select(*keep, "entity_id", "country", "n.*", "a.*", "name_indic", "indic")
    return d.withColumn("n_skel", skeletons(F.col("n_core")))
