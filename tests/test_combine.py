import pytest

from weftline.operators import combine

SCHEMA = "eid long, n_core string, a_words string, fld string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_counts_once_per_row_and_token(spark):
    df = rows(spark, [(1, "a b a", "x", "q"), (1, "a b a", "x", "q"), (2, None, "", None), (3, "a", None, "a")])
    got = {(r.fld, r.tok): r.n_rows for r in combine.token_counts(df, ["n_core", "a_words"]).collect()}
    assert got == {("n_core", "a"): 3, ("n_core", "b"): 2, ("a_words", "x"): 2}


def test_heavy_bound_is_exact(spark):
    df = rows(spark, [(i, "t" if i < 5 else "u", None, None) for i in range(100)])
    got = {r.tok for r in combine.heavy_tokens(df, ["n_core"], 5).collect()}
    assert got == {"t", "u"}
    df = rows(spark, [(i, "t" if i < 4 else "u", None, None) for i in range(100)])
    assert {r.tok for r in combine.heavy_tokens(df, ["n_core"], 5).collect()} == {"u"}


def test_empty_table(spark):
    df = rows(spark, [])
    assert combine.token_counts(df, ["n_core"]).count() == 0
    assert combine.heavy_tokens(df, ["n_core"], 5).count() == 0
    assert combine.heaviest_tokens(df, ["n_core"], 3).count() == 0


def test_distinct_records_and_ties(spark):
    df = rows(spark, [(1, "b a", None, None), (1, "b a", None, None), (2, "b", None, None), (None, "c", None, None)])
    toks = combine.token_rows(df, ["n_core"])
    assert toks.count() == 6
    per = combine.distinct_by_key(df.selectExpr("explode(split(n_core, ' ')) AS tok", "eid"), ["tok"], "eid", "n")
    assert {r.tok: r.n for r in per.collect()} == {"a": 1, "b": 2, "c": 0}
    top = combine.heaviest_tokens(df, ["n_core"], 2).collect()
    assert [(r.tok, r.rk) for r in sorted(top, key=lambda r: r.rk)] == [("b", 1), ("a", 2)]


def test_long_text(spark):
    df = rows(spark, [(1, " ".join(str(i % 1000) for i in range(200_000)), None, None)])
    assert combine.token_counts(df, ["n_core"]).count() == 1000


@pytest.mark.parametrize("k", [1, 3])
def test_one_key_in_all_rows(spark, k):
    df = spark.range(30_000).selectExpr("id AS eid", f"concat('hot w', id % {k}) AS n_core", "'x' AS a_words")
    got = {r.tok: r.n_rows for r in combine.token_counts(df, ["n_core"]).collect()}
    assert got["hot"] == 30_000 and got["w0"] == 30_000 // k
