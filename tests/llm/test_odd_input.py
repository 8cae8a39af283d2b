"""Odd values in every column: nothing crashes, and rows that are equal meet."""

import random

import pytest

from weftline.llm import match, mix, names, pack, places, spans, topn

ODD = [None, "", " ", "  a  b ", "²", "१२", "😀 party", "ÀÉ ÎÖ", "x" * 5000, "\t\n", "a\tb", "0", "00000", "9" * 40, "null", "-", "'", "st", "unit", "nr", "nr nr", "A B C", "12a34b", "q" * 300 + " y"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    out = [(i, r.choice(ODD), r.choice(ODD), r.choice(ODD), r.choice(["us", None, "", "xx yy"])) for i in range(120)]
    out += [(None, "a", "b", "1", "us"), (5000, "alpha bakery", "main st town abc", "5 12345", "us"), (5000, "alpha bakery", "main st town abc", "5 12345", "us")]
    return out


COLS = "eid long, n_core string, a_words string, a_nums string, country string"


def test_match(spark, rows):
    one = spark.createDataFrame(rows, COLS)
    other = spark.createDataFrame([(None if e is None else e + 10_000, *x) for e, *x in rows], COLS)
    got = {(r.eid, r.cid) for r in match.match(one, [other]).collect()}
    assert (5000, 15_000) in got and len({c for _, c in got}) == len(got)


def test_names(spark, rows):
    got = [(r.eid_a, r.eid_b) for r in names.same_organisation(spark.createDataFrame(rows, COLS)).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    by = {}
    for e, n, *_ in rows:
        if e is not None and n and n.strip():
            by.setdefault(n.strip(), set()).add(e)
    same = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    assert same <= set(got)


def test_places(spark, rows):
    got = [(r.eid_a, r.eid_b) for r in places.same_location(spark.createDataFrame(rows, COLS)).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)


def test_texts(spark):
    docs = spark.createDataFrame([(i, t, "a_x" if i % 2 else None, t and t[:2]) for i, t in enumerate(ODD * 2)], "doc_id long, text string, source string, lang string")
    pairs = {(r.doc_a, r.doc_b) for r in spans.shared_span_pairs(docs).collect()}
    n = len(ODD)
    assert {(ODD.index(t), n + ODD.index(t)) for t in ODD if t and len(t) >= 200} <= pairs
    packed = pack.pack(docs, spark.createDataFrame([(1, 16)], "pack_id int, capacity_tokens long"))
    assert packed.select("doc_id").distinct().count() == 2 * n
    m = mix.Mix(docs, spark.createDataFrame([("a_x", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert m.selection().filter("times > 2").isEmpty() and not m.selection().isEmpty()


def test_extreme_scores(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([float("inf"), float("-inf"), 0.0, -0.0, 1e308, float("nan"), None])], "eid long, cid long, bscore double")
    assert [(r.cid, r.rk) for r in sorted(topn.top_n(df, "eid", "cid", "bscore", 8).collect(), key=lambda r: r.rk)] == [(0, 1), (4, 2), (2, 3), (3, 4), (1, 5)]
