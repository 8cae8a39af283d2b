import pytest
from pyspark.sql import functions as F

from weftline.operators import blocking, collective, context, dictionary, labels
from weftline.sources import files

COLS = "eid long, country string, n_core string, n_skel string, a_words string, a_nums string"


def rec(spark, rows):
    return spark.createDataFrame([(e, c, n, n, w, u) for e, c, n, w, u in rows], COLS)


ONE = [(1, "us", "alpha bakery", "main st town", "5 12345"), (2, "us", "beta tools", "oak rd town", "7 12345"), (3, "fr", "alpha bakery", "main st town", "5 12345"), (4, "us", "gamma", "", "")]
CAND = [(11, "us", "alpha bakery", "main st town", "5 12345"), (12, "us", "bakery alpha", "main town", "5"), (13, "us", "beta tools", "elm ave city", "99"), (14, "in", "beta tools", "oak rd town", "7 12345"), (15, "us", "", "", "")]


def test_blocking_stays_in_country_and_ranks(spark):
    b = blocking.Blocking(rec(spark, ONE), rec(spark, CAND))
    rows = {(r.eid, r.cid): r for r in b.ranked.collect()}
    assert (1, 11) in rows and (1, 12) in rows and (2, 13) in rows
    assert not any(c == 14 for _, c in rows) and not any(e == 3 for e, _ in rows)
    assert rows[1, 11].rank_s1 == 1 and rows[1, 12].rank_s1 == 2 and 0.99 < rows[1, 11].bscore <= 1
    assert rows[1, 11].second_s1 == rows[1, 12].bscore and rows[2, 13].second_c == 0.0


def test_row_order_does_not_matter(spark):
    a = blocking.Blocking(rec(spark, ONE), rec(spark, CAND)).ranked
    b = blocking.Blocking(rec(spark, ONE[::-1]).repartition(3), rec(spark, CAND[::-1]).repartition(4)).ranked
    assert sorted(map(tuple, a.select(*a.columns).collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_decide_is_one_to_one_with_ties(spark):
    p = spark.createDataFrame([(1, 9, 0.8), (2, 9, 0.8), (2, 8, 0.4), (3, 8, 0.3)], "eid long, cid long, s double")
    assert sorted(map(tuple, context.decide(p, "s", 0.5).collect())) == [(1, 9, 0.8)]


def test_f_half(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "eid long")
    truth = spark.createDataFrame([(1, 9), (1, 8), (2, 7)], "eid long, cid long")
    pred = spark.createDataFrame([(1, 9), (2, 6)], "eid long, cid long")
    # 1: tp 1 nt 2 np 1 -> 1.25/1.5; 2: 0; 3: 1
    want = round((1.25 / 1.5 + 0 + 1) / 3, 6)
    assert context.macro_f_half(pred, truth, ids).collect()[0].f05 == want
    sweep = context.threshold_sweep(pred.withColumn("s", F.lit(0.6)), "s", truth, ids, 0.5, 0.7, 0.1)
    got = {round(r.thr, 1): r.f05 for r in sweep.collect()}
    assert got == {0.5: want, 0.6: want}  # the upper end is no threshold
    assert context.best_threshold(sweep).collect()[0].thr == 0.5 and context.best_threshold(sweep, last=True).collect()[0].thr == 0.6
    above = context.threshold_sweep(pred.withColumn("s", F.lit(0.6)), "s", truth, ids, 0.7, 0.75, 0.1).collect()
    assert [(r.thr, r.f05) for r in above] == [(0.7, round(1 / 3, 6))]


def test_rival_is_the_second_best_for_every_rank(spark):
    p = spark.createDataFrame([(1, 9, 0.9), (2, 9, 0.6), (3, 9, 0.2), (1, 8, 0.5)], "eid long, cid long, s double")
    got = {(r.eid, r.cid): (r.cx_gap_rival_c, r.cx_gap_best_c) for r in context.context(p, "s").collect()}
    assert got == {(1, 9): (0.3, 0.0), (2, 9): (0.0, -0.3), (3, 9): (-0.4, -0.7), (1, 8): (0.5, 0.0)}


def test_lost_pairs_count_against_the_share(spark):
    rows = [(1, i, i / 100) for i in range(20)] + [(2 + i, 100, i / 100) for i in range(80)]
    p = spark.createDataFrame(rows, "eid long, cid long, s double")
    # 12 of the first record's 20 are beyond its first eight; a fifth of 100 may go, so 8 more: the ninth score
    assert context.recall_threshold(p, "s", p, 0.8).collect()[0].thr == 0.08
    assert context.recall_threshold(p, "s", p, 0.995).collect()[0].thr == 0.0


def test_universe_and_competition(spark):
    pairs = spark.createDataFrame([(1, 9, 0.3, 0.95), (2, 9, 0.2, 0.4), (2, 8, 0.1, 0.2)], "eid long, cid long, p2 double, p3 double")
    sure = collective.confident(pairs.select("eid", "cid", "p3"), "p3", 0.9)
    assert [tuple(r) for r in sure.collect()] == [(1, 9, 0.95)]
    ev = spark.createDataFrame([(1, 9, 0.9, 5.0, 1, 9), (1, 7, 0.8, 4.0, 1, 9), (1, 8, 0.7, 3.0, 1, 9)], "eid long, cid long, sib_bscore double, sib_ps double, sib_hits long, best_sib long")
    scores = spark.createDataFrame([(1, 7, 1.5, 0.6, 0.5, 0.1, 2, 1, 2)], "eid long, cid long, ps double, bscore double, bscore_name double, bscore_num double, rank_s1 int, rank_c int, prank_s1 int")
    uni = collective.universe(pairs, ev, sure, scores, most_new=1)
    rows = {(r.eid, r.cid): r for r in collective.competition(uni, sure, "p3").collect()}
    assert set(rows) == {(1, 9), (2, 9), (2, 8), (1, 7)}  # of the new pairs the best one
    new, lost = rows[1, 7], rows[2, 9]
    assert (new.p2, new.p3, new.ps, new.bscore, new.rank_s1, new.is_new, new.n_conf, new.u_n_s1) == (None, None, 1.5, 0.6, 2, 1, 1, 2)
    assert (lost.p2, lost.c_best_p3, lost.c_best_other_gap, lost.other_conf_p3, lost.is_new) == (0.2, 0.95, 0.55, 0.95, 0)
    assert (rows[1, 9].c_best_other_gap, rows[1, 9].other_conf_p3, rows[1, 9].sib_bscore) == (0.0, None, None)


def test_votes_for_no_word_win_nothing(spark):
    rows = [("a", "x")] * 3 + [("a", "y")] * 2 + [("b", "<none>")] * 9 + [("c", "z")] * 2 + [("d", "d")] * 5 + [("e", "w")] * 5 + [("e", "<none>")] * 4
    got = dictionary.majority_votes(spark.createDataFrame(rows, "t string, u string"))
    assert [tuple(r) for r in got.collect()] == [("a", "x", 3)]


def test_recall_threshold_keeps_the_share(spark):
    p = spark.createDataFrame([(i, i, i / 1000) for i in range(1000)], "eid long, cid long, s double")
    assert context.recall_threshold(p, "s", p).collect()[0].thr == 0.005


def test_narrow_and_pseudo_labels(spark):
    u = spark.createDataFrame([(1, 1, 0.5, 0.9), (1, 2, None, 0.8), (1, 3, None, 0.7), (1, 4, None, 0.2)], "eid long, cid long, p double, sib_bscore double")
    assert sorted(r.cid for r in collective.narrow(u, "p").collect()) == [1, 2]
    p = spark.createDataFrame([(1, 1, 0.99), (1, 2, 0.01), (2, 3, 0.99), (2, 4, 0.5), (3, 1, 0.98)], "eid long, cid long, p double")
    assert sorted(map(tuple, collective.pseudo_labels(p, "p").collect())) == [(1, 1, 1), (1, 2, 0)]


def test_lists_round_trip(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",), ('c"x',)], "eid string")
    pairs = spark.createDataFrame([("a", "z"), ("a", "y"), ("a", "y")], "eid string, cid string")
    lists = files.match_lists(ids, pairs)
    files.write_tsv(lists, str(tmp_path / "out"))
    back = files.read_tsv(spark, str(tmp_path / "out"), ["eid", "matched_entity_ids"])
    assert {tuple(r) for r in back.collect()} == {("a", "y,z"), ("b", ""), ('c"x', "")}
    assert {tuple(r) for r in labels.truth(back, "eid", "matched_entity_ids").collect()} == {("a", "y"), ("a", "z")}
    changed = collective.rewrite(lists, files.match_lists(ids, pairs.filter("cid = 'z'")), ids.filter("eid = 'a'"), "eid", "matched_entity_ids")
    assert {tuple(r) for r in changed.collect()} == {("a", "z"), ("b", ""), ('c"x', "")}


def test_tsv_keeps_quotes_and_blanks(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\t"Foo" Bar\t\tUS \n2\ta"b\t<NULL>\t\n')
    rows = {r.entity_id: tuple(r) for r in files.read_tsv(spark, str(tmp_path / "x.tsv")).collect()}
    assert rows["1"] == ("1", '"Foo" Bar', "", "US ") and rows["2"][1:] == ('a"b', "<NULL>", "")


def test_dense_ids(spark):
    df = spark.range(1000).selectExpr("concat('id', 1000 + id) AS entity_id").repartition(7)
    got = sorted((r.entity_id, r.eid) for r in files.with_ids(df, 2).collect())
    assert [e for _, e in got] == [100_000_000 + i for i in range(1000)]


def test_kept_is_computed_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.kept(spark, str(tmp_path / "t"), make).count() == 3
    assert len(calls) == 1


@pytest.mark.parametrize("rows", [[], CAND])
def test_empty_side(spark, rows):
    assert blocking.Blocking(rec(spark, []), rec(spark, rows)).ranked.count() == 0
