import pytest

from weftline.llm import mix

DOCS = "doc_id long, text string, source string, lang string, times int"
TARGETS = "source string, target_share double, max_repeats int"


def make(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*x, 0) for x in docs], DOCS).repartition(3)
    return mix.Mix(d, spark.createDataFrame(targets, TARGETS), **kw)


def corpus(**n):
    i, out = 0, []
    for s, k in n.items():
        for j in range(k):
            out.append((i, "one two three four five", s, ["en", "de", None][j % 3]))
            i += 1
    return out


def test_shares_are_met_within_repeats(spark):
    docs = corpus(a_x=900, a_y=60, b_z=300, other=50) + [(9001, None, "a_x", "en"), (9002, "", "a_x", "en"), (9003, "text", None, "en")]
    targets = [("a_x", 0.5, 1), ("a_y", 0.2, 5), ("b_z", 0.25, 2), ("gone", 0.05, 3), (None, 0.5, 1), ("other", 0.0, 9)]
    m = make(spark, docs, targets)
    rows = m.selection().collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(1 <= r.times <= {"a_x": 1, "a_y": 5, "b_z": 2}[r.source] for r in rows)
    shares = {r.source: r for r in m.shares().collect()}
    for s, w in (("a_x", 0.5), ("a_y", 0.2), ("b_z", 0.25)):
        assert abs(shares[s].actual_share - w / 0.95) < 0.01
    assert shares["gone"].actual_share == 0 and shares["other"].actual_share == 0
    again = make(spark, docs, targets).selection().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    other = make(spark, docs, targets, seed=2).selection().collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, rows))


def test_shortage_goes_to_siblings_first(spark):
    docs = corpus(a_x=10, a_y=1000, b_z=1000)
    targets = [("a_x", 0.25, 2), ("a_y", 0.25, 2), ("b_z", 0.5, 2)]
    m = make(spark, docs, targets, budget=5 * 1000)
    shares = {r.source: r.actual_share for r in m.shares().collect()}
    assert abs(shares["a_x"] - 0.02) < 0.01 and abs(shares["a_y"] - 0.48) < 0.01 and abs(shares["b_z"] - 0.5) < 0.01


def test_budget_beyond_all_rooms(spark):
    m = make(spark, corpus(a_x=10, b_z=20), [("a_x", 0.9, 2), ("b_z", 0.1, 3)], budget=1e12)
    got = {}
    for r in m.selection().collect():
        got.setdefault(r.source, set()).add(r.times)
    assert got == {"a_x": {2}, "b_z": {3}}


def test_empty(spark):
    assert make(spark, [], [("a", 1.0, 1)]).selection().count() == 0
    m = make(spark, corpus(a=3), [])
    assert m.selection().count() == 0
    assert [r.actual_share for r in m.shares().collect()] == [0.0]


@pytest.mark.parametrize(
    "budget,weights,rooms,want",
    [(10, [1, 1], [100, 100], [5, 5]), (10, [1, 1], [2, 100], [2, 8]), (10, [1, 3], [2, 3], [2, 3]), (10, [0, 1], [100, 4], [6, 4]), (0, [1], [5], [0])],
)
def test_water_fill(budget, weights, rooms, want):
    assert mix.water_fill(budget, weights, rooms) == pytest.approx(want)
