import math
import random

import pytest

from weftline.llm import topn

SCHEMA = "eid long, cid long, bscore double, rk int"


def brute(data, n):
    best = {}
    for e, c, s, _ in data:
        if e is None or c is None or s is None or math.isnan(s):
            continue
        best[e, c] = max(best.get((e, c), -math.inf), s)
    out = set()
    for e in {e for e, _ in best}:
        items = sorted((-s, c) for (x, c), s in best.items() if x == e)
        out |= {(e, c, i + 1) for i, (_, c) in enumerate(items[:n])}
    return out


@pytest.mark.parametrize("run_rows", [7, 100, 10_000])
def test_against_brute_force(spark, run_rows):
    r = random.Random(run_rows)
    data = [
        (0 if r.random() < 0.4 else r.choice([None, *range(40)]), r.choice([None, *range(60)]), r.choice([None, math.nan, math.inf, 0.0, -0.0, r.randint(0, 9) / 3]), 5)
        for _ in range(3000)
    ]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {(x.eid, x.cid, x.rk) for x in topn.top_n(df, "eid", "cid", "bscore", 8, run_rows).collect()}
    assert got == brute(data, 8)


def test_empty_and_small(spark):
    assert topn.top_n(spark.createDataFrame([], SCHEMA), "eid", "cid", "bscore", 8).count() == 0
    one = spark.createDataFrame([(1, 2, 0.5, 0), (1, 2, 0.7, 0), (1, 3, None, 0)], SCHEMA)
    assert [tuple(x) for x in topn.top_n(one, "eid", "cid", "bscore", 8).collect()] == [(1, 2, 0.7, 1)]
    with pytest.raises(ValueError):
        topn.top_n(one, "eid", "cid", "bscore", 0)
