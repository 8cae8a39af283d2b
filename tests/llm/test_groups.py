from weftline.llm.groups import over_groups


def test_each_group_once_and_whole(spark):
    df = spark.range(5000).selectExpr("concat('k', id % 700) AS k", "id AS v", "'x' AS other")
    got = over_groups(df, ["k"], ["v"], lambda key, rows: [(*key, len(rows), sum(v for (v,) in rows))], "k string, n int, total long").collect()
    assert len(got) == 700 and sum(r.n for r in got) == 5000 and sum(r.total for r in got) == sum(range(5000))
    assert over_groups(df.limit(0), ["k"], ["v"], lambda key, rows: [], "k string, n int, total long").count() == 0
