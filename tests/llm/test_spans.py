import random

import pytest

from weftline.llm import spans

SCHEMA = "doc_id long, text string, h int, pos int, doc string"


def brute(docs, least):
    grams = {d: {t[i : i + least] for i in range(len(t) - least + 1)} for d, t in docs if t}
    ids = sorted(grams)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if grams[a] & grams[b]}


def found(spark, docs, least=200, **kw):
    df = spark.createDataFrame([(d, t, 0, 0, "x") for d, t in docs], SCHEMA).repartition(3)
    rows = [tuple(r) for r in spans.shared_span_pairs(df, min_chars=least, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def text(r, n, letters="abcdefgh é’°"):
    return "".join(r.choice(letters) for _ in range(n))


def test_runs_at_the_bound(spark):
    r = random.Random(1)
    docs = []
    for n in (150, 198, 199, 200, 201, 230, 390):
        run = text(r, n)
        for k in range(3):
            docs.append((len(docs), text(r, r.randint(0, 300)) + run + text(r, r.randint(0, 300))))
    docs += [(1000, None), (1001, ""), (1002, "short"), (1003, docs[9][1]), (1004, docs[9][1])]
    got = found(spark, docs)
    assert got == brute(docs, 200)
    assert (1003, 1004) in got


def test_stock_phrase_in_many(spark):
    r = random.Random(2)
    phrase, longer = text(r, 190), text(r, 205)
    docs = [(i, text(r, 120) + phrase + text(r, 120)) for i in range(70)]
    docs += [(100 + i, text(r, 50) + longer + text(r, 50)) for i in range(60)]
    assert found(spark, docs) == brute(docs, 200)


def test_periodic_texts(spark):
    docs = [(0, " " * 1000), (1, "x" + " " * 250), (2, " " * 199 + "y" + " " * 199), (3, "ab" * 400), (4, "ba" * 101), (5, "abc" * 200), (6, "ab" * 90)]
    assert found(spark, docs) == brute(docs, 200)


def test_blocks_of_long_texts(spark):
    r = random.Random(3)
    runs = [text(r, 200 + 7 * i) for i in range(20)]
    docs = [(0, "".join(text(r, 900) + x for x in runs)), *[(1 + i, text(r, 100) + x + text(r, 300)) for i, x in enumerate(runs)]]
    assert found(spark, docs, block_bytes=4000) == brute(docs, 200)


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_share(spark):
    r = random.Random(4)
    run = text(r, 1000)
    docs = [(0, run + text(r, 1000)), (1, run), (2, text(r, 500)), (3, None), (4, ""), (5, "copy " * 60), (6, "copy " * 60)]
    df = spark.createDataFrame([(d, t, 0, 0, "x") for d, t in docs], SCHEMA)
    got = {x.doc_id: x for x in spans.shared_share(df).collect()}
    assert len(got) == 7 and got[3].shared_chars is None and got[4].shared_chars == 0 and got[2].shared_chars == 0
    assert 800 <= got[0].shared_chars <= 1000 and 800 <= got[1].shared_chars <= 1000
    assert got[5].shared_chars == got[5].n_chars == 300


def test_share_is_exact(spark):
    """Stock phrases under the bound, runs at it, many holders, repeats in one text and copies, against all windows."""
    r = random.Random(6)
    phrase, longer, stock, wide = text(r, 150), text(r, 200), text(r, 240), text(r, 310, "éà’°漢字")
    docs = [(i, text(r, 90) + phrase + text(r, 90)) for i in range(6)]
    docs += [(10 + i, text(r, 40 + i) + longer + text(r, 30)) for i in range(3)]
    docs += [(100 + i, text(r, 60) + stock[: 200 + i % 41] + text(r, 60)) for i in range(60)]
    docs += [(200 + i, text(r, 60) + wide + text(r, 60)) for i in range(3)] + [(300, longer + wide + text(r, 20)), (301, "ab" * 300), (302, "x" + "ab" * 150)]
    df = spark.createDataFrame([(d, t, 0, 0, "x") for d, t in docs], SCHEMA).repartition(3)
    got = {x.doc_id: x.shared_chars for x in spans.shared_share(df).collect()}
    held = {}
    for d, t in docs:
        for i in range(len(t) - 199):
            held.setdefault(t[i : i + 200], set()).add(d)
    want = {d: len({k for i in range(len(t) - 199) if len(held[t[i : i + 200]]) > 1 for k in range(i, i + 200)}) for d, t in docs}
    assert got == want and want[0] == 0 and want[10] >= 200


def test_around_the_bound_of_hot_digests(spark):
    """47, 48 and 49 holders, 4 and 5 repeats in one text, multi-byte runs of just over the bound in many texts."""
    r = random.Random(8)
    docs = []
    for n in (47, 48, 49):
        run = text(r, 203)
        docs += [(len(docs), text(r, 30) + run[k % 5 : 200 + k % 4] + text(r, 30)) for k in range(n)]
    for n in (4, 5):
        run = text(r, 201)
        docs += [(len(docs), "".join(text(r, 40) + run for _ in range(n))), (len(docs) + 1, text(r, 60) + run)]
    run = text(r, 201, "漢字仮名交文")
    docs += [(len(docs) + k, text(r, 60, "漢字仮名") + run[k % 3 :] + text(r, 60, "漢字仮名")) for k in range(52)]
    assert found(spark, docs) == brute(docs, 200)


def test_classes(spark):
    r = random.Random(9)
    run = text(r, 220)
    x, y, z = (text(r, 50) + run + text(r, 50) for _ in range(3))
    b, lone = text(r, 300), text(r, 400)
    docs = [(5, x), (3, x), (7, y), (8, z), (9, lone), (10, "short"), (11, None), (12, b), (13, b)]
    df = spark.createDataFrame([(d, t, 0, 0, "x") for d, t in docs + docs[:1]], SCHEMA)
    got = sorted(tuple(q) for q in spans.shared_span_classes(df).collect())
    assert got == [(3, 3, 2), (5, 3, 2), (7, 7, 2), (8, 8, 2), (9, 9, 0), (12, 12, 0), (13, 12, 0)]


def test_bounds():
    with pytest.raises(ValueError):
        spans.SharedSpans(None, min_chars=10)
