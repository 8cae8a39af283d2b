import itertools
import random

import numpy as np
import pytest

from weftline.llm import match, sketch

COLS = "eid long, n_core string, a_words string, a_nums string, country string, conf double, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.0, "x") for r in rows], COLS)


def run(spark, one, other, **kw):
    return {(r.eid, r.cid) for r in match.match(frame(spark, one), [frame(spark, other)], **kw).collect()}


ONE = [
    (1, "royal vulbarzarzal packaging", "forest rd selmupuka biz", "41 336087", "india"),
    (2, "zanzarsurrul florist", "s kondismoski ngr murnilgunto sov", "537 346068", "india"),
    (3, "sm rulirsensir packaging", "w nolsorlosbul ave hagubesful duh", "888 93869", "us"),
    (4, "dosvumulves hardware", "granary st susgiszurro hes", "26 12630", None),
    (5, None, "granary st susgiszurro hes", "26 12630", "us"),
    (6, "", "", "", ""),
]


def test_records_of_one_business(spark):
    other = [
        (101, "royal vulbarzarzal packaging", "h forest rd selmupuka biz", "41 336087", "india"),
        (102, "royal vulbarzarzal packagng", "forest rod selmupuka", "41 336 87", "bharat"),
        (102, "royal vulbarzarzal packagng", "forest rod selmupuka", "41 336 87", "bharat"),
        (103, "royal vulbarzarzal packaging", "old garden st other", "77 111222", "india"),  # another place
        (104, "zanzarsurrul flor", "kondismoskingr s murmilgunto sov", "537 346068", ""),
        (105, "zanzarsurrul florist", "s kondismoski ngr murnilgunto sov", "537 346068", "fr"),  # another country
        (106, "packaging rulirsensir sm", "nolsorlosbulave w hagubesful duh", "27 888 93869", "usa"),
        (107, "dosvumulves hardware", None, None, "us"),  # no address
        (108, "quite another name", "granary st susgiszurro hes", "26 12630", "us"),
        (109, None, None, None, None),
        (110, "dosvumulves hardware", "granary st susgiszurro hes", "28 12630", "us"),  # another number
    ]
    assert run(spark, ONE, other) == {(1, 101), (1, 102), (2, 104), (3, 106), (4, 107)}


def test_a_record_goes_to_one_business(spark):
    one = [(1, "alpha beta gamma", "main st town", "5 12345", "us"), (2, "alpha beta gamma", "main st town", "5 12345", "us")]
    assert run(spark, one, [(9, "alpha beta gamma", "main st town", "5 12345", "us")]) == {(1, 9)}


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, ONE, []) == set()


def made_word(i):
    return "".join("bdfgklmnpr"[int(c)] + "aeiou"[int(c) % 5] for c in f"{i * 7919 % 10_000:04d}")


def made(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(3, 5)))
    one, other = [], []
    for i in range(n):
        name, street, town, no, code = [word(), r.choice(["foods", "tools"])], word(), word(), str(r.randint(1, 999)), str(r.randint(10000, 99999))
        one.append((i, " ".join(name), f"{street} st {town}", f"{no} {code}", "us"))
        for _ in range(r.randint(0, 3)):
            x = list(name[0])
            x[r.randrange(len(x))] = r.choice("aeioubdf")
            other.append((1000 + len(other), " ".join(["".join(x), name[1]]), f"{street} st {town}", f"{no} {code}", "us"))
    return one, other


@pytest.mark.parametrize("parts", [1, 5])
def test_windows_against_all_pairs(spark, parts):
    one, other = made(parts, 150)
    got = run(spark, one, other, parts=parts, run_rows=97)
    rows = one + other
    rec = match.Records(*[[r[k] for r in rows] for k in (1, 2, 3, 4)], match.common_digests({"foods", "tools"}), match.common_digests({"st"}))
    best = {}
    for j in range(len(one), len(rows)):
        conf = rec.confidence(np.arange(len(one)), np.full(len(one), j))
        if conf.max() >= match.LEAST:
            best[rows[j][0]] = rows[int(conf.argmax())][0]
    want = {(e, c) for c, e in best.items()}
    assert len(want & got) >= 0.97 * len(want) and not got - want


def test_one_key_in_all_rows(spark):
    one = [(i, "same name", f"{made_word(i)} st town", f"{i} 12345", "us") for i in range(400)]
    other = [(1000 + i, "same name", f"{made_word(i)} st town", f"{i} 12345", "us") for i in range(400)]
    got = run(spark, one, other, parts=3)
    assert len(got & {(i, 1000 + i) for i in range(400)}) >= 396


@pytest.mark.parametrize("block_rows", [400, 20])
def test_long_runs_of_equal_keys(spark, monkeypatch, block_rows):
    """One name without house numbers in all rows; added words and misspelt ones part the partners in the sort order."""
    monkeypatch.setattr(match.run_pairs, "__defaults__", (block_rows,))
    r = random.Random(9)
    one = [(i, "same name", f"{made_word(i)} st {made_word(5000 + i)} qu", "", "us") for i in range(300)]
    other = [(1000 + i, "same name", f"{r.choice(['a', 'z'])}{made_word(9000 - i)}xx {made_word(i)} st {made_word(5000 + i)}", "", "us") for i in range(300)]
    got = run(spark, one, [*other, (2000, "same name", "", "", "us")], parts=3, run_rows=97)
    assert {(i, 1000 + i) for i in range(300)} | {(0, 2000)} == got


def test_sketch():
    s = sketch.sketches([b"abcdef", b"abcdef", b"xyz", b"", b"a"])
    d, o = sketch.dice_and_overlap(s[[0, 0, 3, 0]], s[[1, 2, 4, 3]])
    assert d.tolist() == [1, 0, 0, 0] and o.tolist() == [1, 0, 0, 0]


def test_numbers():
    assert match.house_and_code("shop y1e 9b7", "535 1 9 7") == (["535"], [])
    assert match.house_and_code("22a tower eighteen", "22 742052") == (["22", "18"], ["742052"])


def test_bones():
    assert match.bones("zanzarsurrul") == match.bones("sansarsurul")
    assert all(a == b for a, b in itertools.pairwise([match.bones("philip"), match.bones("filip")]))


def test_words():
    w = match.Words(["ab  12 c", "", " 7", "x" * 80])
    assert w.word_row.tolist() == [0, 0, 0, 2, 3] and w.size.tolist() == [2, 2, 1, 1, 80]
    d = match.Words(["12", "c", "ab"]).digests()
    assert w.digests()[[1, 2, 0]].tolist() == d.tolist()
    u = match.Words(["12 345 67890", "", "7"])
    assert u.numbers(u.size < 5, 3).tolist() == [[12, 345, -1], [-1, -1, -1], [7, -1, -1]]
    assert u.numbers(u.size >= 5, 2).tolist() == [[67890, -1], [-1, -1], [-1, -1]]
    rare = match.Words(["alpha foods", "foods"]).rare_sketch(match.common_digests({"foods"}))
    assert (rare == match.Words(["alpha", "foods"]).sketch()).all()
    assert match.Words([]).n == 0


def test_all_numbers_and_unknown_labels_count():
    many = " ".join(map(str, range(100, 140)))
    rec = match.Records(["alpha bakery"] * 3, ["main street town"] * 3, [many, "139", "7"], ["", "", ""], match.common_digests(set()), match.common_digests(set()))
    a, b = rec.confidence(np.array([0, 0]), np.array([1, 2]))
    assert a > 0.8 > b


def test_unknown_country_label_separates_nothing(spark):
    cols = "eid long, n_core string, a_words string, a_nums string, country string"
    one = spark.createDataFrame([(1, "alpha bakery", "main st town", "5 12345", "us"), (2, "beta tools", "oak rd city", "7 54321", "us")], cols)
    two = spark.createDataFrame([(11, "alpha bakery", "main st town", "5 12345", "U S of A"), (12, "beta tools", "oak rd city", "7 54321", "france")], cols)
    assert [(r.eid, r.cid) for r in match.match(one, [two]).collect()] == [(1, 11)]
