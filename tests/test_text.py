import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions import batch
from weftline.functions import similarity as S
from weftline.functions import text as T


@pytest.mark.parametrize(
    "raw,want",
    [("भारत", "bharat"), ("राम", "ram"), ("कमल", "kamal"), ("दिल्ली", "dilli"), ("১২৩", "123"), ("abc", "abc"), ("अंक", "ank"), ("के", "ke")],
)
def test_transliterate(raw, want):
    assert T.transliterate(raw) == want


def test_fold():
    assert T.fold("Société Générale ŒUVRE ß") == "societe generale oeuvre ss"
    assert T.fold("ＡＢＣ") == "abc" and T.fold("भारत", {"bharat": "india"}) == "india"


def test_lookalikes():
    for a, b in (("8ig", "big"), ("sta1der", "stalder"), ("1st", "1st"), ("12", "12"), ("12b", "12b"), ("1a23", "1a23"), ("tran5port", "transport")):
        assert T.undo_lookalikes(a) == b


def test_initials_and_skeleton():
    assert T.merge_initials("e u r l dupont j p".split()) == ["eurl", "dupont", "jp"]
    assert [T.skeleton(x) for x in ("phone", "wave", "jack", "box", "123", "aaa", "hello", "")] == ["fn", "v", "jk", "bks", "123", "a", "hl", ""]


def test_names():
    assert T.name_features("Café Noir Pvt. Ltd.") == ("cafe noir private limited", "cafe noir", "limited private")
    assert T.name_features("www.mega-advisors.com Paris")[0] == "mega advisors"
    assert T.name_features("Foo & Sons a/k/a Bar")[1] == "foo sons bar"
    assert T.name_features("Dupont E.U.R.L.") == ("dupont eurl", "dupont", "eurl")
    assert T.name_features(None) == ("", "", "")


def test_segment():
    cost = {"mega": 3.0, "advisors": 4.0, "ad": 1.0, "visors": 9.0}
    assert T.segment("megaadvisors", cost) == ["mega", "advisors"]
    assert T.segment("mega", cost) is None and T.segment("xyz", cost) is None
    assert T.split_glued("megaadvisors", cost) == ["mega", "advisors"] and T.split_glued("mega12x", cost) == ["mega12x"]


def test_addresses():
    assert T.address_features("12 Saint John Street, New York <NULL>") == ("12 st john st ny", "st john st ny", "12")
    assert T.address_features("Apt 007-B, Bombay, Maharashtra") == ("unit 007 b mumbai mh", "unit b mumbai mh", "7")
    assert T.address_features("000") == ("000", "", "0") and T.address_features(None) == ("", "", "")


texts = st.text("abc d", max_size=12)


@settings(max_examples=300, deadline=None)
@given(texts, texts)
def test_similarities_are_symmetric_and_bounded(a, b):
    for f in (S.ratio, S.token_sort_ratio, S.token_set_ratio, S.partial_ratio):
        assert f(a, b) == pytest.approx(f(b, a)) and 0 <= f(a, b) <= 100
    assert 0 <= S.jaro_winkler(a, b) <= 1
    assert S.ratio(a, a) == 100


def lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


@settings(max_examples=300, deadline=None)
@given(texts, texts)
def test_against_plain_definitions(a, b):
    assert S.common_subsequence(a, b) == lcs(a, b)
    x, y = sorted((a, b), key=len)
    if x:
        both = ((x, y), (y, x)) if len(x) == len(y) else ((x, y),)
        windows = [(p, q[max(0, e - len(p)) : min(e, len(q))]) for p, q in both for e in range(1, len(q) + len(p))]
        assert S.partial_ratio(a, b) == pytest.approx(max(200 * lcs(p, w) / (len(p) + len(w)) for p, w in windows))


def test_jaro_winkler_and_levenshtein_as_in_sql():
    import duckdb

    r = random.Random(1)
    con = duckdb.connect()
    for _ in range(300):
        a, b = ("".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(2))
        jw, lev = con.execute("SELECT jaro_winkler_similarity(?, ?), levenshtein(?, ?)", [a, b, a, b]).fetchone()
        assert S.jaro_winkler(a, b) == pytest.approx(jw) and S.levenshtein(a, b) == lev


def test_token_set():
    assert S.token_set_ratio("a b", "a b c") == 100 and S.token_set_ratio("", "a") == 0
    assert S.token_sort_ratio("b a", "a b") == 100


def test_covered():
    assert S.covered(["metals", "xyz"], ["metal"]) == (0.5, ["xyz"])
    assert S.covered([], ["a"]) == (0.0, [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=8), st.sampled_from(["", "é😀\0", "".join(map(chr, range(1000, 1300)))]))
def test_batches_give_the_same_numbers(pairs, more):
    xs, ys = [x + more for x, _ in pairs], [y for _, y in pairs]
    for many, each in ((batch.ratios, S.ratio), (batch.token_sort_ratios, S.token_sort_ratio), (batch.token_set_ratios, S.token_set_ratio), (batch.jaro_winklers, S.jaro_winkler), (batch.levenshteins, S.levenshtein)):
        assert many(xs, ys).tolist() == [each(x, y) for x, y in zip(xs, ys)]
    assert [v.tolist() for v in batch.ratios_and_partial(xs, ys)] == [[f(x, y) for x, y in zip(xs, ys)] for f in (S.ratio, S.partial_ratio)]
    lists = [(x.split(), y.split()) for x, y in zip(xs, ys)]
    assert batch.covered(lists) == [S.covered(*p) for p in lists]


def test_alias_parts_are_read_by_themselves():
    assert T.name_tokens("Smith J aka K Jones Foods") == ["smith", "j", "k", "jones", "foods"]
    assert T.name_tokens("A B C dba D E Foods") == ["abc", "de", "foods"]
