import itertools
import random

from weftline.llm import canon, names

COLS = "eid long, n_core string, org string, root string, word string"
GIVEN = ["joseph", "margaret", "dominique", "katherine", "venkatesh", "oscar", "harold", "theodore"]
LINES = "photo stationery garments hardware florist optical catering bakery timber cables pumps tiles textiles roofing laundry dental decor motors".split()
LINES += "jewels farms seeds tools metals glass plastics graphics".split()


def word(r, n):
    return "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") + r.choice(["", "n", "r", "l"]) for _ in range(n))


def corpus(seed=0, orgs=330):
    """Organisations with clean names, so that the words have their company; ids in order."""
    r = random.Random(seed)
    rows, org = [], {}
    for o in range(orgs):
        core, given, line = word(r, 4), r.choice(GIVEN), r.choice(LINES)
        for k in range(r.randint(2, 4)):
            name = [given, core, line, "enterprises"]
            if k == 1:
                name = [given, core, line]
            if k == 2:
                name = [core, given, line, "enterprises"]
            org[len(rows)] = o
            rows.append((len(rows), " ".join(name)))
    return rows, org


def pairs(spark, rows):
    df = spark.createDataFrame([(*x, "x", "y", "z") for x in rows], COLS)
    got = [tuple(x) for x in names.same_organisation(df).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def test_variants_and_other_organisations(spark):
    rows, org = corpus()
    more = {
        1000: "joseph nalkavondos photo enterprises",
        1001: "joseph nalkavondos photo enterprises",
        1002: "joseph nalkavvondos photo",
        1003: "photo nalkavondos joseph enterprises unit",
        1004: "josephnalkavondos photo",
        1005: "j nalkavondos photo",
        1006: "nalkav ondos photo enterprises",
        1010: "margaret nalkavondos photo enterprises",  # another given name
        1011: "joseph nalkavondos bakery enterprises",  # another line of business
        1020: None,
        1021: "",
        1022: "  ",
    }
    got = pairs(spark, rows + list(more.items()) + [(1000, more[1000])])
    same = list(range(1000, 1007))
    want = {(a, b) for a, b in itertools.combinations(sorted(org), 2) if org[a] == org[b]} | set(itertools.combinations(same, 2))
    assert {p for p in got if p[0] >= 1000} == set(itertools.combinations(same, 2))
    assert len(want & got) > 0.97 * len(want) and len(got - want) < 0.03 * len(want)


def test_readings_of_a_token(spark):
    """A piece of a coined word that looks like a word, a given name and a line of business glued to it: what others write decides."""
    rows, _ = corpus(2)
    more = {5000: "joseph sonkirvestal photo", 5001: "joseph son kirvestal photo", 5002: "josephsonkirvestal photo", 5003: "joseph sonkirvestalphoto"}
    more |= {5020: "harold velkinros dartumas pumps", 5021: "harold dartumas velkinros pumps", 5022: "harold dartumsa velkinrso pumps"}
    got = pairs(spark, rows + list(more.items()))
    same = [(5000, 5004), (5020, 5023)]
    assert {p for ids in same for p in itertools.combinations(range(*ids), 2)} <= got
    assert not [p for p in got if p[0] < 5000 <= p[1] or (p[0] >= 5000 and p[0] // 10 != p[1] // 10)]


def test_consonants_alone_make_no_word():
    v = names.Vocabulary([("glass", 50, 0, 40), ("photo", 50, 0, 40), ("yves", 50, 45, 40)], 1000)
    assert v.readings("gilsusheses photo") == [[names.COINED + "gilsusheses", "photo"]]
    assert v.readings("yvesmarkundol")[1] == ["yves", names.COINED + "markundol"]
    assert v.parse("gls mr markundol 12 ph0to")[2] == ["glass", "photo"]


def test_long_texts_have_few_keys():
    assert len(canon.deletions("b" + "dk" * 500)) == 3 and len(canon.keys_of("wort " * 3000)) < 100
    a, b = "bdkl" * 20, "bdkl" * 12 + "bdk" + "bdkl" * 7  # one letter left out of the second half
    assert canon.deletions(a) & canon.deletions(b)


def test_organisation_with_a_third_of_all_rows(spark):
    """Its coined word stands beside many misspellings of its other words and is a core all the same."""
    r = random.Random(5)
    rows, _ = corpus(1)
    given, line = GIVEN[0], "catering"
    for i in range(len(rows) // 2):
        words = [w for w in (given, "mobreldastun", line, "enterprises") if w == "mobreldastun" or r.random() < 0.8]
        if len(words) < 2:
            words.append(line)
        if r.random() < 0.3:
            k = r.choice([k for k, w in enumerate(words) if w != "mobreldastun"])
            words[k] = words[k][:3] + r.choice("bdfgklmn") + words[k][4:]
        rows.append((5000 + i, " ".join(words)))
    rows += [(9000, f"{given} mobreldastun {line}"), (9001, f"mobreldastun {line}"), (9002, f"{given} {line}"), (9003, f"{given} mobreldastun bakery")]
    got = pairs(spark, rows)
    assert (9000, 9001) in got and not {(9000, 9002), (9001, 9002), (9000, 9003), (9002, 9003)} & got
    big = [i for i, _ in rows if 5000 <= i < 9000]
    assert len([p for p in got if p[0] in big and p[1] in big]) > 0.9 * len(big) * (len(big) - 1) / 2


def test_small_and_empty_tables(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [(1, None), (2, "")]) == set()
    assert pairs(spark, [(1, "zarolmelses security"), (2, "zarolmelses security"), (3, "other name"), (2, "zarolmelses security")]) == {(1, 2)}
    assert pairs(spark, [(1, "w " * 3000), (2, "w " * 3000)]) == {(1, 2)}


def test_all_spellings_of_a_block_are_compared(spark):
    """The right form stands behind a better and before many other texts of the same consonants."""
    fill = ["kulemetuno", "kolumotine", "kelomuteni", "kiloumetane", "kulamitenu", "kolimeteno", "kelamutoni", "kulomatine", "kilumotena"]
    rows = [("", "kulemitani", 200), ("", "kalimatoro", 100), *[("", f.replace("n", "r"), 50 - i) for i, f in enumerate(fill)], ("", "kalimatoru", 1)]
    root = {r.core: r.root for r in canon.attach(spark.createDataFrame([(p, c.replace("n", "r"), k) for p, c, k in rows], "part string, core string, k long")).collect()}
    assert root["kalimatoru"] == root.get("kalimatoro", "kalimatoro")


def test_channel():
    assert names.is_abbreviation("gmts", "garments") and names.is_abbreviation("prtg", "printing") and names.is_abbreviation("flor", "florist")
    assert not names.is_abbreviation("tools", "tiles") and not names.is_abbreviation("garments", "gmts")
    assert canon.edits("photo", "phoot", 2) == 1 and canon.edits("abc", "xyz", 2) == 3 and canon.edits("a", "abcdef", 2) == 3


def test_attribution():
    forms = [("joseph", "photo", "", 5), ("", "photo", "", 1), ("mary", "photo", "", 2), ("joseph", "", "", 1), ("joseph", "bakery", "", 1), ("", "photo", "j", 1)]
    at = names.attribute(forms)
    assert at[0] == at[1] == at[3] == at[5] and len({at[0], at[2], at[4]}) == 3
