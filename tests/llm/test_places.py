import itertools
import random

from weftline.llm import places

COLS = "eid long, a_words string, a_nums string, location string, town string, key string"


def word(r, n):
    return "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") + r.choice(["", "n", "r", "l"]) for _ in range(n))


def corpus(seed=0):
    r = random.Random(seed)
    rows, place = [], {}
    for t in range(8):
        town, region, code = word(r, 4), word(r, 2)[:3], str(r.randint(10000, 99999))
        for s in range(6):
            street, kind = word(r, 4), r.choice(["st", "rd", "ave"])
            for h in range(4):
                no = str(r.randint(1, 900))
                for k in range(r.randint(1, 3)):
                    w, u = f"{street} {kind} {town} {region}", f"{no} {code}"
                    if k == 1:
                        w, u = f"unit {w}", f"7 {u}"
                    if k == 2:
                        w, u = f"{town} {region} {street} {kind}", f"{code} {no}"
                    place[len(rows)] = (t, s, no)
                    rows.append((len(rows), w, u))
    return rows, place


def pairs(spark, rows):
    df = spark.createDataFrame([(*x, "x", "y", "z") for x in rows], COLS)
    got = [tuple(x) for x in places.same_location(df).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def test_gazetteer(spark):
    rows, place = corpus()
    town = [f"x{i}" for i in range(0)]
    more = {
        5000: ("galhevapi st berpormirpol map", "342 55555"),
        5001: ("flr galhevapi strt berpormirpol map", "24 342 55555"),
        5002: ("galheapi st berpormirpol", "342 55555"),
        5003: ("galhevapist nr petrol pump berpormirpol map", "342 555 55"),
        5004: ("berpormirpol map galhevapi st", "55555 342"),
        5005: ("galhevapi map", "342 55555"),
        5010: ("galhevapi st berpormirpol map", "346 55555"),  # another number
        5011: ("galhevapi rd berpormirpol map", "342 55555"),  # another kind of street
        5012: ("old garden st berpormirpol map", "342 55555"),
        5013: ("old gardne st berpormirpol map", "342 55555"),
        5014: ("new garden st berpormirpol map", "342 55555"),  # another street
        5015: ("garden st berpormirpol map", "342 55555"),  # another street
        5020: (None, "342 55555"),
        5021: ("", ""),
        5022: ("unit berpormirpol map", "7"),
    }
    rows = rows + [(k, *v) for k, v in more.items()] + [(5000, *more[5000])] + town
    got = pairs(spark, rows)
    want = {(a, b) for a, b in itertools.combinations(sorted(place), 2) if place[a] == place[b]}
    assert {p for p in got if p[1] >= 5000} == set(itertools.combinations(range(5000, 5006), 2)) | {(5012, 5013)}
    own = {p for p in got if p[1] < 5000}
    assert len(want & own) > 0.97 * len(want) and len(own - want) < 0.03 * len(want)


def test_directions_differ():
    assert places.split_forms([("st", "n", 3), ("st", "s", 2), ("st", "", 1), ("", "s", 1)]) == [0, 1, 0, 1]


def test_empty_and_long(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [(1, None, None), (2, "", ""), (3, "st", "5")]) == set()
    assert pairs(spark, [(1, "w " * 2000, "1 " * 2000), (2, "w " * 2000, "1 " * 2000)]) is not None


def test_reading():
    a = places.Address("unit n great granary raod nr bank depot town abc", "12 85 56650")
    assert ([x for _, x in a.rest], a.regions, [k[2] for k in a.kinds], a.dirs, a.codes) == (["great", "granary", "town"], ["abc"], ["rd"], ["n"], ["56650"])
    assert a.numbers(set(), a.rest[0][0]) == ["85", "12"]
    assert places.Address("granary st town door", "85 12").numbers(set(), 0)[0] == "85"
    assert places.Address("shop fourteen granary st town", "4").numbers(set(), 2)[0] == "14"
    assert places.kind_of("sreet") == "st" and places.kind_of("avneue") == "ave" and places.kind_of("park") is None
    assert ("833064", "833", "64") in places.joined_codes(["833", "64", "350"])


def test_house_number_among_others():
    a = places.Address("town abc flr granary st", "22014 3151 61 39")  # a code with its extension, a floor, the house
    assert a.numbers(set(), 3)[0] == "39" and "3151" not in a.house
    assert places.Address("shop 59b granary st", "12 59").numbers(set(), 2)[0] == "59"
    many = places.Address("granary st", " ".join(map(str, range(1, 40))))
    assert len(many.numbers(set(), 0)) == 39  # none is dropped before the beam


def test_street_readings():
    def read(w):
        a = places.Address(w, "1")
        return a.streets(a.rest)

    assert read("st orchard col")[0][:2] == ("st orchard", "col") and read("orchard st")[0][:2] == ("orchard", "st")
    assert [r[:2] for r in read("st river")] == [("st river", ""), ("river", "st")]
    assert [r[:2] for r in read("canalrd")] == [("canal", "rd"), ("canalrd", "")]
    assert [r[:2] for r in read("terlasfurhun")] == [("terlasfurhun", ""), ("lasfurhun", "ter")]
    assert read("rue de la river")[0][:2] == ("river", "r")


def test_further_directions_and_missing_ones():
    assert places.Address("n w granary st", "1").dirs == ["n", "w"]
    # as many or half without a direction: it was left out; twice as many: the street without one
    assert places.split_forms([("st", "n", 2), ("st", "", 2)]) == [0, 0]
    assert places.split_forms([("st", "n", 2), ("st", "", 4)]) == [0, 1]


def test_glued_direction_and_word_that_names_no_town(spark):
    rows, _ = corpus(3)
    more = {7000: ("e harbour rd berpormirpol map", "12 55555"), 7001: ("eharbour rd berpormirpol map", "12 55555"), 7002: ("e harbour rd berpormirpol", "12 55555"), 7003: ("harbour rd e berpormirpol map", "12 55555")}
    more |= {7010 + i: (f"upper {w} st {t}", f"{i + 20} {c}") for i, (w, t, c) in enumerate(zip(["mill", "park", "lake", "gate"] * 3, ["berpormirpol"] * 6 + ["sonkirvaltes"] * 6, ["55555"] * 6 + ["66666"] * 6))}
    got = pairs(spark, rows + [(k, *v) for k, v in more.items()])
    assert {p for p in got if 7000 <= p[0] < 7010} == set(itertools.combinations(range(7000, 7004), 2))
    assert not [p for p in got if p[0] >= 7010]
