"""Problem 5: one postal address written differently.

Method: a self-built gazetteer. From all addresses it learns localities (a postcode and the word that most of its addresses
share), resolves the locality of each address by its words and codes, clusters the street spellings within each locality (every
spelling goes to the most frequent one that explains it) and so gives streets identifiers. Each address then spans a small
beam of readings - localities by street by which of its numbers is the house number - scored by how well the words fit, by the
order of words and numbers, and by how many other addresses the gazetteer holds there; the best reading stays. Addresses
join on the identifier of street and house number; within one house number those with another kind of street or another
direction are other locations, missing ones are no contradiction. Unit, floor and letters behind the number do not matter.

Addresses without words, or without a house number or a street, belong to no location. Repeated rows of a record count once.
Everything is keyed joins and aggregates; nothing that grows with the data is sent to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.canon import attach, deletions, edits
from weftline.llm.groups import over_groups, spread
from weftline.llm.match import NUMBER_WORDS, bones, house_and_code
from weftline.llm.sketch import dice_and_overlap, sketches
from weftline.session import cut

#: Kinds of street, by their postal abbreviation.
STREET_KINDS = {
    "st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "cres": "crescent", "pl": "place",
    "ngr": "nagar", "marg": "marg", "col": "colony", "r": "rue", "ch": "chemin", "imp": "impasse", "sq": "square", "ter": "terrace", "hwy": "highway",
}
#: Further spellings that are neither the word nor its abbreviation.
KIND_SPELLINGS = {"av": "ave", "avn": "ave", "blv": "blvd", "bd": "blvd", "boul": "blvd", "bvd": "blvd", "str": "st", "chem": "ch", "all": "ave", "crt": "ct", "drv": "dr", "roa": "rd", "rod": "rd", "ru": "r", "nagr": "ngr", "colo": "col", "mg": "marg", "strt": "st"}
#: Words before a unit number, words before a house number, words of no meaning, landmarks.
UNIT_WORDS = frozenset("unit flr floor room door shop wing apt suite ste rm".split())
NUMBER_SIGNS = frozenset("no plot h bldg nr. number house building".split())
FILLERS = frozenset("de la du des le of the ville dela".split())
#: Short words that belong to a street's name.
STREET_WORDS = frozenset("old new".split())
LANDMARK = "nr"
DIRECTIONS = frozenset("n s e w".split())

_KIND = {**{k: k for k in STREET_KINDS}, **{v: k for k, v in STREET_KINDS.items()}, **KIND_SPELLINGS}
BEAM = 6
NAME_SHARE = 0.0005
#: The share of a town's word that stands beside the town's own codes, at least.
TOWN_SHARE = 0.25
#: So many times more forms without a direction than with one are another street.
PLAIN_TIMES = 2


def kind_of(t: str, names: frozenset[str] = frozenset(), memo: dict[str, str | None] = {}) -> str | None:  # noqa: B006
    """The kind of street that a word means, if any; names are words that only look like a misspelt kind."""
    if t in _KIND:
        return _KIND[t]
    if t in names or len(t) < 4 or len(t) > 11:
        return None
    if t not in memo:
        if len(memo) > 1 << 18:
            memo.clear()
        best = min(((edits(t, full, 2 if len(full) >= 6 else 1), k) for k, full in STREET_KINDS.items() if full[0] == t[0] or full[1:3] == t[1:3]), default=(9, ""))
        full = STREET_KINDS.get(best[1], "")
        memo[t] = best[1] if best[0] <= (2 if len(full) >= 6 and len(t) >= 5 else 1) else None
    return memo[t]


class Address:
    """The tokens of an address by what they may be. rest: street or town words, with their places; kinds and units with their
    places; house: the numbers that are no code, in order; codes: postcodes."""

    def __init__(self, words: str, nums: str, names: frozenset[str] = frozenset()):
        toks: list[str] = []
        at, all_ = 0, words.split()
        while at < len(all_):  # landmarks: two words after "nr"
            if all_[at] == LANDMARK:
                at += 3
                continue
            toks.append(all_[at])
            at += 1
        own, self.nums = set(nums.split()), nums.split()
        house, self.codes = house_and_code(words, nums)
        self.spelled = [NUMBER_WORDS[t] for t in toks if t in NUMBER_WORDS]
        self.rest: list[tuple[int, str]] = []
        self.kinds: list[tuple[int, str, str]] = []
        self.units: list[int] = []
        self.regions: list[str] = []
        self.dirs: list[str] = []
        lettered = []
        for i, t in enumerate(toks):
            if t in UNIT_WORDS:
                self.units.append(i)
            elif t in NUMBER_SIGNS or t in FILLERS:
                continue
            elif t in DIRECTIONS:
                self.dirs.append(t)
            elif any(c.isdigit() for c in t):
                if t[0].isalpha() and (len(t) >= 6 or (len(t) == 3 and t[1].isdigit())):
                    self.codes.append(t)
                elif len(t) >= 5 and not t[:-1].isdigit():
                    self.rest.append((i, t))
                elif t[:-1].isdigit() and t[-1].isalpha():
                    lettered.append(t[:-1].lstrip("0") or "0")
            elif t[:1] == "v" and 4 <= len(t) <= 6 and edits(t, "ville", 1) <= 1:
                continue
            elif t.endswith("de") and (t[:-2] in _KIND or kind_of(t[:-2], names)):  # "blvdde la"
                self.kinds.append((i, t, _KIND.get(t[:-2]) or kind_of(t[:-2], names)))
            elif kind_of(t, names):
                self.kinds.append((i, t, kind_of(t, names)))
            elif len(t) == 1 or t in NUMBER_WORDS:
                continue
            elif len(t) <= 3 and t not in STREET_WORDS:
                self.regions.append(t)
            else:
                self.rest.append((i, t))
        house = [x for x in house if x in own]
        # four digits right behind a code are its extension
        self.extension = {b for a, b in zip(self.nums, self.nums[1:]) if len(a) >= 4 and len(b) == 4 and b in house and len(house) > 1}
        self.house = [x for x in house if x not in self.extension] or house
        self.lettered = [x for x in lettered if x in self.house]

    def numbers(self, used: set[str], street_at: int) -> list[str]:
        """The numbers that may be the house number, likely ones first. A unit word before the street has the first number,
        one behind it a later one; a number with a letter is a house number."""
        left = [x for x in self.house if x not in used] or self.house
        if self.lettered:
            left = self.lettered + [x for x in left if x not in self.lettered]
        elif self.units and self.spelled and len(left) <= len(self.units):
            left = self.spelled + left
        elif not left:
            left = self.spelled
        elif self.units and len(left) > 1 and self.units[0] < street_at:
            left = left[1:] + left[:1]
        return list(dict.fromkeys(left))

    def streets(self, words: list[tuple[int, str]]) -> list[tuple[str, str, float]]:
        """(name, kind, fit) of the street that some words may name, the likely reading first."""
        if not words:
            return []
        core, first, last = [x for _, x in words], words[0][0], words[-1][0]
        kinds, saint = list(self.kinds), False
        # "st" before a name while another kind stands elsewhere belongs to the name
        for k in kinds:
            if k[1] == "st" and k[0] < first and len(kinds) > 1:
                kinds.remove(k)
                saint = True
                break
        if kinds:
            behind = [k for k in kinds if k[0] > last] or [k for k in kinds if k[0] > first] or kinds
            own = behind[0][2]
            out = [(" ".join(["st", *core] if saint else core), own, 0.0)]
            if not saint and len(kinds) == 1 and kinds[0][1] == "st" and kinds[0][0] < first:
                out = [(" ".join(["st", *core]), "", 0.0), (*out[0][:2], -0.4)]
            return out
        out = [(" ".join(core), "", 0.0)]
        for n, x in enumerate(core):  # "canalrd", "blvdspring"
            k = next((k for k in range(4, len(x) - 1) if x[k:] in _KIND), None)
            if k is not None and len(x) <= 24:
                # endings of two consonants are no syllable
                glued = (" ".join([*core[:n], x[:k], *core[n + 1 :]]), _KIND[x[k:]], 0.0)
                out = [glued, (*out[0][:2], -0.5)] if len(out) == 1 else out
            j = next((j for j in range(min(len(x) - 4, 11), 1, -1) if x[:j] in _KIND), None)
            if j is not None and len(out) == 1:
                out.append((" ".join([*core[:n], x[j:], *core[n + 1 :]]), _KIND[x[:j]], -0.3 if j >= 3 else -0.5))
        return out


def joined_codes(nums: list[str]) -> list[tuple[str, str, str]]:
    """(code, its two parts): postcodes that may have been written in two parts."""
    out = []
    for a, b in zip(nums, nums[1:]):
        if len(a) == 3 and len(b) <= 3:
            out.append((a + b.zfill(3), a, b))
        if len(a) in (2, 3) and len(b) <= 5 - len(a):
            out.append((a + b.zfill(5 - len(a)), a, b))
    return out


def _parsed(names: frozenset[str]):
    """id, w, u and what may name the locality: rest, pairs (of neighbours), code, keys (of codes and regions) with the parts
    of the address they use."""
    item = pa.struct([("key", pa.string()), ("part", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest, code, region, keys = [], [], [], []
            for w, u in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                a = Address(w, u, names)
                words = [x for _, x in a.rest]
                alnum = "".join(c for c in a.codes if c[0].isalpha())
                plain = [c for c in a.codes if not c[0].isalpha()]
                four = [x for x in a.nums if len(x) == 4]  # a leading zero may be lost
                got = {}
                for c in plain + ([alnum] if alnum else []):
                    got["c" + c] = c
                    got["t" + "".join(sorted(c))] = c
                for c, x, y in joined_codes(a.nums):
                    got.setdefault("c" + c, x + " " + y)
                for x in four:
                    got.setdefault("c" + x, x)
                    got.setdefault("t" + "".join(sorted(x)), x)
                for r in a.regions:
                    got["r" + r] = ""
                rest.append(words)
                code.append(alnum or next(iter(plain), None) or next(iter(reversed(four)), None))
                region.append(a.regions[-1] if a.regions else None)
                keys.append([{"key": k, "part": v} for k, v in got.items()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rest, pa.list_(pa.string())), pa.array(code, pa.string()), pa.array(region, pa.string()), pa.array(keys, pa.list_(item))], names=["id", "w", "u", "rest", "code", "region", "keys"])

    return walk


def localities(words: DataFrame) -> DataFrame:
    """(kind, name, town, n): what stands for a town: w its word, c a postcode, r a region, s a word beside it (the last two
    with the BEAM most frequent towns each). A town is the word that most addresses of a postcode share.

    words: id, word, code, region."""
    per = words.filter("code IS NOT NULL").groupBy("code", "word").agg(F.count(F.lit(1)).alias("n"))
    all_of = words.filter("code IS NOT NULL").select("id", "code").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("m"))
    top = per.groupBy("code").agg(F.max(F.struct("n", "word")).alias("t")).select("code", F.col("t.word").alias("town"), F.col("t.n").alias("n")).join(all_of, "code")
    top = top.filter("n >= CASE WHEN length(code) > 4 OR code RLIKE '^[a-z]' THEN 3 ELSE 8 END AND n >= 0.4 * m").select("code", "town", "n")
    # a word that mostly stands beside other codes names no town
    total = per.groupBy(F.col("word").alias("town")).agg(F.sum("n").alias("total"))
    towns = top.groupBy("town").agg(F.sum("n").alias("n")).join(total, "town").filter(F.col("n") >= TOWN_SHARE * F.col("total")).select("town", "n")
    top = top.join(towns.select("town"), "town", "left_semi").select("code", "town", "n")
    own = words.join(towns.select(F.col("town").alias("word")), "word", "left_semi")
    regions = own.filter("region IS NOT NULL").groupBy(F.lit("r").alias("kind"), F.col("region").alias("name"), F.col("word").alias("town")).agg(F.count(F.lit(1)).alias("n"))
    beside = words.select("id", "word").join(own.select("id", F.col("word").alias("town")), "id").filter("word <> town")
    beside = beside.groupBy(F.lit("s").alias("kind"), F.col("word").alias("name"), "town").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind", "name").orderBy(F.desc("n"), "town")
    few = regions.unionByName(beside).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= BEAM).drop("rk")
    return towns.select(F.lit("w").alias("kind"), F.col("town").alias("name"), "town", "n").union(top.select(F.lit("c"), "code", "town", "n")).union(few.select("kind", "name", "town", "n"))


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, key: what a word (or two joined by a space) may be the spelling of: itself, its consonants, a part of it."""
    for b in batches:
        word, key = [], []
        for t in b.column(0).to_pylist():
            whole = t.replace(" ", "")
            keys = {"w" + whole}
            if " " not in t:
                keys |= {"b" + d for d in deletions(bones(t))}
                if len(t) >= 8:
                    keys |= {"w" + x for k in range(4, len(t) - 3) for x in (t[k:], t[:k])}
            word += [t] * len(keys)
            key += sorted(keys)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(key, pa.string())], names=["word", "key"])


def _gazetteer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, town, n, fit = [], [], [], []
        for kind, name, t, k in zip(*[c.to_pylist() for c in b.columns]):
            keys = {"w" + name: 3.0} | {"b" + d: 2.0 for d in deletions(bones(name))} if kind == "w" else {"c" + name: 2.5, "t" + "".join(sorted(name)): 1.0} if kind == "c" else {kind + name: 0.5 if kind == "r" else 0.4}
            for x, f in keys.items():
                key.append(x)
                town.append(t)
                n.append(k)
                fit.append(f)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(town, pa.string()), pa.array(n, pa.int64()), pa.array(fit, pa.float64())], names=["key", "town", "n", "fit"])


def _spelled_like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops matches by consonants whose letters differ too much."""
    for b in batches:
        key, word, town = (b.column(c).to_pylist() for c in ("key", "word", "town"))
        d, _ = dice_and_overlap(*[sketches([x.replace(" ", "").encode() for x in s]) for s in (word, town)])
        ok = np.array([k[0] != "b" for k in key], bool) | (d >= 0.55)
        yield b.filter(pa.array(ok))


def _evidence(parsed: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(id, town, fit, parts): the localities that an address may lie in, BEAM at most. Words are matched once per spelling."""
    pairs = F.expr("transform(sequence(1, size(rest) - 1), i -> concat(rest[i - 1], ' ', rest[i]))")
    spelled = parsed.select("id", F.explode(F.array_distinct(F.when(F.size("rest") > 1, F.concat("rest", pairs)).otherwise(F.col("rest")))).alias("word"))
    own = cut(spelled, "town_words")
    keyed = own.select("word").distinct().filter("length(word) >= 5").mapInArrow(_word_keys, "word string, key string")
    like = keyed.join(gazetteer, "key").select("word", "key", "town", "n", "fit").mapInArrow(_spelled_like, "word string, key string, town string, n long, fit double")
    like = like.groupBy("word", "town").agg(F.max("fit").alias("fit"), F.max("n").alias("n"))
    by_word = own.join(like, "word").select("id", "town", F.lit("w").alias("by"), "fit", "n", F.col("word").alias("part"))
    beside = own.withColumn("key", F.concat(F.lit("s"), "word")).join(gazetteer, "key").select("id", "town", F.lit("s").alias("by"), "fit", "n", F.lit("").alias("part"))
    coded = parsed.select("id", F.explode("keys").alias("k")).select("id", "k.key", "k.part").join(gazetteer, "key")
    coded = coded.select("id", "town", F.when(F.substring("key", 1, 1) == "r", "r").otherwise("c").alias("by"), "fit", "n", "part")
    ev = by_word.union(beside).union(coded)
    # the best evidence of each kind adds up

    def most(kind: str):
        return F.coalesce(F.max(F.when(F.col("by") == kind, F.col("fit"))), F.lit(0.0))

    fit = most("w") + most("c") + most("r") + most("s") + 0.05 * F.log(F.max("n"))
    agg = ev.groupBy("id", "town").agg(fit.alias("fit"), F.collect_set("part").alias("parts"))
    w = Window.partitionBy("id").orderBy(F.desc("fit"), "town")
    return agg.withColumn("rk", F.row_number().over(w)).withColumn("top", F.max("fit").over(Window.partitionBy("id"))).filter(f"rk <= {BEAM} AND fit >= top - 1.5").select("id", "town", "fit", "parts")


def _streets(names: frozenset[str]):
    """The readings of an address, the BEAM likeliest for each locality: id, town, fit, core, kind, dir, house."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, w, u, towns in zip(*[c.to_pylist() for c in b.columns]):
                a = Address(w, u, names)
                for t in towns or [{"town": "", "fit": 0.0, "parts": []}]:
                    gone = set(t["parts"])
                    split = {x for g in gone if " " in g for x in g.split()}
                    words = []
                    for at, x in a.rest:
                        if x in gone or x in split or (t["town"] and len(x) >= 5 and edits(x, t["town"], 3) <= (3 if len(x) >= 9 else 2)):
                            glued = x.replace(t["town"], "") if t["town"] in x else ""
                            if len(glued) >= 4:
                                words.append((at, glued))
                            continue
                        words.append((at, x))
                    used = {p for g in gone for p in g.split() if p.isdigit()}
                    street_at = min([at for at, _ in words] + [k[0] for k in a.kinds if words and k[0] < words[0][0]], default=0)
                    found = [
                        (float(t["fit"]) + f - 1.5 * n - 0.5 * m, core, kind, way, h)
                        for core, kind, f in a.streets(words) for n, h in enumerate(a.numbers(used, street_at)) for m, way in enumerate(dict.fromkeys(a.dirs or [""]))
                    ]
                    for fit, core, kind, way, h in sorted(found, key=lambda r: -r[0])[:BEAM]:
                        rows.append((i, t["town"], fit, core, kind, way, h))
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "town", "fit", "core", "kind", "dir", "house"])

    return walk


def _with_glued_directions(readings: DataFrame) -> DataFrame:
    """Readings whose street begins with the letter of a direction before a more frequent street of the town ("norchard")."""
    cores = readings.groupBy("town", "core").agg(F.count_distinct("id").alias("k"))
    first = F.substring("core", 1, 1)
    longer = cores.filter(first.isin(*DIRECTIONS) & (F.length("core") >= 5)).select("town", F.col("core").alias("long"), F.substring("core", 2, 1 << 20).alias("core"), F.col("k").alias("m"))
    glued = longer.join(cores, ["town", "core"]).filter("k >= 2 * m").select("town", F.col("long").alias("core"), F.col("core").alias("bare"))
    d = readings.join(glued, ["town", "core"], "left")
    way = F.when(F.col("bare").isNotNull() & (F.col("dir") == ""), first).otherwise(F.col("dir"))
    return d.select("id", "town", "fit", F.when((F.col("dir") == "") | F.col("bare").isNull(), F.coalesce("bare", "core")).otherwise(F.col("core")).alias("core"), "kind", way.alias("dir"), "house")


def split_forms(forms: list[tuple[str, str, int]]) -> list[int]:
    """The location of each form (kind, direction, count) of one street and house number, as the index of its first form."""
    order = sorted(range(len(forms)), key=lambda i: (-(forms[i][0] != "") - (forms[i][1] != ""), -forms[i][2], forms[i]))
    heads: list[list] = []
    out = [0] * len(forms)
    for i in order:
        kind, way, n = forms[i]
        best, score = None, -math.inf
        for h in heads:
            if (kind and h[1] and kind != h[1]) or (way and h[2] and way != h[2]):
                continue
            if h[2] and not way and n >= PLAIN_TIMES * h[3]:
                continue  # far more without the direction than with it: the street without one
            s = math.log(h[3]) - (kind != h[1]) - (way != h[2])
            if s > score:
                best, score = h, s
        if best is None:
            heads.append([i, kind, way, n])
            out[i] = i
        else:
            out[i] = best[0]
            best[1], best[2] = best[1] or kind, best[2] or way
            best[3] += n
    return out


def _split(key: tuple, forms: list[tuple]) -> list[tuple]:
    forms = sorted(forms)
    return [(*key, *form[:2], at) for form, at in zip(forms, split_forms(forms))]


def _names_like_kinds(rec: DataFrame) -> frozenset[str]:
    """Words near a kind of street that mostly stand beside one: names ("lake ave"). Those in NAME_SHARE of the addresses at
    least, so there are no more than the mean number of words divided by it."""
    n = rec.count()
    toks = F.array_distinct(F.split("w", " "))
    known = F.arrays_overlap(toks, F.array(*map(F.lit, sorted(_KIND))))
    per = rec.select(F.explode(toks).alias("word"), known.alias("sure")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("sure").alias("k"))
    often = per.filter((F.col("n") >= max(5.0, NAME_SHARE * n)) & (F.col("k") >= 0.6 * F.col("n")) & (F.length("word") >= 4)).select("word").collect()
    return frozenset(r.word for r in often if r.word not in _KIND and kind_of(r.word))


def locations(df: DataFrame, id_col: str = "eid", words_col: str = "a_words", nums_col: str = "a_nums") -> DataFrame:
    """(id, location): the records whose address names a house; equal locations are one place."""
    rec = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(words_col, F.lit("")).alias("w"), F.coalesce(nums_col, F.lit("")).alias("u"))
    rec = cut(rec.filter("id IS NOT NULL AND w <> ''").distinct(), "addresses")
    names = _names_like_kinds(rec)
    fields = "id long, w string, u string, rest array<string>, code string, region string, keys array<struct<key: string, part: string>>"
    parsed = cut(rec.repartition(spread(rec.count()), "id").mapInArrow(_parsed(names), fields), "parsed")
    words = parsed.select("id", "code", "region", F.explode(F.array_distinct(F.filter("rest", lambda t: F.length(t) >= 5))).alias("word"))
    gazetteer = cut(localities(words).mapInArrow(_gazetteer_keys, "key string, town string, n long, fit double"), "gazetteer")
    lists = _evidence(parsed, gazetteer).groupBy("id").agg(F.collect_list(F.struct("town", "fit", "parts")).alias("towns"))
    beam = parsed.select("id", "w", "u").join(lists, "id", "left").select("id", "w", "u", "towns")
    readings = cut(beam.mapInArrow(_streets(names), "id long, town string, fit double, core string, kind string, dir string, house string"), "readings")
    readings = cut(_with_glued_directions(readings), "readings")
    cores = readings.groupBy(F.col("town").alias("part"), "core").agg(F.count_distinct("id").alias("k"))
    roots = attach(cores, drop_words=False).select(F.col("part").alias("town"), "core", "root")
    named = readings.join(roots, ["town", "core"], "left").withColumn("street", F.coalesce("root", "core")).drop("root")
    named = cut(named, "named")
    # how many addresses the gazetteer holds at a house, and on a street
    at_house = named.groupBy("town", "street", "house").agg(F.count_distinct("id").alias("nh"))
    on_street = named.groupBy("town", "street").agg(F.count_distinct("id").alias("ns"))
    scored = named.join(at_house, ["town", "street", "house"]).join(on_street, ["town", "street"])
    score = F.col("fit") + 0.7 * F.log("nh") + 0.3 * F.log("ns")
    best = scored.groupBy("id").agg(F.max(F.struct(score.alias("s"), "town", "street", "house", "kind", "dir")).alias("b")).select("id", "b.*").drop("s")
    best = cut(best, "places")
    forms = best.groupBy("town", "street", "house", "kind", "dir").agg(F.count(F.lit(1)).alias("n"))
    sub = over_groups(forms, ["town", "street", "house"], ["kind", "dir", "n"], _split, "town string, street string, house string, kind string, dir string, form int")
    placed = best.join(sub, ["town", "street", "house", "kind", "dir"])
    return placed.select(F.col("id").alias(id_col), F.concat_ws("|", "town", "street", "house", F.col("form").cast("string")).alias("location"))


def same_location(df: DataFrame, id_col: str = "eid", words_col: str = "a_words", nums_col: str = "a_nums") -> DataFrame:
    """(eid_a, eid_b), eid_a < eid_b: the pairs of records that denote one house."""
    at = cut(locations(df, id_col, words_col, nums_col).withColumnRenamed(id_col, "id"), "locations")
    return at.alias("x").join(at.alias("y"), F.expr("x.location = y.location AND x.id < y.id")).select(F.expr("x.id AS eid_a"), F.expr("y.id AS eid_b")).distinct()
