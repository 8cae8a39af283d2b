"""Problem 1: matching entities across sources without keys.

Method: sorted neighbourhood over several composite sort keys. Every record gives one row for each key (the distinctive word
of its name, that word backwards, the whole name, the distinctive address word with the house number, postcode with house
number), the rows of all keys are range-partitioned and sorted together, and each record is compared with the WINDOW rows
after it. The comparison weighs field similarities: name, address words, house numbers, country. Pairs of enough confidence
go on, and the assignment that maximises the total confidence is made: a record of the other sources belongs to one record
of source 1 at most while one of source 1 may hold many, so the best partner of each is that assignment.

Equal keys are told apart by address word and code and at last by a hash of the id, so a key with a third of all rows is spread over
many tasks; the rows at the ends of a task's range are compared across it in a second, small step. Runs of equal keys that
are longer than a window are compared as a whole: all pairs of their distinct texts in runs of up to BLOCK_ROWS, longer ones
in blocks of equal address words, codes and numbers, which are split by a further one while they are longer. A text that has
no further one meets its whole block.

Words that stand in at least COMMON_SHARE of the records are taken as common; there are at most the mean number of words in a
record divided by that share, so the list is small at any size. Null and empty fields are no evidence. Records without a
name take no part. Repeated rows of a record count once. Confidence is in [0, 1].
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import sketch
from weftline.operators.combine import token_counts
from weftline.session import cut

WINDOW = 12
COMMON_SHARE = 0.002
LEAST = 0.5
#: Rows that are compared at once in a task.
RUN_ROWS = 20_000
SAMPLE_ROWS = 60
#: Distinct texts of a block of which all pairs are compared.
BLOCK_ROWS = 400
#: What parts a sort key from the fields that only order equal keys, and the mark of rows in long runs.
PART, LONG = "\x1f", -1

#: Labels of one country. Any other label is no evidence: it neither joins nor separates.
COUNTRY_LABELS = {"us": "us", "usa": "us", "united states": "us", "in": "in", "india": "in", "bharat": "in", "fr": "fr", "france": "fr", "ca": "ca", "canada": "ca"}

#: Numbers written as words.
NUMBER_WORDS = dict(zip("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), map(str, range(1, 21)))) | dict(
    zip("thirty forty fifty sixty seventy eighty ninety hundred".split(), map(str, range(30, 101, 10)))
)

#: Words that are added to a name and say nothing about the business.
ADDED = frozenset("unit group branch official the mr of and a".split())

_VOWELS = str.maketrans("", "", "aeiouyhw")
_TWICE = re.compile(r"(.)\1+")
_CODE = re.compile(r"[a-z]\d|\d[a-z]{2,}|\d[a-z]\d")


@lru_cache(1 << 16)
def bones(word: str) -> str:
    """The consonants of a word, repeats once: what is left by most misspellings. The first letter stays."""
    word = word.replace("ph", "f").replace("ck", "k").replace("x", "ks").replace("z", "s").replace("q", "k").replace("c", "k")
    return _TWICE.sub(r"\1", word[:1] + word[1:].translate(_VOWELS))


def house_and_code(words: str, nums: str) -> tuple[list[str], list[str]]:
    """The numbers of an address that may be house or unit numbers, and those of five digits or more; digits of alphanumeric
    postcodes are left out."""
    own = nums.split()
    for w in words.split():
        if w in NUMBER_WORDS:
            own.append(NUMBER_WORDS[w])
        elif _CODE.search(w):
            for d in re.findall(r"\d+", w):
                d = d.lstrip("0") or "0"
                if d in own:
                    own.remove(d)
    return [x for x in own if len(x) < 5], [x for x in own if len(x) >= 5]


def sort_keys(name: list[str], common: set[str], words: list[str], common_words: set[str], house: list[str], code: list[str]) -> list[str]:
    """The composite keys of a record; an empty one is left out."""
    name = [w for w in name if w not in ADDED] or name
    rare = sorted((w for w in name if w not in common), key=lambda w: (-len(w), w))
    first, whole = bones((rare or sorted(name, key=lambda w: (-len(w), w)))[0]), "".join(sorted(map(bones, name)))
    at = sorted((w for w in words if w not in common_words and len(w) > 2), key=lambda w: (-len(w), w))
    number = ".".join(sorted(house, key=lambda x: (-len(x), x)))
    place = bones(at[0]) if at else ""
    # composite keys of shortened fields, as the method has them; the texts themselves are compared whole
    back, number = first[::-1], number[:8]
    long = max(code, key=len)[:10] if code else ""
    # what orders equal keys
    at = f"{PART}{place[:5]}{long[:6]}"
    return [
        f"{first[:9]}|{whole[:8]}|{number}{at}" if rare else f"{whole[:24]}|{number}{at}",
        f"{back[:9]}|{number}|{place[:3]}{at}",
        f"{''.join(map(bones, name))[:14]}|{number}{at}",
        f"{place[:9]}|{number}|{first[:3]}{PART}{long[:6]}" if place else "",
        f"{long}|{number}|{first[:3]}{PART}{place[:5]}" if code and number else "",
    ]


_RNG = np.random.default_rng(31_337)
_BYTE, _PLACE = (_RNG.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (256, 64))


_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def scatter(ids: np.ndarray) -> np.ndarray:
    """Ids in an order that has nothing to do with their values; gather() gives them back."""
    return (ids.astype(np.uint64) * np.uint64(_ODD)).view(np.int64)


def gather(scattered: np.ndarray) -> np.ndarray:
    return (scattered.view(np.uint64) * np.uint64(_BACK)).view(np.int64)


class Words:
    """The words of a column of texts as arrays: their bytes without spaces, the row of each byte, and where each starts."""

    def __init__(self, texts):
        col = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else pa.array([], pa.string()) if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        self.n = len(col)
        _, at, data = col.buffers()
        off = np.frombuffer(at, np.int32)[col.offset : col.offset + self.n + 1] if self.n else np.zeros(1, np.int32)
        b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        size = np.diff(off)
        solid = b != 32
        new = np.zeros(len(b), bool)
        new[(off[:-1] - off[0])[size > 0]] = True
        new[1:] |= ~solid[:-1]
        self.b, self.row = b[solid], np.repeat(np.arange(self.n), size)[solid]
        self.start = np.flatnonzero(new[solid])
        self.size = np.diff(np.r_[self.start, len(self.b)])
        self.word_row = self.row[self.start]

    def place(self) -> np.ndarray:
        return np.arange(len(self.b)) - np.repeat(self.start, self.size)

    def digests(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return np.add.reduceat(_BYTE[self.b] * _PLACE[self.place() & 63], self.start)

    def sketch(self) -> np.ndarray:
        return sketch.of_rows(self.b, self.row, self.n)

    def rare_sketch(self, common: np.ndarray) -> np.ndarray:
        """Without the common words, in rows that have others."""
        d = self.digests()
        at = np.minimum(np.searchsorted(common, d), max(0, len(common) - 1))
        rare = common[at] != d if len(common) else np.ones(len(d), bool)
        some = np.zeros(self.n, bool)
        some[self.word_row[rare]] = True
        use = np.repeat(rare | ~some[self.word_row], self.size)
        return sketch.of_rows(self.b[use], self.row[use], self.n)

    def numbers(self, words: np.ndarray, most: int) -> np.ndarray:
        """(rows, most): the values of the chosen words, all digits, in order; -1 where there are no more."""
        out = np.full((self.n, most), -1, np.int64)
        if len(self.start):
            up = np.repeat(self.size, self.size) - 1 - self.place()
            value = np.add.reduceat((self.b.astype(np.int64) - 48) * 10 ** np.minimum(up, 17), self.start)[words]
            row = self.word_row[words]
            k = np.arange(len(row)) - np.searchsorted(row, row)
            ok = k < most
            out[row[ok], k[ok]] = value[ok]
        return out


def common_digests(words: set[str]) -> np.ndarray:
    return np.sort(Words(sorted(words)).digests())


class Records:
    """The fields of a batch of records as arrays. nums has house and unit numbers and codes; countries are short labels."""

    MOST_NUMBERS, MOST_CODES = 6, 2

    def __init__(self, names, words, nums, countries, common: np.ndarray, common_words: np.ndarray):
        n, w, u = Words(names), Words(words), Words(nums)
        self.name, self.rare = n.sketch(), n.rare_sketch(common)
        self.words, self.place = w.sketch(), w.rare_sketch(common_words)
        short = u.size < 5
        # rows with more numbers than the arrays hold are compared as sets
        parts = np.bincount(u.word_row[short], minlength=u.n), np.bincount(u.word_row[~short], minlength=u.n)
        self.over = (parts[0] > self.MOST_NUMBERS) | (parts[1] > self.MOST_CODES)
        self.sets: dict[int, tuple[set, set]] = {}
        self.nums = nums
        self.house, self.code = u.numbers(short, self.MOST_NUMBERS), u.numbers(~short, self.MOST_CODES)
        c = Words(countries)
        self.country = np.zeros(c.n, np.uint64)
        self.country[c.word_row] = c.digests()

    def _all_numbers(self, row: int) -> tuple[set, set]:
        got = self.sets.get(row)
        if got is None:
            text = self.nums[row] if isinstance(self.nums, list) else self.nums[row].as_py()
            own = text.split()
            got = self.sets[row] = ({int(x) for x in own if len(x) < 5}, {x for x in own if len(x) >= 5})
        return got

    def confidence(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the pairs (i, j) of this batch's records: weighted similarities of name and place."""
        nd, no = sketch.dice_and_overlap(self.name[i], self.name[j])
        rd, _ = sketch.dice_and_overlap(self.rare[i], self.rare[j])
        name = 0.4 * no + 0.3 * rd + 0.3 * nd
        wd, wo = sketch.dice_and_overlap(self.words[i], self.words[j])
        pd_, _ = sketch.dice_and_overlap(self.place[i], self.place[j])
        hi, hj = self.house[i], self.house[j]
        shared = ((hi[:, :, None] == hj[:, None, :]) & (hi[:, :, None] >= 0)).any(axis=(1, 2))
        both = (hi[:, 0] >= 0) & (hj[:, 0] >= 0)
        ci, cj = self.code[i], self.code[j]
        same_code = ((ci[:, :, None] == cj[:, None, :]) & (ci[:, :, None] >= 0)).any(axis=(1, 2))
        for k in np.flatnonzero(self.over[i] | self.over[j]):
            a, b = self._all_numbers(int(i[k])), self._all_numbers(int(j[k]))
            shared[k], same_code[k] = bool(a[0] & b[0]), bool(a[1] & b[1])
        blank = (sketch.weight(self.words[i]) == 0) | (sketch.weight(self.words[j]) == 0)
        house = np.where(shared, 1.0, np.where(both, 0.0, 0.6))
        place = 0.35 * wo + 0.2 * np.maximum(pd_, wd) + 0.35 * house + 0.1 * np.where(same_code, 1.0, np.where((ci[:, 0] < 0) | (cj[:, 0] < 0), 0.7, 0.0))
        # without an address only the name speaks
        place = np.where(blank, np.where(name > 0.8, 0.64, 0.0), place)
        # another house number is another place, whatever else is alike
        place = np.where(both & ~shared, 0.5 * place, place)
        out = np.where(name >= 0.45, name, 0.0) * place
        k, m = self.country[i], self.country[j]
        return np.where((k > 0) & (m > 0) & (k != m), 0.0, out)


def _common(df: DataFrame, share: float) -> tuple[dict[str, set[str]], int]:
    """The common words of n_core and a_words, and the number of rows."""
    n = df.count()
    rows = token_counts(df, ["n_core", "a_words"]).filter(F.col("n_rows") >= max(2, int(share * n))).collect()
    out: dict[str, set[str]] = {"n_core": set(), "a_words": set()}
    for r in rows:
        out[r.fld].add(r.tok)
    return out, n


def _keyed(common: dict[str, set[str]], bounds: list[tuple[int, str, int]]):
    """The rows of all keys of each record, with the range they belong to."""
    names, places = common["n_core"], common["a_words"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kid, key, rng, texts = [], [], [], [], []
            scattered = scatter(b.column("eid").to_numpy())
            for i, (n, w, u, c, tie) in enumerate(zip(*[b.column(x).to_pylist() for x in ("n", "w", "u", "c")], scattered.tolist())):
                house, code = house_and_code(w, u)
                texts.append("\t".join(x.replace("\t", " ") for x in (n, w, " ".join(house + code), COUNTRY_LABELS.get(c.strip().lower(), ""))))
                name = n.split()
                if not name:
                    continue
                for k, x in enumerate(sort_keys(name, names, w.split(), places, house, code)):
                    if x:
                        at.append(i)
                        kid.append(k)
                        key.append(x)
                        rng.append(bisect_left(bounds, (k, x, tie)))
            rows = pa.RecordBatch.from_arrays([pa.array(scattered), b.column("src"), pa.array(texts, pa.string())], names=_FIELDS[2:])
            rows = rows.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(rng, pa.int32()), pa.array(kid, pa.int32()), pa.array(key, pa.string()), *rows.columns], names=["rng", *_FIELDS])

    return walk


class _Compare:
    """Compares rows of one sort order within a window."""

    def __init__(self, common: dict[str, set[str]], window: int, least: float):
        self.common, self.window, self.least = [common_digests(common[f]) for f in ("n_core", "a_words")], window, least

    def pairs(self, rows: pa.Table, far: int | None = None) -> pa.RecordBatch:
        """The pairs of enough confidence; with far, only those of a row before and a row from far on."""
        kid, tie, src = (rows.column(c).to_numpy() for c in ("kid", "tie", "src"))
        eid = gather(np.ascontiguousarray(tie))
        parts = pc.split_pattern(rows.column("texts"), "\t")
        rec = Records(*[pc.list_element(parts, k) for k in range(4)], *self.common)
        out = []
        first = np.arange(len(eid))
        for d in range(1, self.window + 1):
            i = first[: max(0, len(eid) - d)]
            i = i[(kid[i] == kid[i + d]) & (src[i] != src[i + d])]
            if far is not None:
                i = i[(i < far) & (i + d >= far)]
            if len(i):
                conf = rec.confidence(i, i + d)
                ok = conf >= self.least
                i, conf = i[ok], conf[ok]
                one = src[i] == 1
                out.append((np.where(one, eid[i], eid[i + d]), np.where(one, eid[i + d], eid[i]), conf))
        e, c, conf = (np.concatenate([x[k] for x in out]) if out else np.zeros(0) for k in range(3))
        # a pair that several keys bring together within a run goes on once
        if len(e):
            o = np.lexsort((-conf, c, e))
            e, c, conf = e[o], c[o], conf[o]
            keep = np.r_[True, (e[1:] != e[:-1]) | (c[1:] != c[:-1])]
            e, c, conf = e[keep], c[keep], conf[keep]
        return pa.RecordBatch.from_arrays([pa.array(e.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(conf.astype(np.float64))], names=["eid", "cid", "conf"])


#: texts: name, address words, numbers and country, tab-separated: one field shuffles in fewer bytes than four.
_FIELDS = ["kid", "key", "tie", "src", "texts"]
_FIELD_TYPES = "kid int, key string, tie long, src int, texts string"


def _slide(compare: _Compare, run_rows: int):
    w = compare.window

    def edge(t: pa.Table, border: int, side: int) -> pa.RecordBatch:
        n = t.num_rows
        t = t.combine_chunks()
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
        nothing = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())]
        return pa.RecordBatch.from_arrays([*nothing, pa.array([border] * n, pa.int64()), pa.array([side * w + k for k in range(n)], pa.int32()), *cols], names=["e1", "cid", "conf", "border", "pos", *_FIELDS])

    def found(p: pa.RecordBatch) -> pa.RecordBatch:
        n = p.num_rows
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([*p.columns, *[pa.nulls(n, t) for t in types]], names=["e1", "cid", "conf", "border", "pos", *_FIELDS])

    def long_runs(t: pa.Table, ends: bool) -> pa.RecordBatch:
        """The rows in runs of equal keys longer than the window; with ends also those of the first and last run, which may
        go on in another task."""
        n = t.num_rows
        base = pc.list_element(pc.split_pattern(t.column("key"), PART, max_splits=1), 0).combine_chunks().dictionary_encode()
        base = base.combine_chunks() if isinstance(base, pa.ChunkedArray) else base
        at, kid = base.indices.to_numpy(), t.column("kid").to_numpy()
        start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (kid[1:] != kid[:-1])])
        size = np.diff(np.r_[start, n])
        use = size > w
        if ends:
            use[0] = use[-1] = True
        t = t.filter(pa.array(np.repeat(use, size))).combine_chunks()
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
        n = t.num_rows
        nothing = [pa.nulls(n, x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*nothing, pa.array([LONG] * n, pa.int32()), *cols], names=["e1", "cid", "conf", "border", "pos", *_FIELDS])

    def once(t: pa.Table) -> pa.Table:
        """Without repeated rows, which are neighbours in this order."""
        if t.num_rows < 2:
            return t
        eid, kid = t.column("tie").to_numpy(), t.column("kid").to_numpy()
        return t.filter(pa.array(np.r_[True, (eid[1:] != eid[:-1]) | (kid[1:] != kid[:-1])]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: pa.Table | None = None  # the rows before the run that may still meet it
        held: list[pa.RecordBatch] = []
        head_left, size = w, 0

        def run():
            nonlocal last, head_left
            new = once(pa.Table.from_batches(held).select(_FIELDS))
            if last is not None and last.num_rows and new.num_rows:
                same = last.column("tie")[-1] == new.column("tie")[0] and last.column("kid")[-1] == new.column("kid")[0]
                new = new.slice(1) if same else new
            if head_left and new.num_rows:
                yield edge(new.slice(0, head_left), part - 1, 1)
                head_left -= min(head_left, new.num_rows)
            rows = pa.concat_tables([last, new]) if last is not None else new
            yield found(compare.pairs(rows))
            if rows.num_rows:
                yield long_runs(rows, head_left < w and last is None)
            last = rows.slice(max(0, rows.num_rows - w))

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= run_rows:
                yield from run()
                held, size = [], 0
        if held:
            yield from run()
        if last is not None:
            if last.num_rows:
                yield long_runs(last, True)
            yield edge(last, part, 0)

    return walk


def _bounds(rows: DataFrame, common: dict[str, set[str]], n: int, parts: int) -> list[tuple[int, str, int]]:
    """Where the ranges of the sort order end, from the keys of about SAMPLE_ROWS records a range (they only decide how evenly
    the tasks are loaded). Every bound is a row itself, so no range but the last can be empty."""
    every = max(1, n // (SAMPLE_ROWS * parts))
    some = rows.filter(F.pmod(F.xxhash64("eid"), F.lit(every)) == 0).mapInArrow(_keyed(common, []), f"rng int, {_FIELD_TYPES}")
    keys = sorted((r.kid, r.key, r.tie) for r in some.select("kid", "key", "tie").distinct().collect())
    picked = [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []
    return sorted(set(picked))


def candidate_pairs(records: DataFrame, window: int = WINDOW, least: float = LEAST, share: float = COMMON_SHARE, run_rows: int = RUN_ROWS, parts: int | None = None) -> DataFrame:
    """(eid, cid, conf) of the pairs that the sorted neighbourhood finds, perhaps more than once.

    records: eid, src (1 or another number), n_core, a_words, a_nums, country."""
    common, n = _common(records, share)
    compare = _Compare(common, window, least)
    cols = [F.col("eid").cast("long").alias("eid"), F.col("src").cast("int").alias("src"), *[F.coalesce(c, F.lit("")).alias(k) for c, k in (("n_core", "n"), ("a_words", "w"), ("a_nums", "u"), ("country", "c"))]]
    rows = records.filter("eid IS NOT NULL").select(*cols)
    if parts is None:
        most = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, min(max(most, n // 100_000), n // 1000))
    bounds = _bounds(rows, common, n, parts)
    keyed = rows.mapInArrow(_keyed(common, bounds), f"rng int, {_FIELD_TYPES}")
    along = keyed.repartitionById(len(bounds) + 1, "rng").drop("rng").sortWithinPartitions("kid", "key", "tie")
    slid = cut(along.mapInArrow(_slide(compare, run_rows), f"e1 long, cid long, conf double, border long, pos int, {_FIELD_TYPES}"), "window")
    inside = slid.filter("border IS NULL AND pos IS NULL").select(F.col("e1").alias("eid"), "cid", "conf")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        t = pa.Table.from_pandas(pdf[_FIELDS], preserve_index=False)
        return compare.pairs(t, int((pdf["pos"] < window).sum())).to_pandas()

    edges = slid.filter("border IS NOT NULL").groupBy("border").applyInPandas(across, "eid long, cid long, conf double")
    return inside.unionByName(edges).unionByName(run_pairs(slid.filter(F.col("pos") == LONG).select("kid", "key", "tie", "src", "texts"), compare))


def _tokens(rows: DataFrame) -> DataFrame:
    """texts, with what may be shared by two addresses: the consonants of the words, and the numbers."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [x.split("\t") for x in b.column("texts").to_pylist()]
            toks = [sorted({bones(w) for w in p[1].split()} | {"#" + u for u in p[2].split()}) for p in parts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(toks, pa.list_(pa.string()))], names=[*b.schema.names, "toks"])

    return rows.mapInArrow(walk, "run long, src int, texts string, id long, toks array<string>")


def _scored(compare: _Compare):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            both = pa.chunked_array([b.column("ta"), b.column("tb")])
            parts = pc.split_pattern(both, "\t")
            conf = Records(*[pc.list_element(parts, k) for k in range(4)], *compare.common).confidence(np.arange(n), np.arange(n, 2 * n))
            ok = pa.array(conf >= compare.least)
            yield pa.RecordBatch.from_arrays([b.column("eid").filter(ok), b.column("cid").filter(ok), pa.array(conf.astype(np.float64)).filter(ok)], names=["eid", "cid", "conf"])

    return walk


def run_pairs(rows: DataFrame, compare: _Compare, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(eid, cid, conf) of the pairs within long runs of equal keys. Equal texts are compared once: of source 1 the smallest id
    stands for them, as in assign, the others come back at the end."""
    ids = F.pandas_udf(lambda x: pd.Series(gather(np.ascontiguousarray(x.to_numpy()))), "long")
    run = F.xxhash64("kid", F.substring_index("key", PART, 1))
    rows = rows.select(run.alias("run"), F.when(F.col("src") == 1, 1).otherwise(2).alias("src"), "texts", ids("tie").alias("id"))
    # runs with both sides
    two = rows.groupBy("run").agg(F.min("src").alias("lo"), F.max("src").alias("hi"), F.count_distinct("id").alias("n")).filter(f"lo < hi AND n > {compare.window}").select("run")
    rows = cut(rows.join(two, "run", "left_semi").distinct(), "runs")
    level = cut(_tokens(rows.groupBy("run", "src", "texts").agg(F.min("id").alias("id"))).select(F.col("run").alias("block"), "src", "texts", "id", "toks", F.array().cast("array<string>").alias("used"), "run"), "run_texts")
    found = None
    while True:
        size = level.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
        sized = cut(level.join(size, "block").withColumn("met", F.expr(f"size <= {block_rows} OR size(toks) = size(used)")), "blocks")
        a, b = sized.filter("src = 1").alias("a"), sized.filter("src = 2").alias("b")
        pairs = a.filter("met").join(b, F.expr("a.block = b.block")).union(a.filter("NOT met").join(b.filter("met"), F.expr("a.block = b.block"))).select(F.expr("a.id AS eid"), F.expr("b.id AS cid"), F.expr("a.texts AS ta"), F.expr("b.texts AS tb"))
        some = cut(pairs.mapInArrow(_scored(compare), "eid long, cid long, conf double"), "run_pairs")
        found = some if found is None else found.unionByName(some)
        more = sized.filter(f"size > {block_rows} AND NOT met").select("run", "src", "texts", "id", "toks", F.explode(F.array_except("toks", "used")).alias("t"), "used")
        more = more.withColumn("used", F.array_sort(F.array_append("used", F.col("t")))).drop("t").withColumn("block", F.xxhash64("run", "used")).distinct()
        level = cut(more.select("block", "src", "texts", "id", "toks", "used", "run"), "run_texts")
        if level.isEmpty():
            break
    best = found.groupBy("cid").agg(F.max(F.struct("conf", (-F.col("eid")).alias("neg"))).alias("b")).select("cid", (-F.col("b.neg")).alias("eid"), F.col("b.conf").alias("conf"))
    same = rows.filter("src = 2").select("run", "texts", "id")
    of = same.groupBy("run", "texts").agg(F.min("id").alias("cid")).join(same, ["run", "texts"]).select("cid", "id").distinct()
    return best.join(of, "cid").select("eid", F.col("id").alias("cid"), "conf")


def assign(pairs: DataFrame) -> DataFrame:
    """(eid, cid, conf): each cid with its most confident eid, the smaller where equal. As an eid may have many cids, this
    maximises the total confidence."""
    best = pairs.groupBy("cid").agg(F.max(F.struct("conf", (-F.col("eid")).alias("neg"))).alias("b"))
    return best.select((-F.col("b.neg")).alias("eid"), "cid", F.round("b.conf", 6).alias("confidence"))


def match(one: DataFrame, others: list[DataFrame], **kw) -> DataFrame:
    """(eid, cid, confidence): records of the other sources and the record of source one they describe."""
    cols = ["eid", "n_core", "a_words", "a_nums", "country"]
    records = one.select(*cols, F.lit(1).alias("src"))
    for o in others:
        records = records.unionByName(o.select(*cols, F.lit(2).alias("src")))
    return assign(candidate_pairs(records, **kw))
