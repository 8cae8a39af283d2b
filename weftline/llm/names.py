"""Problem 4: variant spellings of organisation names typed by people.

Method: noisy-channel attribution, for words first and then for names. Words that stand beside many different rare words are
the vocabulary (given names, lines of business, generic words); a spelling of such a word is attached to the more frequent
word that explains it best, by a prior from its frequency and the likelihood of a typo, an abbreviation or a short form
(learned: both occur with the same rare words far more often than chance). What is left of a name is its core, the coined
word or words. Cores are ranked by frequency as candidate canonical forms and each attached to its maximum posterior. Names with
one core are the forms of few organisations: the frequent, complete forms (given name, lines of business) are canonical, and
every other form goes to the compatible canonical form with the highest posterior. A token may be read in two ways (a short form or
a piece of a coined word, glued words or one); the reading whose core most names have is taken. A form with another given name (not a short
form or initial) or another line of business is not compatible; missing, added or generic words are no contradiction.

Names are taken once per spelling with their counts, forms once per core, so a frequent name weighs no more than a rare one until
the links are written out. The vocabulary holds at most the mean words of a name divided by VOCAB_SHARE, whatever the
size. Records without a name have no link, repeated rows of a record count once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.canon import attach, edits
from weftline.llm.groups import over_groups, spread
from weftline.llm.match import ADDED, bones
from weftline.llm.sketch import dice_and_overlap, sketches
from weftline.operators.combine import tokens_of
from weftline.session import cut

#: A word of the vocabulary stands in this share of the names at least, beside this many different rare words, and beside
#: this many for each of its names that are without its closest companion.
VOCAB_SHARE, VOCAB_BESIDE, VOCAB_APART = 0.0002, 6, 0.2
#: A rare word: in no more names than this, or in this share of those of the word it stands beside, and of this length at least.
RARE_NAMES, RARE_SHARE, RARE_LETTERS = 60, 0.05, 6
#: Edits within which a word is a spelling of a companion.
NEAR_EDITS = 2
GENERIC_SHARE = 0.05
#: What another reading of a name and one without a coined word lose against the likely one, as log-likelihoods, and the letters up
#: to which a misspelt word may be a piece of a coined one.
OTHER_READING, LONE, WEAK_LETTERS = 0.6, 3.0, 5
#: The marks of coined words and initials in a reading.
COINED, INITIAL = "\x01", "\x02"

#: Digits typed for letters.
LOOKALIKES = str.maketrans("0134578", "oleastb")


def word_stats(names: DataFrame) -> DataFrame:
    """(word, n, first, beside, apart, beside_apart): names it stands in, in first place; different rare words that it stands
    beside; both without the names that have its closest companion, the word it stands beside most often, or a spelling of that.

    One large organisation makes its coined word and its other words frequent together. Without the closest companion, a
    word of the vocabulary still meets the rare words of others, while the coined word only meets misspellings."""
    words = names.select("id", F.posexplode(F.filter(F.split("name", " "), lambda t: t != "")).alias("pos", "word"))
    n = cut(words.groupBy("word").agg(F.count_distinct("id").alias("n"), F.count_if(F.col("pos") == 0).alias("first")), "words")
    # each spelling of a name once, with its count: the words as a set, with how frequent each is
    sets = words.select("id", "word").distinct().join(n.select("word", "n"), "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("ws")).groupBy("ws").agg(F.count(F.lit(1)).alias("k"))
    sets = cut(sets, "word_sets")
    each = sets.select("ws", "k", F.explode("ws").alias("x")).select("ws", "k", F.col("x.word").alias("word"), F.col("x.n").alias("m"))
    each = each.filter(F.col("m") >= VOCAB_BESIDE)
    met = each.select("word", "k", F.explode("ws").alias("o")).select("word", "k", F.col("o.word").alias("o")).filter("o <> word").groupBy("word", "o").agg(F.sum("k").alias("c"))
    top = met.groupBy("word").agg(F.max(F.struct("c", "o")).alias("t")).select("word", F.col("t.o").alias("top"))
    alone = each.join(top, "word", "left").withColumn("far", F.expr(f"top IS NULL OR NOT exists(ws, x -> x.word <> word AND (levenshtein(x.word, top) <= least({NEAR_EDITS}, length(top) div 3) OR (length(top) >= 4 AND contains(x.word, top))))"))
    # the longest rare word of each name stands for it
    rare = F.expr(f"array_max(transform(filter(ws, x -> length(x.word) >= {RARE_LETTERS} AND x.n <= greatest({RARE_NAMES}, {RARE_SHARE} * m)), x -> struct(length(x.word) AS l, x.word AS word))).word")
    lead = alone.withColumn("rare", rare).withColumn("rare", F.expr("CASE WHEN rare <> word THEN rare END"))
    near = lead.groupBy("word").agg(F.count_distinct("rare").alias("beside"), F.coalesce(F.sum(F.expr("CASE WHEN far THEN k END")), F.lit(0)).alias("apart"), F.count_distinct(F.expr("CASE WHEN far THEN rare END")).alias("beside_apart"))
    return n.join(near, "word", "left").fillna(0, ["beside", "apart", "beside_apart"])


def is_vocabulary() -> Column:
    """Of the rows of word_stats: coined words of a large organisation have few rare words beside them without its other words."""
    few = (F.col("beside_apart") < VOCAB_BESIDE) & (F.col("n") > RARE_NAMES)
    return (F.col("beside") >= VOCAB_BESIDE) & (F.col("beside_apart") >= VOCAB_APART * F.col("apart")) & ~few


def is_abbreviation(short: str, word: str) -> bool:
    """A beginning of the word, or its first letter with later letters in order that are mostly consonants."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    if len(short) >= 3 and word.startswith(short):
        return True
    body = short.rstrip("s") if not word.endswith("s") else short
    rest = iter(word)
    if not all(c in rest for c in body):
        return False
    return len(short) >= 3 and sum(c in "aeiou" for c in short[1:]) <= max(1, len(short) // 3)


class Vocabulary:
    """The words, what each stands for, and what kind of word that is: 'lead', 'line' or 'generic'."""

    def __init__(self, stats: list[tuple[str, int, int, int]], names: int, alias: dict[str, str] | None = None):
        """stats: word, names, in first place, without the closest companion. alias: what words stand for that are no given names; without it every word stands for itself."""
        self.n = {w: n for w, n, *_ in stats if w not in ADDED}
        first, apart = {w: f for w, _, f, _ in stats}, {w: a for w, _, _, a in stats}
        leads = {w for w, n in self.n.items() if first[w] >= 0.5 * n}
        self.by_letter: dict[str, list[str]] = defaultdict(list)
        self.canon: dict[str, str] = {}
        self.bones: dict[str, str] = {}
        for w in sorted(self.n, key=lambda w: (-self.n[w], w)):
            own = w in leads or alias is None
            self.canon[w] = w if own else alias.get(w) or self.explain(w, 3 * self.n[w]) or w
            self.by_letter[w[0]].append(w)
            if len(w) >= 5:
                self.bones.setdefault(bones(w), w)
        for w in self.canon:
            seen = {w}
            while self.canon[self.canon[w]] != self.canon[w] and self.canon[w] not in seen:
                seen.add(self.canon[w])
                self.canon[w] = self.canon[self.canon[w]]
        total, lead, wide = defaultdict(int), defaultdict(int), defaultdict(int)
        for w, c in self.canon.items():
            total[c] += self.n[w]
            wide[c] += apart[w]
            lead[c] += first[w]
        self.kind = {c: "generic" if wide[c] >= GENERIC_SHARE * names and lead[c] < 0.5 * total[c] else "lead" if lead[c] >= 0.5 * total[c] else "line" for c in total}
        self.memo: dict[str, tuple[str, ...] | None] = {}

    def explain(self, t: str, least: int = 0) -> str | None:
        """The word of the vocabulary with the highest posterior for the spelling t, if any explains it."""
        best, score = None, -math.inf
        same = self.bones.get(bones(t)) if len(t) >= 5 else None
        for w in self.by_letter.get(t[0], []) if same is None else [same, *self.by_letter.get(t[0], [])]:
            if self.n[w] < least or len(w) < 4:
                continue
            most = 2 if len(w) >= 8 and len(t) >= 7 else 1 if len(w) >= 5 else 0
            k = edits(t, w, most) if most else 9
            cost = 2.0 * k if k <= most else 2.5 if w == same and abs(len(t) - len(w)) <= 2 else 2.5 if len(t) >= 3 and w.startswith(t) else 3.5 if is_abbreviation(t, w) else None
            if cost is not None and math.log(self.n[w]) - cost > score:
                best, score = w, math.log(self.n[w]) - cost
        if best is None and len(t) >= 6:  # a typo in the first letter
            for w in self.n:
                if w[0] != t[0] and self.n[w] >= least and len(w) >= 6 and w[1:4] == t[1:4] and edits(t, w, 1) <= 1:
                    return w
        return best

    def _word(self, t: str) -> tuple[tuple[str, ...], tuple[str, ...] | None]:
        """The likely reading of a token and another one: words of the vocabulary, and what is coined behind a mark."""
        if t in self.canon:
            return (t,), None
        coined = (COINED + t,)
        if len(t) < 3:
            return coined, None
        w = self.explain(t)
        if w:
            # short pieces and beginnings may be coined after all
            return (w,), coined if len(t) <= WEAK_LETTERS or edits(t, w, 2) > 2 else None
        if len(t) >= 9:
            for k in range(4, len(t) - 2):
                a, b = t[:k], t[k:]
                for x, y in ((a, b), (b, a)):
                    if len(x) >= 5 and x in self.canon:
                        other = y if y in self.canon else self.explain(y) if len(y) >= 3 else None
                        if other:
                            return (x, other), None
            for k in range(4, len(t) - 3):
                a, b = t[:k], t[k:]
                if len(a) >= 5 and a in self.canon:
                    return (a, COINED + b), coined
                if len(b) >= 5 and b in self.canon:
                    return (b, COINED + a), coined
        if len(t) >= 8:
            for k in range(len(t) - 5, 2, -1):  # the longest word first: a short one, or one of the same consonants
                for x, y in ((t[:k], t[k:]), (t[-k:], t[:-k])):
                    v = x if x in self.canon else self.bones.get(bones(x)) if k >= 5 else None
                    if v and (v == x or edits(x, v, 2) <= 2):
                        return coined, (v, COINED + y)
        return coined, None

    def _remember(self, t: str) -> tuple[tuple[str, ...], tuple[str, ...] | None]:
        if len(self.memo) > 1 << 18:
            self.memo.clear()
        got = self.memo[t] = self._word(t)
        return got

    def readings(self, name: str) -> list[list[str]]:
        """The readings of a name as words, coined words and initials (behind their marks), the likely one first. Each other
        one reads one token in another way."""
        items: list[tuple[tuple[str, ...], tuple[str, ...] | None]] = []
        for t in name.split():
            if any(c.isdigit() for c in t):
                if t.isdigit():
                    continue
                t = t.translate(LOOKALIKES)
            if t in ADDED:
                continue
            if len(t) <= 2 and self.kind.get(self.canon.get(t, ""), "") != "lead":
                items.append(((INITIAL + t,), None))
                continue
            items.append(self.memo[t] if t in self.memo else self._remember(t))
        new = [any(x[0] == COINED for x in main) for main, _ in items]
        out = [[x for main, _ in items for x in main]]
        for i, (main, other) in enumerate(items):
            if other and (new[i] or not any(new) or (i and new[i - 1]) or (i + 1 < len(new) and new[i + 1])):
                out.append([x for j, (m, _) in enumerate(items) for x in (other if j == i else m)])
        return out

    def sorted_out(self, items: list[str], name: str) -> tuple[str, str, str, str, bool]:
        """(core, leads, lines, initials, lone) of a reading; a name of common words only is lone, they are its core."""
        core, leads, lines, short = [], set(), set(), []
        for x in items:
            if x[0] == COINED:
                core.append(x[1:])
            elif x[0] == INITIAL:
                short.append(x[1:])
            else:
                w = self.canon[x]
                if self.kind[w] == "lead":
                    leads.add(w)
                elif self.kind[w] == "line":
                    lines.add(w)
        lone = not core
        return " ".join(core or sorted(leads | lines) or short or name.split()), " ".join(sorted(leads)), " ".join(sorted(lines)), " ".join(short), lone

    def parse(self, name: str) -> tuple[list[str], list[str], list[str], list[str]]:
        """(core words, leads, lines, initials) of the likely reading of a name."""
        core, lead, line, short, lone = self.sorted_out(self.readings(name)[0], name)
        return [] if lone else core.split(), lead.split(), line.split(), short.split()


def _read(vocab: Vocabulary):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, items, main = [], [], []
            for i, name in enumerate(b.column(0).to_pylist()):
                got = vocab.readings(name)
                at += [i] * len(got)
                items += got
                main += [True] + [False] * (len(got) - 1)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(at, pa.int64())).columns, pa.array(items, pa.list_(pa.string())), pa.array(main, pa.bool_())], names=["name", "k", "items", "main"])

    return walk


def _parsed(vocab: Vocabulary):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [vocab.sorted_out(i, n) for n, i in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            cols = list(zip(*rows)) if rows else [()] * 5
            types = [pa.string()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["name", "k", "main", "core", "lead", "line", "short", "lone"])

    return walk


def _like_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dice: how alike a core and its root are."""
    for b in batches:
        d, _ = dice_and_overlap(*[sketches([x.replace(" ", "").encode() for x in b.column(c).to_pylist()]) for c in ("core", "root")])
        same = np.array([x == y for x, y in zip(b.column("core").to_pylist(), b.column("root").to_pylist())], bool)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(same, 1.0, d.astype(np.float64)))], names=[*b.schema.names, "dice"])


def compatible(a: tuple[frozenset, frozenset, tuple], b: tuple[frozenset, frozenset, tuple], same: frozenset = frozenset()) -> float | None:
    """The log-likelihood of a form as a spelling of another, or None where they contradict each other. same has the pairs of
    given names that mean one."""
    (la, na, sa), (lb, nb, sb) = a, b
    cost = 0.0
    if la and lb:
        x, y = la - lb, lb - la
        if x and y:
            if not any((len(p) == 1 and q[0] == p) or (len(q) == 1 and p[0] == q) or (p, q) in same for p in x for q in y):
                return None
            cost += 0.5
    elif la or lb:
        cost += 1.0
        have, short = (la, sb) if la else (lb, sa)
        if any(s in {h[0] for h in have} for s in short):
            cost -= 0.5
    if na - nb and nb - na:
        return None
    cost += 0.7 * len(na ^ nb)
    return -cost


def attribute(forms: list[tuple[str, str, str, int]], same: frozenset = frozenset()) -> list[int]:
    """The organisation of each form (lead, line, short, count) of one core, as the index of its canonical form."""
    parsed = [(frozenset(le.split()), frozenset(li.split()), tuple(sh.split())) for le, li, sh, _ in forms]
    order = sorted(range(len(forms)), key=lambda i: (-(bool(parsed[i][0]) + bool(parsed[i][1])), -forms[i][3], -len(parsed[i][1]), forms[i]))
    heads: list[list] = []  # [index, form, count]
    out = [0] * len(forms)
    for i in order:
        best, score = None, -math.inf
        for h in heads:
            ll = compatible(parsed[i], h[1], same)
            if ll is not None and ll + math.log(h[2]) > score:
                best, score = h, ll + math.log(h[2])
        if best is None:
            heads.append([i, parsed[i], forms[i][3]])
            out[i] = i
        else:
            out[i] = best[0]
            best[1] = (best[1][0] | parsed[i][0], best[1][1] | parsed[i][1], best[1][2])
            best[2] += forms[i][3]
    return out


def _organised(same: frozenset):
    def organise(key: tuple, forms: list[tuple]) -> list[tuple]:
        forms = sorted(forms)
        return [(*key, *form[:3], org) for form, org in zip(forms, attribute(forms, same))]

    return organise


def met(parsed: DataFrame, kind: str, share: float) -> DataFrame:
    """(w, o, c, n, m): words of one kind that stand with the same cores in at least this share of those of the rarer one, w,
    three at least."""
    words = parsed.filter("NOT lone").select("core", F.explode(tokens_of(F.col(kind))).alias("w")).distinct()
    n = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    both = words.alias("x").join(words.alias("y"), F.expr("x.core = y.core AND x.w <> y.w")).groupBy(F.expr("x.w").alias("w"), F.expr("y.w").alias("o")).agg(F.count(F.lit(1)).alias("c"))
    all_ = both.join(n, "w").join(n.select(F.col("w").alias("o"), F.col("n").alias("m")), "o")
    return all_.filter((F.col("m") >= F.col("n")) & (F.col("c") >= 3) & (F.col("c") >= share * F.col("n")))


def learned_aliases(parsed: DataFrame) -> dict[str, str]:
    """Spellings of lines of business: most cores of the rarer one also have the other."""
    best = met(parsed, "line", 0.3).filter("m > n").groupBy("w").agg(F.max(F.struct("c", "m", "o")).alias("b")).select("w", "b.o").collect()  # words of the vocabulary only
    return {r.w: r.o for r in best}


def learned_names(parsed: DataFrame) -> frozenset[tuple[str, str]]:
    """Pairs of given names, both ways, of which one is a form of the other. A name may be short for several."""
    rows = met(parsed, "lead", 0.12).select("w", "o").collect()  # words of the vocabulary only
    return frozenset(p for r in rows for p in ((r.w, r.o), (r.o, r.w)))


def organisations(df: DataFrame, id_col: str = "eid", name_col: str = "n_core") -> DataFrame:
    """(id, org): the records with a name and the organisation it means."""
    records = df.select(F.col(id_col).cast("long").alias("id"), F.trim(F.col(name_col)).alias("name")).filter("id IS NOT NULL AND name <> ''").distinct()
    records = cut(records, "names")
    n = records.count()
    stats = word_stats(records).filter((F.col("n") >= F.lit(max(2.0, VOCAB_SHARE * n))) & is_vocabulary())
    rows = [(r.word, r.n, r.first, r.apart) for r in stats.select("word", "n", "first", "apart").collect()]
    spellings = records.groupBy("name").agg(F.count(F.lit(1)).alias("k")).repartition(spread(n), "name")
    vocab = Vocabulary(rows, n)
    read = cut(spellings.mapInArrow(_read(vocab), "name string, k long, items array<string>, main boolean"), "readings")
    fields = "name string, k long, main boolean, core string, lead string, line string, short string, lone boolean"
    likely = cut(read.filter("main").mapInArrow(_parsed(vocab), fields), "parsed")
    same = learned_names(likely)
    vocab = Vocabulary(rows, n, learned_aliases(likely))
    parsed = cut(read.mapInArrow(_parsed(vocab), fields), "parsed")
    cores = parsed.filter("NOT lone").groupBy("core").agg(F.sum(F.expr("CASE WHEN main THEN k ELSE 0 END")).alias("k"))
    roots = attach(cores.withColumn("part", F.lit(""))).select("core", "root")
    rooted = parsed.join(roots, "core", "left").withColumn("root", F.coalesce("root", "core"))
    rooted = cut(rooted.withColumn("root", F.when(F.col("lone"), F.concat(F.lit("="), "root")).otherwise(F.col("root"))), "rooted")
    # of the readings of a name, the one whose core most other names have, and that is most like it
    held = rooted.filter("main").groupBy("root").agg(F.sum("k").alias("held"))
    post = F.log(1 + F.coalesce("held", F.lit(0)) - F.when(F.col("main"), F.col("k")).otherwise(0))
    post = post - F.when(F.col("main"), 0.0).otherwise(OTHER_READING + 6 * (1 - F.col("dice"))) - F.when(F.col("lone"), LONE).otherwise(0.0)
    several = rooted.join(rooted.filter("NOT main").select("name").distinct(), "name", "left_semi").select("root", *[c.split()[0] for c in fields.split(", ")])
    like = cut(several.mapInArrow(_like_root, f"root string, {fields}, dice double"), "rooted")
    best = like.join(held, "root", "left").groupBy("name").agg(F.max(F.struct(post.alias("p"), "main", "core", "root", "lead", "line", "short", "k")).alias("b"))
    cols = ["name", "core", "root", "lead", "line", "short", "k"]
    rooted = cut(best.select("name", "b.*").select(*cols).union(rooted.join(like.select("name").distinct(), "name", "left_anti").select(*cols)), "rooted")
    forms = rooted.groupBy("root", "lead", "line", "short").agg(F.sum("k").alias("k"))
    orgs = over_groups(forms, ["root"], ["lead", "line", "short", "k"], _organised(same), "root string, lead string, line string, short string, org int")
    named = rooted.join(orgs, ["root", "lead", "line", "short"]).select("name", F.concat_ws("|", "root", F.col("org").cast("string")).alias("org"))
    return records.join(named, "name").select(F.col("id").alias(id_col), "org")


def same_organisation(df: DataFrame, id_col: str = "eid", name_col: str = "n_core") -> DataFrame:
    """(eid_a, eid_b), eid_a < eid_b: the pairs of records whose names mean one organisation."""
    orgs = cut(organisations(df, id_col, name_col).withColumnRenamed(id_col, "id"), "organisations")
    return orgs.alias("x").join(orgs.alias("y"), F.expr("x.org = y.org AND x.id < y.id")).select(F.expr("x.id AS eid_a"), F.expr("y.id AS eid_b")).distinct()
