"""Canonical spellings: every text goes to the more frequent text of its part that explains it best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.match import bones
from weftline.llm.sketch import dice_and_overlap, sketches
from weftline.session import cut

#: Sketches this alike are spellings of one text; those above LEAST_DICE only with few edits.
LEAST_DICE, SURE_DICE, MOST_EDITS = 0.5, 0.75, 3
#: Letters above which a text is blocked by its ends, and words above which its order is blocked by the sorted words.
LONG, MANY_WORDS = 40, 8


def deletions(b: str) -> set[str]:
    """A text and, from four letters on, the texts with one letter left out. Of a long text its two ends stand for those: one of
    them bears any single edit."""
    if len(b) > LONG:
        return {b, "<" + b[: LONG // 2], ">" + b[-LONG // 2 :]}
    return {b} | ({b[:i] + b[i + 1 :] for i in range(len(b))} if len(b) >= 4 else set())


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def keys_of(text: str) -> list[str]:
    """Blocking keys: the consonants, those with one left out, for every rotation of the words (of many words as they stand and sorted); long words, and the text
    without one word."""
    words = text.split()
    turns = {"".join(words[i:] + words[:i]) for i in range(len(words))} if len(words) <= MANY_WORDS else {"".join(words), "".join(sorted(words))}
    out: set[str] = set()
    for t in turns:
        out |= deletions(bones(t))
    out |= {"=" + bones(w) for w in words if len(w) >= 6}
    for i in range(len(words)):
        rest = "".join(words[:i] + words[i + 1 :])
        if len(rest) >= 8:
            out.add(bones(rest))
    return sorted(out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, key = [], []
        for i, c in enumerate(b.column(1).to_pylist()):
            ks = keys_of(c)
            at += [i] * len(ks)
            key += ks
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), *b.take(pa.array(at, pa.int64())).columns], names=["key", "part", "core", "k"])


def _part_of(a: str, b: str) -> bool:
    words = a.split()
    return (len(words) > 1 or len(a) >= 6) and sum(map(len, words)) >= 6 and set(words) < set(b.split())


def _other_word(a: list[str], b: list[str]) -> bool:
    """Whether two texts differ by a whole word: one more, or another one in the same place."""
    if set(a) < set(b) or set(b) < set(a):
        return True
    if abs(len(a) - len(b)) == 1:  # a word more beside misspelt others, not a word that is split
        long, short = (a, "".join(b)) if len(a) > len(b) else (b, "".join(a))
        whole = edits("".join(long), short, 3)
        return any(edits("".join(long[:i] + long[i + 1 :]), short, 2) < min(whole, 3) for i in range(len(long)))
    return len(a) == len(b) and any(p != q and edits(p, q, 3) > (1 if min(len(p), len(q)) <= 5 else 3) for p, q in zip(a, b))


def _scores(drop_words: bool):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).to_pylist() for c in ("core", "to"))
            d, _ = dice_and_overlap(*[sketches([s.replace(" ", "").encode() for s in v]) for v in (x, y)])
            if drop_words:  # some words of a text may stand for all of it
                alone = np.array([_part_of(p, q) or _part_of(q, p) for p, q in zip(x, y)], bool)
                score = np.where(alone, np.maximum(d, SURE_DICE), d).astype(np.float64)
            else:
                other = np.array([_other_word(p.split(), q.split()) for p, q in zip(x, y)], bool)
                score = np.where(other, 0.0, d).astype(np.float64)
            for i in np.flatnonzero((score >= LEAST_DICE) & (score < SURE_DICE)):
                p, words = x[i].replace(" ", ""), y[i].split()
                turns = range(len(words) if drop_words and len(words) <= MANY_WORDS else 1)
                if all(edits(p, "".join(words[t:] + words[:t]), MOST_EDITS) > MOST_EDITS for t in turns):
                    score[i] = 0.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=["part", "core", "to", "k", "dice"])

    return walk


def attach(cores: DataFrame, drop_words: bool = True) -> DataFrame:
    """(part, core, root): every text that is attached, with its canonical text. cores: part, core, k (how often it stands).

    k is 0 where a text is only a reading that nothing goes to. A text goes to that of higher rank (k, then smaller text) with the highest log k + 6 * dice, of all that share a block with it; those that are attached
    themselves pass their followers on until all stand at a text that is attached to none. Without drop_words, a text with
    one word more, or with another word, is another text."""
    blocks = cut(cores.select("part", "core", "k").mapInArrow(_blocks, "key string, part string, core string, k long"), "core_keys")
    better = "x.part = y.part AND x.key = y.key AND y.k > 0 AND (y.k > x.k OR (y.k = x.k AND y.core < x.core))"
    pairs = blocks.alias("x").join(blocks.alias("y"), F.expr(better)).select("x.part", "x.core", F.col("y.core").alias("to"), "y.k").distinct()
    scored = pairs.mapInArrow(_scores(drop_words), "part string, core string, to string, k long, dice double").filter(F.col("dice") >= LEAST_DICE)
    post = F.log("k") + 6 * F.col("dice")
    up = cut(scored.groupBy("part", "core").agg(F.max(F.struct(post.alias("p"), "to")).alias("b")).select("part", "core", F.col("b.to").alias("root")), "cores")
    while True:
        step = up.select("part", F.col("core").alias("root"), F.col("root").alias("next"))
        moved = cut(up.join(step, ["part", "root"], "left").select("part", "core", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "cores")
        up = moved.select("part", "core", "root")
        if moved.filter("moved").isEmpty():
            return up
