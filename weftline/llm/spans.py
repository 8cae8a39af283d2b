"""Problem 8: long exact spans shared between records.

Method: content-defined chunking with a gear rolling hash. Cut points are the positions whose gear hash (over HASH_BYTES
bytes) is the smallest of some window of `reach` consecutive positions, the rightmost where equal; they depend on nothing
but nearby text, so an insertion moves no cut but those beside it, and every run of MIN_CHARS characters holds a
cut in its first `reach` positions. The digest of a chunk covers the text from the start of the hash window of its cut
over as many bytes as lie in any such run, whatever the cut: two texts with a run in common share at least one
digest, so no run is missed. Digests are grouped, and only those of two or more texts go on:

- Consecutive shared digests of two texts on one diagonal that overlap prove a run by themselves.
- Where they prove less than MIN_CHARS, the texts around the digest are fetched and compared character by character.
- A digest of many texts, or often in one text, would give all pairs of its holders although most may only share a
  stock phrase. Its occurrences are instead split by the digests of all windows of exactly MIN_CHARS characters around
  it; only holders of the same window are paired, which are links themselves, and windows with the same holders
  count once.

Exact copies are one class: they are cut once per task, one text stands for the class, and the members come back at the
end. Null and short texts (under min_chars code points) have no span. Everything is in code points, as stored. Texts of
any length are cut in blocks that overlap by more than a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.groups import over_groups
from weftline.session import cut

MIN_CHARS = 200
HASH_BYTES = 16
#: A digest with more holders, or more often in one text, is split by exact windows.
HOT_HOLDERS, HOT_REPEATS = 48, 4
#: Bytes that are hashed at once.
BLOCK_BYTES = 1 << 20
#: Bits of the filter on texts to fetch: a multiple of their number, from 16 KB to 4 MB. With more texts it lets more pass.
BITS_FOR_A_TEXT, LEAST_BITS, MOST_BITS = 8, 1 << 17, 1 << 25

_RNG = np.random.default_rng(20_240_501)
GEAR = _RNG.integers(0, 1 << 32, 256, dtype=np.uint32)
_MIX = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def reach_of(min_chars: int) -> int:
    return (min_chars - HASH_BYTES + 1) // 2


def _cuts(b: np.ndarray, reach: int) -> np.ndarray:
    """For each window of `reach` hash positions (by its first byte), the place of its cut; b is one buffer of bytes."""
    h, k = GEAR[b], 1
    while k < HASH_BYTES:
        h[k:] = h[k:] + (h[:-k] << np.uint32(2 * k))  # the right side is computed before it is assigned
        k *= 2
    at = h.astype(np.uint64)
    at <<= np.uint64(32)
    at |= np.arange(len(b) - 1, -1, -1, dtype=np.uint64)
    span = 1
    while span * 2 <= reach:
        at = np.minimum(at[:-span], at[span:])
        span *= 2
    if span < reach:
        d = reach - span
        at = np.minimum(at[:-d], at[d:])
    at &= np.uint64(0xFFFFFFFF)
    return len(b) - 1 - at.astype(np.int64)


def digests(rows: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row of a matrix of bytes."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    w = words.view(np.uint64)
    out = np.full(n, int(_MIX[-1]) * width % (1 << 64), np.uint64)
    for j in range(w.shape[1]):
        out ^= w[:, j] * _MIX[j % 63]
        out = (out ^ (out >> np.uint64(29))) * _MIX[(j + 7) % 63]
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


def chunk_keys(texts: list[bytes], reach: int, span: int):
    """(text index, digest, position << 8 | length): chunks of texts that are each at least reach * 2 + HASH_BYTES long.

    position counts code points before the digest's text, length those wholly in it."""
    b = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    starts = ends - lens
    place = _cuts(b, reach)
    # windows that lie in one text
    use = np.zeros(len(b) + 1, np.int32)
    np.add.at(use, starts + HASH_BYTES - 1, 1)
    np.add.at(use, np.maximum(ends - reach + 1, starts + HASH_BYTES - 1), -1)
    inside = np.cumsum(use[: len(place)]) > 0
    p = place[inside]
    p = p[np.r_[True, p[1:] != p[:-1]]] if len(p) else p
    first = p - HASH_BYTES + 1
    which = np.searchsorted(ends, p, side="right")
    ok = first + span <= ends[which]
    first, which = first[ok], which[ok]
    if not len(first):
        return which, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = digests(np.lib.stride_tricks.sliding_window_view(b, span)[first])
    lead = (b & 0xC0) != 0x80
    before = np.zeros(len(b) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    stop = first + span
    broken = (stop < len(b)) & ~np.r_[lead, True][stop]  # its last character goes on
    length = before[stop] - before[first] - broken
    pos = before[first] - before[starts[which]]
    return which, key, pos << 8 | length


def _key_batches(min_chars: int, block_bytes: int):
    reach = reach_of(min_chars)
    span = min_chars - reach + 1
    overlap = 4 * (min_chars + span) + 8

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        ids: list[int] = []
        shift: list[int] = []
        held: list[bytes] = []
        size = 0

        def flush():
            which, key, pos = chunk_keys(held, reach, span)
            return pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(np.array(ids, np.int64)[which]), pa.array(pos + (np.array(shift, np.int64)[which] << 8))], names=["h", "doc", "p"]
            )

        for batch in batches:
            for doc, text, md5 in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
                if md5 in seen:
                    continue
                seen.add(md5)
                raw, done, chars = text.as_py(), 0, 0
                while True:
                    stop = done + block_bytes
                    while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                        stop -= 1
                    part = raw[done:stop]
                    if len(part) < overlap and done:
                        break
                    if len(part) >= 2 * reach + HASH_BYTES:
                        ids.append(doc)
                        shift.append(chars)
                        held.append(part)
                        size += len(part)
                    if size >= block_bytes:
                        yield flush()
                        ids, shift, held, size = [], [], [], 0
                    if stop >= len(raw):
                        break
                    step = block_bytes - overlap
                    while raw[done + step] & 0xC0 == 0x80:
                        step -= 1
                    chars += int(np.count_nonzero((np.frombuffer(raw, np.uint8, step, done) & 0xC0) != 0x80))
                    done += step
        if held:
            yield flush()

    return walk


def _bits(ids: DataFrame) -> bytes:
    """A filter of bounded size on a column of ids: made by the tasks, joined by the driver in MOST_BITS / 8 bytes at most."""
    n = ids.agg(F.count_distinct(ids.columns[0])).collect()[0][0]
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_FOR_A_TEXT * n).bit_length()))

    def part(batches):
        bits = np.zeros(size, bool)
        for b in batches:
            bits[b.column(0).to_numpy()] = True
        parts = np.packbits(bits).reshape(-1, 4096)
        at = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([parts[i].tobytes() for i in at], pa.binary()), pa.array(at, pa.int64())], names=["bits", "at"])

    def join(pdf):
        out = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in pdf["bits"]]), axis=0)
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "bits": [out.tobytes()]})

    rows = ids.select(_slot(F.col(ids.columns[0]), size)).mapInArrow(part, "bits binary, at long").groupBy("at").applyInPandas(join, "at long, bits binary").collect()
    by = {r["at"]: bytes(r["bits"]) for r in rows}
    return b"".join(by.get(i, bytes(4096)) for i in range(size // 8 // 4096))


def _slot(c: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(size)).cast("long")


def _may_hold(bits: bytes, c: Column) -> Column:
    slot = _slot(c, 8 * len(bits))
    byte = F.conv(F.hex(F.substring(F.lit(bits), (slot / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), F.lit(7) - slot % 8).cast("int")) > 0


def _classes(docs: DataFrame) -> DataFrame:
    """(doc, rep): every text of a class of exact copies and the class's smallest id."""
    ids = docs.select("doc", "md5").distinct()  # a row may be there twice
    reps = ids.groupBy("md5").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return ids.join(reps, "md5").select("doc", "rep")


class SharedSpans:
    """The stages of one corpus: shared digests once, then links or coverage from them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES):
        if min_chars < 4 * HASH_BYTES or min_chars > 240:
            raise ValueError("min_chars is from 64 to 240")
        self.min_chars, self.reach = min_chars, reach_of(min_chars)
        text = F.col(text_col)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text")).filter(F.char_length("text") >= min_chars)
        tagged = self.docs.withColumn("md5", F.md5("text"))
        self.classes = cut(_classes(tagged), "copies")
        keys = tagged.select("doc", "text", F.unhex("md5").alias("md5")).mapInArrow(_key_batches(min_chars, block_bytes), "h long, doc long, p long")
        keys = cut(keys, "digests")
        # combined before the exchange, so a digest that all texts hold is one row for each task
        two = keys.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("h")
        many = keys.join(two, "h", "left_semi")
        by_rep = many.join(self.classes, "doc", "left").select("h", F.coalesce("rep", "doc").alias("doc"), F.shiftright("p", 8).alias("pos"), F.col("p").bitwiseAND(F.lit(255)).alias("n"))
        self.shared = cut(by_rep.distinct(), "shared")

    def links(self) -> DataFrame:
        """(a, b), a < b: texts of different classes with a run of min_chars characters in common, each pair once."""
        least = self.min_chars
        # two holders at least, once copies are one text
        per = self.shared.groupBy("h", "doc").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.count(F.lit(1)).alias("holders"), F.max("k").alias("k")).filter("holders > 1")
        is_hot = (F.col("holders") > HOT_HOLDERS) | (F.col("k") > HOT_REPEATS)
        rows = cut(self.shared.join(per.select("h", is_hot.alias("hot")), "h"), "holders")
        cold = rows.filter("NOT hot").select("h", "doc", "pos", "n")
        pairs = cold.alias("x").join(cold.alias("y"), F.expr("x.h = y.h AND x.doc < y.doc")).select(F.expr("x.doc AS a"), F.expr("y.doc AS b"), F.expr("x.pos AS pos"), F.expr("x.pos - y.pos AS diag"), F.expr("x.n AS n"))
        w = Window.partitionBy("a", "b", "diag").orderBy("pos")
        ends = pairs.withColumn("reached", F.max(F.expr("pos + n")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        isles = ends.withColumn("isle", F.sum(F.expr("CASE WHEN reached >= pos THEN 0 ELSE 1 END")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        runs = isles.groupBy("a", "b", "diag", "isle").agg(F.min("pos").alias("pos"), F.max(F.expr("pos + n")).alias("stop"))
        best = runs.groupBy("a", "b").agg(F.max(F.expr("stop - pos")).alias("run"), F.collect_set(F.struct("pos", "stop", "diag")).alias("runs"))
        best = cut(best, "runs")
        proven = best.filter(F.col("run") >= least).select("a", "b")
        open_ = best.filter(F.col("run") < least).select("a", "b", F.explode("runs").alias("r")).select("a", "b", "r.pos", "r.stop", "r.diag")
        sides = open_.select(F.col("a").alias("doc"), F.col("pos").alias("pos"), F.col("stop")).union(
            open_.select("b", F.expr("pos - diag"), F.expr("stop - diag"))
        )
        hot = rows.filter("hot").select("doc", "pos", F.expr("pos + n AS stop"))
        need = cut(sides.union(hot).distinct(), "need")
        bits = _bits(need.select("doc"))
        texts = self.docs.filter(_may_hold(bits, F.col("doc")))
        side = F.greatest(F.lit(0), least - (F.col("stop") - F.col("pos")))  # what a run may need beside it
        from_ = F.greatest(F.lit(0), F.col("pos") - side)
        ctx = need.join(texts, "doc").select(
            "doc", "pos", "stop", (F.col("pos") - from_).cast("int").alias("off"),
            F.substring("text", (from_ + 1).cast("int"), (F.col("stop") - from_ + side).cast("int")).alias("ctx"),
        )
        ctx = cut(ctx, "context")
        left = open_.join(ctx.select(F.col("doc").alias("a"), "pos", "stop", F.col("off").alias("oa"), F.col("ctx").alias("ta")), ["a", "pos", "stop"])
        both = left.withColumns({"pb": F.expr("pos - diag"), "sb": F.expr("stop - diag")}).join(
            ctx.select(F.col("doc").alias("b"), F.col("pos").alias("pb"), F.col("stop").alias("sb"), F.col("off").alias("ob"), F.col("ctx").alias("tb")), ["b", "pb", "sb"]
        )
        checked = both.select("a", "b", F.expr("int(stop - pos)").alias("n"), "oa", "ta", "ob", "tb").mapInArrow(_compare(least), "a long, b long")
        hot_ctx = ctx.join(hot.distinct(), ["doc", "pos", "stop"], "left_semi").select("doc", "off", F.expr("int(stop - pos)").alias("n"), "ctx")
        split = hot_ctx.mapInArrow(_windows(least), "d1 long, d2 long, doc long").distinct()
        sig = split.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(doc))").alias("s1"), F.expr("bit_xor(xxhash64(doc, 7L))").alias("s2")).filter("m > 1")
        one = sig.groupBy("m", "s1", "s2").agg(F.min(F.struct("d1", "d2")).alias("d")).select("d.d1", "d.d2")
        held = split.join(one, ["d1", "d2"])
        met = held.alias("x").join(held.alias("y"), F.expr("x.d1 = y.d1 AND x.d2 = y.d2 AND x.doc < y.doc")).select(F.expr("x.doc AS a"), F.expr("y.doc AS b"))
        return proven.union(checked).union(met).distinct()

    def pairs(self, links: DataFrame) -> DataFrame:
        """(doc_a, doc_b): the links with every class spelled out, and the pairs inside a class."""
        member = self.classes.select(F.col("rep"), "doc")
        a = links.join(member.select(F.col("rep").alias("a"), F.col("doc").alias("da")), "a", "left").withColumn("da", F.coalesce("da", "a"))
        ab = a.join(member.select(F.col("rep").alias("b"), F.col("doc").alias("db")), "b", "left").withColumn("db", F.coalesce("db", "b"))
        across = ab.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"))
        inside = member.alias("x").join(member.alias("y"), F.expr("x.rep = y.rep AND x.doc < y.doc")).select(F.expr("x.doc AS doc_a"), F.expr("y.doc AS doc_b"))
        return across.union(inside)

    def coverage(self) -> DataFrame:
        """(doc, shared_chars): code points of each text inside runs of min_chars or more that another text holds too; a text
        with an exact copy counts as a whole (null here).

        Every window of min_chars characters holds a digest, so the windows around the shared digests are all that can be
        shared: those of a digest are compared where they meet, those of a hot one by their own digests."""
        least = self.min_chars
        per = self.shared.groupBy("h", "doc").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.count(F.lit(1)).alias("holders"), F.max("k").alias("k")).filter("holders > 1")
        is_hot = (F.col("holders") > HOT_HOLDERS) | (F.col("k") > HOT_REPEATS)
        rows = cut(self.shared.join(per.select("h", is_hot.alias("hot")), "h"), "holders")
        bits = _bits(rows.select("doc"))
        spots = rows.join(self.docs.filter(_may_hold(bits, F.col("doc"))), "doc").withColumn("lo", F.greatest(F.lit(0), F.expr(f"pos + n - {least}")))
        ctx = spots.select("h", "hot", "doc", "lo", (F.col("pos") - F.col("lo")).cast("int").alias("off"), F.col("n").cast("int").alias("n"), F.expr(f"substring(text, int(lo + 1), int(pos - lo + {least}))").alias("ctx"))
        ctx = cut(ctx, "context")
        cold = over_groups(ctx.filter("NOT hot"), ["h"], ["doc", "lo", "off", "n", "ctx"], _runs(least), "doc long, pos long, stop long")
        split = ctx.filter("hot").select("doc", "lo", "off", "n", "ctx").mapInArrow(_placed_windows(least), "d1 long, d2 long, doc long, pos long")
        two = split.groupBy("d1", "d2").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("d1", "d2")
        hot = split.join(two, ["d1", "d2"], "left_semi").select("doc", "pos", (F.col("pos") + least).alias("stop"))
        rows = cold.union(hot).groupBy("doc", "pos").agg(F.max("stop").alias("stop"))
        w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        new = rows.withColumn("reached", F.coalesce(F.max("stop").over(w), F.lit(0)))
        own = new.groupBy("doc").agg(F.sum(F.expr("greatest(0, stop - greatest(pos, reached))")).alias("shared_chars"))
        return own


def _common(a: str, b: str) -> int:
    """Characters that two texts begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    return lo


def _runs(least: int):
    """The intervals of each holder of a digest that lie in a run of `least` characters of another text. Contexts reach as far
    as a window with the digest does."""

    def walk(key: tuple, rows: list[tuple]) -> list[tuple]:
        out, by = [], {}
        for doc, lo, off, n, ctx in rows:
            by.setdefault((ctx[off : off + n], ctx[:off][::-1], ctx[off + n :]), []).append((doc, lo, off))
        kinds = list(by)
        for k, (mid, left, right) in enumerate(kinds):
            here = by[kinds[k]]
            docs, whole = {d for d, *_ in here}, len(left) + len(mid) + len(right)
            if len(docs) > 1:
                if whole >= least:
                    out += [(d, lo, lo + whole) for d, lo, _ in here]
                continue
            runs = set()
            for m, (mid2, left2, right2) in enumerate(kinds):
                if m != k and mid2 == mid and any(d not in docs for d, *_ in by[kinds[m]]):
                    x, y = _common(left, left2), _common(right, right2)
                    if x + len(mid) + y >= least:
                        runs.add((x, y))
            out += [(d, lo + off - x, lo + off + len(mid) + y) for d, lo, off in here for x, y in runs]
        return out

    return walk


def _placed_windows(least: int):
    """As _windows, with the place of each window."""
    import hashlib

    def walk(batches):
        for b in batches:
            d, docs, at = [], [], []
            for doc, lo, off, n, ctx in zip(*[x.to_pylist() for x in b.columns]):
                for s in range(max(0, off + n - least), min(off, len(ctx) - least) + 1):
                    d.append(hashlib.blake2b(ctx[s : s + least].encode(), digest_size=16).digest())
                    docs.append(doc)
                    at.append(lo + s)
            h = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(docs, pa.int64()), pa.array(at, pa.int64())], names=["d1", "d2", "doc", "pos"])

    return walk


def _compare(least: int):
    def walk(batches):
        for b in batches:
            a_, b_ = [], []
            for a, c, n, oa, ta, ob, tb in zip(*[x.to_pylist() for x in b.columns]):
                left = 0
                while left < min(oa, ob) and ta[oa - left - 1] == tb[ob - left - 1]:
                    left += 1
                i, j, right = oa + n, ob + n, 0
                while i + right < len(ta) and j + right < len(tb) and ta[i + right] == tb[j + right]:
                    right += 1
                if left + n + right >= least:
                    a_.append(a)
                    b_.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], names=["a", "b"])

    return walk


def _windows(least: int):
    """The digests (128 bits) of all windows of `least` characters that hold the chunk's characters."""
    import hashlib

    def walk(batches):
        for b in batches:
            seen = set()
            for doc, off, n, ctx in zip(*[x.to_pylist() for x in b.columns]):
                for s in range(max(0, off + n - least), min(off, len(ctx) - least) + 1):
                    seen.add((hashlib.blake2b(ctx[s : s + least].encode(), digest_size=16).digest(), doc))
            rows = list(seen)
            d = np.frombuffer(b"".join(x for x, _ in rows), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([x for _, x in rows], pa.int64())], names=["d1", "d2", "doc"])

    return walk


def shared_span_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents with a run of at least min_chars code points in common, each pair once."""
    s = SharedSpans(docs, id_col, text_col, min_chars, block_bytes)
    return s.pairs(s.links())


def shared_span_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, class, links): one row for each text of min_chars or more: the smallest id among its exact copies, and how many other
    classes have a run with it in common. Copies are not spelled out as pairs."""
    s = SharedSpans(docs, id_col, text_col, min_chars)
    links = s.links()
    n = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("class")).agg(F.count(F.lit(1)).alias("links"))
    own = s.docs.select("doc").distinct().join(s.classes, "doc", "left").select(F.col("doc").alias(id_col), F.coalesce("rep", "doc").alias("class"))
    return own.join(n, "class", "left").select(id_col, "class", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def shared_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): how much of each text stands elsewhere, in runs of min_chars or more.

    Null texts have null counts, empty and short ones 0."""
    s = SharedSpans(docs, id_col, text_col, min_chars)
    ids = docs.select(F.col(id_col).cast("long").alias("doc"), F.char_length(text_col).cast("long").alias("n_chars"))
    rep = s.classes.withColumn("copied", F.lit(True))
    own = ids.join(rep, "doc", "left").join(s.coverage(), "doc", "left")
    n = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.when(F.col("n_chars").isNotNull(), F.coalesce("shared_chars", F.lit(0)))).cast("long")
    return own.select(F.col("doc").alias(id_col), "n_chars", n.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(n / F.col("n_chars"), 6)).otherwise(n.cast("double")).alias("share"))
