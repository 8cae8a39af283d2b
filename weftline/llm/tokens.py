"""Sizes in tokens of a public tokenizer, and a place on a space-filling curve, for whole texts.

A text is cut only where the tokenizer's own pattern surely starts a new piece: at a space between two characters that
are no white space. The pieces are hashed as arrays; the tokenizer runs once per distinct piece and worker, so the count
is that of the whole text while most of the work is array work.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's ranks, and the pattern that splits text before the merges.
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DIMS, BITS = 3, 16
_LONGEST = 48
_SLOTS = 1 << 18
_KEPT = 1 << 21
_BLOCK = 1 << 20

_RNG = np.random.default_rng(77_001)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, _LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes that are, or may belong to, white space (control characters count as such).
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True


def encoder(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def piece_starts(b: np.ndarray) -> np.ndarray:
    """Where a buffer may be cut: True at a space with a character that is surely no white space on both sides."""
    solid = _SOLID[b]
    latin = b == 0xC3  # the lead byte of À to ÿ: letters and two signs
    before = np.zeros(len(b), bool)
    before[1:] = solid[:-1]
    before[2:] |= latin[:-2] & (b[1:-1] >= 0x80)
    after = np.zeros(len(b), bool)
    after[:-1] = solid[1:] | latin[1:]
    return (b == 32) & before & after


class Counter:
    """Counts tokens of many texts at once and sums the signs of their hashed pieces."""

    def __init__(self, ranks: bytes):
        self.enc = encoder(ranks)
        self.key = np.zeros(_SLOTS, np.uint64)
        self.cnt = np.zeros(_SLOTS, np.int32)
        self.known: dict[int, int] = {}

    def _lookup(self, digest: np.ndarray, b: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        slot = (digest >> np.uint64(64 - 18)).astype(np.int64)
        n = self.cnt[slot]
        miss = np.flatnonzero(self.key[slot] != digest)
        if len(miss):
            new, first, back = np.unique(digest[miss], return_index=True, return_inverse=True)
            got = np.empty(len(new), np.int32)
            for k, (d, at) in enumerate(zip(new.tolist(), miss[first].tolist())):
                c = self.known.get(d)
                if c is None:
                    c = len(self.enc.encode_ordinary(b[starts[at] : ends[at]].decode("utf-8")))
                    self.known[d] = c
                got[k] = c
            if len(self.known) > _KEPT:
                self.known.clear()
            n[miss] = got[back]
            at = (new >> np.uint64(64 - 18)).astype(np.int64)
            self.key[at], self.cnt[at] = new, got
        return n

    def measure(self, texts: list[bytes]):
        """(tokens, signs, pieces) of texts that are not empty."""
        raw = b"".join(texts)
        b = np.frombuffer(raw, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lens) - lens
        cuts = piece_starts(b)
        cuts[first] = True
        starts = np.flatnonzero(cuts)
        ends = np.r_[starts[1:], len(b)]
        size = ends - starts
        place = np.arange(len(b)) - np.repeat(starts, size)
        long = size > _LONGEST
        np.minimum(place, _LONGEST - 1, out=place)
        digest = np.add.reduceat(_BYTE[b] * _PLACE[place], starts)
        digest = (digest ^ (digest >> np.uint64(31))) * _PLACE[0]
        digest |= np.uint64(1)
        n = np.zeros(len(starts), np.int32)
        short = np.flatnonzero(~long)
        n[short] = self._lookup(digest[short], raw, starts[short], ends[short])
        for k in np.flatnonzero(long):
            n[k] = len(self.enc.encode_ordinary(raw[starts[k] : ends[k]].decode("utf-8")))
        at = np.searchsorted(starts, first)
        tokens = np.add.reduceat(n.astype(np.int64), at)
        pieces = np.diff(np.r_[at, len(starts)])
        signs = np.stack([np.add.reduceat(((digest >> np.uint64(20 + 9 * d)) & np.uint64(1)).astype(np.int64) * 2 - 1, at) for d in range(DIMS)], axis=1)
        return tokens, signs, pieces


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The index of points on the Hilbert curve: x is (points, dims) of integers under 2**bits.

    The coordinates become the transposed index bit by bit from the highest (Skilling's transform), then interleave."""
    x = x.astype(np.int64).copy()
    dims = x.shape[1]
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        for i in range(dims):
            up = (x[:, i] & q) != 0
            low = (x[:, 0] ^ x[:, i]) & (q - 1)
            x[:, 0] ^= np.where(up, q - 1, low)
            x[:, i] ^= np.where(up, 0, low)
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        t ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for k in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | ((x[:, i] >> k) & 1)
    return out


def curve_key(signs: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Hashed bag-of-pieces vectors, projected to DIMS means of signs, as a place on the curve."""
    mean = signs / np.maximum(pieces, 1)[:, None]
    return hilbert(np.clip((mean * 1.5 + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


_counters: dict[int, Counter] = {}


def measured(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = (), vocab: str = VOCAB) -> DataFrame:
    """(id, *carry, n_tokens, place): the size of each text in tokens and its place on the curve.

    A null text has null size and place 0, an empty one size 0. vocab is a file of ranks; the driver reads it and sends
    its bytes (under 2 MB, checked) to the tasks."""
    with open(vocab, "rb") as f:
        ranks = f.read()
    if len(ranks) > 16 << 20:
        raise ValueError("a vocabulary of more than 16 MB")
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(ranks)
    cols = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("text"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = zlib.crc32(sent.value)
        got = _counters.get(name)
        if got is None:
            got = _counters[name] = Counter(sent.value)
        for batch in batches:
            texts = batch.column(len(carry) + 1).cast(pa.binary()).to_pylist()
            n = np.zeros(len(texts), np.int64)
            place = np.zeros(len(texts), np.int64)
            held: list[int] = []
            size = 0
            for i, t in enumerate(texts):
                if t:
                    held.append(i)
                    size += len(t)
                if held and (size >= _BLOCK or i + 1 == len(texts)):
                    tokens, signs, pieces = got.measure([texts[k] for k in held])
                    n[held], place[held] = tokens, curve_key(signs, pieces)
                    held, size = [], 0
            size_ = pa.array(n, mask=np.array([t is None for t in texts], bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[1:-1], size_, pa.array(place)], names=["id", *[f"c{i}" for i in range(len(carry))], "n_tokens", "place"])

    schema = "id long, " + "".join(f"c{i} string, " for i in range(len(carry))) + "n_tokens long, place long"
    out = cols.mapInArrow(walk, schema)
    return out.select(F.col("id").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_tokens", "place")
