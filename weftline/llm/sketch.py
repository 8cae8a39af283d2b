"""Bit sketches of short texts, compared as arrays.

A text becomes the set of its hashed character pairs in WIDTH bits; overlap of sketches stands for overlap of the texts.
It bears typos, glued and split words and any order of words, and a batch of texts or pairs costs a few array passes."""

from __future__ import annotations

import numpy as np

WIDTH = 256


def of_rows(b: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, WIDTH / 64) words: the pairs of neighbouring bytes of each row; row (ascending) has the row of each byte."""
    out = np.zeros((n, WIDTH), bool)
    if len(b) > 1:
        b = b.astype(np.uint32)
        code = (b[:-1] * np.uint32(2654435761) + b[1:] * np.uint32(2246822519)) >> np.uint32(24)
        same = row[:-1] == row[1:]
        out[row[:-1][same], code[same]] = True
    return np.packbits(out, axis=1).view(np.uint64)


def sketches(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    return of_rows(np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(n), np.fromiter(map(len, texts), np.int64, n)), n)


def weight(s: np.ndarray) -> np.ndarray:
    return np.bitwise_count(s).sum(axis=-1).astype(np.float32)


def dice_and_overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared bits over the mean and over the smaller of the two sketches; 0 where one is empty."""
    wa, wb, both = weight(a), weight(b), weight(a & b)
    return 2 * both / np.maximum(wa + wb, 1), both / np.maximum(np.minimum(wa, wb), 1)
