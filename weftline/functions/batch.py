"""The similarities of many pairs of texts at once: the numbers of weftline.functions.similarity, one numpy call for all pairs.

A batch is cut into runs of pairs of like lengths; in a run each text is a column of code points, filled up with codes that
equal nothing. Texts may be of any length, the width of the integers follows it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Cells of a run's table of texts, so that it stays in the cache of a core.
RUN_CELLS = 1 << 16
MOST_LANES = 1024

Texts = Sequence[str]


class _Codes:
    """Texts of both sides as one array of small codes."""

    def __init__(self, xs: Texts, ys: Texts):
        flat = np.frombuffer("".join([*xs, *ys]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(flat) and flat.max() >= 254:
            known, flat = np.unique(flat, return_inverse=True)
        small = not len(flat) or flat.max() < 254
        self.pads = (254, 255) if small else (0xFFFFFFFE, 0xFFFFFFFF)
        self.flat = np.append(flat, self.pads).astype(np.uint8 if small else np.uint32)
        n = len(xs)
        lens = np.fromiter(map(len, [*xs, *ys]), np.int64, 2 * n)
        ends = np.cumsum(lens)
        self.lens, self.starts = (lens[:n], lens[n:]), ((ends - lens)[:n], (ends - lens)[n:])

    def columns(self, side: int, of: np.ndarray) -> np.ndarray:
        """The texts of the pairs as the columns of a table."""
        lens = self.lens[side][of]
        at = np.arange(lens.max(initial=0))[:, None]
        return self.flat[np.where(at < lens, self.starts[side][of] + at, len(self.flat) - 2 + side)]

    def runs(self, of: np.ndarray) -> Iterator[np.ndarray]:
        """The pairs in runs of like lengths."""
        a, b = self.lens[0][of], self.lens[1][of]
        of = of[np.lexsort((b, a >> 3))]
        size = self.lens[0][of] + self.lens[1][of]
        i = 0
        while i < len(of):
            lanes = max(1, min(MOST_LANES, RUN_CELLS // max(1, int(size[i : i + MOST_LANES].max()))))
            yield of[i : i + lanes]
            i += lanes


def _combed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each end j in b, the last start i (from 1, 0: none) for which the letter b[j] adds nothing to the longest common
    subsequence of a and b[i - 1:j]. Thus that of a and b[i:j] has j - i letters less the number of ends k < j above i (the
    recurrence of all substrings by Alves, Cáceres and Song). Cells of one antidiagonal of all pairs are one step."""
    (m, lanes), n = a.shape, len(b)
    kind = np.uint8 if n <= 255 else np.uint16 if n <= 65535 else np.uint32
    back = np.ascontiguousarray(b[::-1])
    h = np.zeros((m, lanes), kind)
    v = np.repeat(np.arange(n, 0, -1).astype(kind)[:, None], lanes, axis=1)
    unlike, t = np.empty((m, lanes), bool), np.empty((m, lanes), kind)
    as_kind = unlike.view(np.uint8)
    for d in range(m + n - 1):
        i, stop = max(0, d - n + 1), min(m, d + 1)
        k, w = n - 1 - d + i, stop - i
        hs, vs, ts = h[i:stop], v[k : k + w], t[:w]
        np.not_equal(a[i:stop], back[k : k + w], out=unlike[:w])
        np.multiply(vs, as_kind[:w], out=ts)
        np.maximum(hs, ts, out=ts)
        hs += vs
        hs -= ts
        vs[...] = ts
    return v[::-1]


def _windows(v: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best ratio of a (m letters) and a window of b (n >= m) as in similarity.partial_ratio, from what _combed found."""
    v = v.astype(np.int32)
    most, lanes = v.shape
    at = np.arange(most, dtype=np.int32)[:, None]
    m, n = m.astype(np.int32), n.astype(np.int32)
    used = (v > 0) & (at < n)
    before = np.cumsum(used, axis=0, dtype=np.int32)
    ends = np.full((most + 1, lanes), most + 1, np.int32)
    row, lane = np.nonzero(used)
    ends[v[row, lane], lane] = row
    # windows cut at the begin of b
    best = np.where(at < m, 200.0 * (at + 1 - before) / (m + at + 1), 0.0).max(axis=0)
    # windows cut at its end
    later = np.cumsum((ends[1:] <= most)[::-1], axis=0, dtype=np.int32)[::-1]
    tail = (at < n) & (at >= n - m)
    best = np.maximum(best, np.where(tail, 200.0 * (n - at - later) / np.where(tail, m + n - at, 1), 0.0).max(axis=0))
    # whole windows: how many letters add nothing, from one start to the next
    last = np.minimum(at + m - 1, most - 1)
    step = (np.take_along_axis(v, last, axis=0) > at).astype(np.int32) - (ends[:most] < at + m - 1)
    step[0] = np.take_along_axis(before, last[:1], axis=0)[0]
    lost = np.where(at <= n - m, np.cumsum(step, axis=0, dtype=np.int32), m).min(axis=0)
    return np.maximum(best, 200.0 * (m - lost) / (2 * m))


def _compared(xs: Texts, ys: Texts, partial: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ratio, partial ratio) of each pair; the second is only filled in where it is asked for."""
    whole, part = np.zeros(len(xs)), np.zeros(len(xs))
    same = np.fromiter((x == y for x, y in zip(xs, ys)), bool, len(xs))
    whole[same] = part[same] = 100.0
    left, right = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(xs, ys)]) if len(xs) else ((), ())
    codes = _Codes(left, right)
    for of in codes.runs(np.nonzero(~same & (codes.lens[0] > 0))[0]):
        m, n = codes.lens[0][of], codes.lens[1][of]
        a, b = codes.columns(0, of), codes.columns(1, of)
        v = _combed(a, b)
        lost = ((v > 0) & (np.arange(len(v))[:, None] < n)).sum(axis=0)
        whole[of] = 200.0 * (n - lost) / (m + n)
        if partial:
            part[of] = _windows(v, m, n)
            even = np.nonzero(m == n)[0]
            if len(even):
                # the fill of one side must stay unlike that of the other
                back = _windows(_combed(b[:, even], a[:, even]), n[even], m[even])
                part[of[even]] = np.maximum(part[of[even]], back)
    return whole, part


def ratios(xs: Texts, ys: Texts) -> np.ndarray:
    return _compared(xs, ys, False)[0]


def ratios_and_partial(xs: Texts, ys: Texts) -> tuple[np.ndarray, np.ndarray]:
    return _compared(xs, ys, True)


def token_sort_ratios(xs: Texts, ys: Texts) -> np.ndarray:
    return ratios(*([" ".join(sorted(x.split())) for x in s] for s in (xs, ys)))


def token_set_ratios(xs: Texts, ys: Texts) -> np.ndarray:
    out, at, one, two = np.zeros(len(xs)), [], [], []
    for i, (x, y) in enumerate(zip(xs, ys)):
        p, q = set(x.split()), set(y.split())
        if not p or not q:
            continue
        both = p & q
        if both and (len(both) == len(p) or len(both) == len(q)):
            out[i] = 100.0
            continue
        common = " ".join(sorted(both))
        one.append(f"{common} {' '.join(sorted(p - both))}".strip())
        two.append(f"{common} {' '.join(sorted(q - both))}".strip())
        at.append((i, len(common)))
    if at:
        which, k = np.array(at).T
        # the common words begin both texts, so they are their own longest common subsequence with either
        r, a, b = ratios(one, two), *(np.fromiter(map(len, s), np.int64, len(s)) for s in (one, two))
        with_common = np.maximum(200.0 * k / (k + a), 200.0 * k / (k + b))
        out[which] = np.where(k > 0, np.maximum(r, with_common), r)
    return out


def jaro_winklers(xs: Texts, ys: Texts) -> np.ndarray:
    out = np.zeros(len(xs))
    same = np.fromiter((x == y for x, y in zip(xs, ys)), bool, len(xs))
    codes = _Codes(xs, ys)
    out[same & (codes.lens[0] > 0)] = 1.0
    for of in codes.runs(np.nonzero(~same & (codes.lens[0] > 0) & (codes.lens[1] > 0))[0]):
        out[of] = _jaro(np.ascontiguousarray(codes.columns(0, of).T), np.ascontiguousarray(codes.columns(1, of).T), codes.lens[0][of], codes.lens[1][of])
    return out


def _jaro(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    lanes, at = np.arange(len(a)), np.arange(b.shape[1])
    reach = np.maximum(0, np.maximum(m, n) // 2 - 1)[:, None]
    free, mine = np.ones(b.shape, bool), np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        fits = (b == a[:, i : i + 1]) & free & (np.abs(at - i) <= reach)
        first = fits.argmax(axis=1)
        hit = fits[lanes, first]
        free[lanes[hit], first[hit]] = False
        mine[:, i] = hit
    k = mine.sum(axis=1)
    rows, cols = np.nonzero(mine)
    odd = a[rows, cols] != b[np.nonzero(~free)]
    t = np.bincount(rows, weights=odd, minlength=len(a)).astype(np.int64) // 2
    jaro = np.where(k > 0, (k / m + k / n + (k - t) / np.maximum(k, 1)) / 3, 0.0)
    w = min(4, a.shape[1], b.shape[1])
    prefix = np.cumprod(a[:, :w] == b[:, :w], axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def levenshteins(xs: Texts, ys: Texts) -> np.ndarray:
    codes = _Codes(xs, ys)
    out = np.maximum(*codes.lens)
    for of in codes.runs(np.nonzero((codes.lens[0] > 0) & (codes.lens[1] > 0))[0]):
        m, n = codes.lens[0][of], codes.lens[1][of]
        a, b = codes.columns(0, of), codes.columns(1, of)
        at = np.arange(len(b) + 1, dtype=np.int32)[:, None]
        row = np.repeat(at, len(of), axis=1)
        for i in range(len(a)):
            new = np.empty_like(row)
            new[0] = i + 1
            new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != a[i]))
            row = np.minimum.accumulate(new - at, axis=0) + at
            done = np.nonzero(m == i + 1)[0]
            out[of[done]] = row[n[done], done]
    return out


def covered(lists: Sequence[tuple[list[str], list[str]]], least: float = 0.9) -> list[tuple[float, list[str]]]:
    """similarity.covered of each pair of token lists, at 0.9 or more. Tokens whose lengths rule that out are not compared."""
    if least < 0.9:
        raise ValueError("lengths rule out a similarity of 0.9 or more only")
    asked: dict[tuple[str, str], int] = {}
    near: list[list] = []
    for a, b in lists:
        known = set(b)
        mine = []
        for t in a:
            if t in known:
                continue
            ids = []
            m = len(t)
            for u in known:
                n = len(u)
                lo, hi = (m, n) if m < n else (n, m)
                # Jaro is at most (lo / hi + 2) / 3; 0.9 takes 0.9 of it, or five sixths with a common prefix of four
                if 2 * lo >= hi and (t[0] == u[0] or 10 * lo >= 7 * hi):
                    ids.append(asked.setdefault((t, u), len(asked)))
            mine.append((t, ids))
        near.append(mine)
    alike = (jaro_winklers(*zip(*asked)) >= least).tolist() if asked else []
    out = []
    for (a, _), mine in zip(lists, near):
        alone = [t for t, ids in mine if not any(alike[i] for i in ids)]
        out.append(((1 - len(alone) / len(a) if a else 0.0), alone))
    return out
