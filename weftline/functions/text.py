"""Normalisation of names and addresses: plain functions on one text, used by the Arrow functions in udfs."""

from __future__ import annotations

import re
import unicodedata

from weftline.functions import fixed as V

_INDIC = re.compile(f"[{chr(V.INDIC_FIRST)}-{chr(V.INDIC_LAST)}]")
_ORDINAL, _DOMAIN, _ALIAS, _NO_VALUE = map(re.compile, (V.ORDINAL, V.DOMAIN, V.ALIAS, V.NO_VALUE))
_LOOKALIKES = str.maketrans(V.LOOKALIKE_FROM, V.LOOKALIKE_TO)
_LATIN = str.maketrans(V.LATIN)
_PIECES = re.compile("[a-z0-9]+")
_STATES = [(re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, t), key=len, reverse=True)) + r")\b"), t) for t in (V.US_STATES, V.IN_STATES)]


def has_indic(s: str | None) -> bool:
    return bool(s) and _INDIC.search(s) is not None


def transliterate(s: str) -> str:
    """Brahmic letters in Latin: a consonant has an inherent "a" that a sign or a virama takes away and that is silent at the
    end of a word."""
    out: list[str] = []
    owed = False  # an inherent "a" not yet written
    for ch in s:
        cp = ord(ch)
        if not V.INDIC_FIRST <= cp <= V.INDIC_LAST:
            owed = False
            out.append(ch)
            continue
        o = cp & 0x7F
        if o in V.CONSONANTS or o in V.VOWELS or o in V.NASALS:
            if owed:
                out.append("a")
            out.append(V.CONSONANTS.get(o) or V.VOWELS.get(o) or V.NASALS[o])
            owed = o in V.CONSONANTS
        elif o in V.VOWEL_SIGNS:
            out.append(V.VOWEL_SIGNS[o])
            owed = False
        elif o == V.VIRAMA:
            owed = False
        elif V.FIRST_DIGIT <= o <= V.LAST_DIGIT:
            out.append(str(o - V.FIRST_DIGIT))
            owed = False
    return "".join(out)


def fold(s: str, words: dict[str, str] | None = None) -> str:
    """Lower-case ASCII: compatibility forms, Indic letters in Latin (with a learned dictionary of words), accents off."""
    s = unicodedata.normalize("NFKC", s)
    if _INDIC.search(s):
        s = transliterate(s).lower()
        if words:
            s = re.sub("[a-z]+", lambda m: words.get(m[0], m[0]), s)
    s = unicodedata.normalize("NFKD", s.translate(_LATIN))
    return "".join(c for c in s if ord(c) < 128 and not unicodedata.combining(c)).lower()


def undo_lookalikes(tok: str) -> str:
    """Digits typed for letters, in a token that has both and at least half letters; numbers and ordinals stay."""
    if tok.isalpha() or _ORDINAL.match(tok):
        return tok
    letters = sum(map(str.isalpha, tok))
    return tok.translate(_LOOKALIKES) if letters and 2 * letters >= len(tok) else tok


def merge_initials(toks: list[str]) -> list[str]:
    """Neighbouring single letters become one token."""
    out: list[str] = []
    run = ""
    for t in [*toks, ""]:
        if len(t) == 1 and t.isalpha():
            run += t
            continue
        if run:
            out.append(run)
            run = ""
        if t:
            out.append(t)
    return out


def skeleton(tok: str) -> str:
    """The consonants of a token under a few sound rules; the first letter stays, repeats count once, numbers stay."""
    if tok.isdigit():
        return tok
    for a, b in (("ph", "f"), ("w", "v"), ("z", "j"), ("q", "k"), ("ck", "k"), ("c", "k"), ("x", "ks")):
        tok = tok.replace(a, b)
    if not tok:
        return tok
    return re.sub(r"(.)\1+", r"\1", tok[0] + re.sub("[aeiouy]", "", tok[1:].replace("h", "")))


def segment(tok: str, cost: dict[str, float], longest: int = 20) -> list[str] | None:
    """The cheapest split of a token into known words of 2 to 20 letters; None where there is none or only one word."""
    best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * len(tok)
    for end in range(2, len(tok) + 1):
        for start in range(max(0, end - longest), end - 1):
            w = tok[start:end]
            if best[start] is not None and w in cost:
                c = best[start][0] + cost[w]
                if best[end] is None or c < best[end][0]:
                    best[end] = (c, start)
    if best[-1] is None:
        return None
    words, end = [], len(tok)
    while end:
        start = best[end][1]
        words.append(tok[start:end])
        end = start
    return words[::-1] if len(words) > 1 else None


def split_glued(tok: str, cost: dict[str, float]) -> list[str]:
    if len(tok) >= 7 and tok.isalpha() and tok not in cost:
        got = segment(tok, cost)
        if got and len(got) <= 4 and all(len(w) >= 3 for w in got):
            return got
    return [tok]


def name_tokens(raw: str | None, words: dict[str, str] | None = None, cost: dict[str, float] | None = None) -> list[str]:
    """The canonical tokens of a name. A web address leaves its label only; alias markers part a name, and each part is read by
    itself."""
    s = raw or ""
    indic = has_indic(s)
    s = fold(s, words).strip()
    m = _DOMAIN.match(s)
    if m:
        s = m[1]
    parts = _ALIAS.split(s.replace("&", " and ").replace("'", "").replace("`", ""))
    toks = [w for p in parts for w in merge_initials([undo_lookalikes(t) for t in _PIECES.findall(p)])]
    if cost and not indic:
        toks = [w for t in toks for w in split_glued(t, cost)]
    return [w for t in toks for w in V.NAME_WORDS.get(t, t).split()]


def pieces(raw: str) -> str:
    """The alphanumeric pieces of a folded text."""
    return " ".join(_PIECES.findall(fold(raw)))


def canonical(toks: list[str]) -> str:
    return " ".join(V.NAME_WORDS.get(t, t) for t in toks)


def name_features(raw: str | None, words=None, cost=None) -> tuple[str, str, str]:
    """(n_norm, n_core, n_legal)."""
    toks = name_tokens(raw, words, cost)
    core = [t for t in toks if t not in V.LEGAL]
    legal = sorted({t for t in toks if t in V.LEGAL} - V.NOT_A_FORM)
    return " ".join(toks), " ".join(core), " ".join(legal)


def state_codes(s: str) -> str:
    for pattern, codes in _STATES:
        s = pattern.sub(lambda m, codes=codes: codes[m[0]], s)
    return s


def address_features(raw: str | None, words=None) -> tuple[str, str, str]:
    """(a_norm, a_words, a_nums)."""
    s = _NO_VALUE.sub(" ", fold(raw or "", words))
    s = state_codes(s.replace("'", "").replace("&", " and "))
    toks = [undo_lookalikes(t) for t in _PIECES.findall(s)]
    toks = [V.ADDRESS_WORDS.get(t, t) for t in toks]
    nums = [d.lstrip("0") or "0" for t in toks for d in re.findall(r"\d+", t)]
    return " ".join(toks), " ".join(t for t in toks if not t.isdigit()), " ".join(nums)


def skeletons(core: str) -> str:
    return " ".join(skeleton(t) for t in core.split() if len(t) >= 3)
