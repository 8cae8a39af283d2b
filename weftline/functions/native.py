"""Normalisation steps that Spark's own expressions can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import fixed as V


def skeleton(tok: Column) -> Column:
    """Consonants of a token; see text.skeleton."""
    s = tok
    for a, b in (("ph", "f"), ("w", "v"), ("z", "j"), ("q", "k"), ("ck", "k"), ("c", "k"), ("x", "ks")):
        s = F.replace(s, F.lit(a), F.lit(b))
    bare = F.concat(F.substring(s, 1, 1), F.regexp_replace(F.substring(s, 2, 1 << 20), "[haeiouy]", ""))
    return F.when(tok.rlike("^[0-9]+$"), tok).otherwise(F.regexp_replace(bare, r"(.)\1+", "$1"))


def undo_lookalikes(tok: Column) -> Column:
    letters = F.length(F.regexp_replace(tok, "[^a-z]", ""))
    stays = tok.rlike("^[a-z]+$") | tok.rlike(V.ORDINAL) | (letters == 0) | (letters * 2 < F.length(tok))
    return F.when(stays, tok).otherwise(F.translate(tok, V.LOOKALIKE_FROM, V.LOOKALIKE_TO))


def domain_label(s: Column) -> Column:
    return F.regexp_extract(s, V.DOMAIN, 1)


def state_codes(s: Column) -> Column:
    """State names to codes, longest first, first those of the one country, then of the other."""
    steps = [p for t in (V.US_STATES, V.IN_STATES) for p in sorted(t.items(), key=lambda p: (-len(p[0]), p[0]))]
    return reduce(lambda c, p: F.regexp_replace(c, rf"\b{p[0]}\b", p[1]), steps, s)


def address_numbers(norm: Column) -> Column:
    """All digit runs without leading zeros, space-joined."""
    runs = F.transform(F.regexp_extract_all(norm, F.lit(r"(\d+)"), 1), lambda d: F.when(d.rlike("^0+$"), F.lit("0")).otherwise(F.ltrim(d, F.lit("0"))))
    return F.array_join(runs, " ")


def split_name(norm: Column) -> tuple[Column, Column]:
    """(core, legal) of a normalised name."""
    toks = F.filter(F.split(norm, " "), lambda t: t != "")
    legal = F.filter(toks, lambda t: t.isin(*sorted(V.LEGAL - V.NOT_A_FORM)))
    return F.array_join(F.filter(toks, lambda t: ~t.isin(*sorted(V.LEGAL))), " "), F.array_join(F.array_sort(F.array_distinct(legal)), " ")
