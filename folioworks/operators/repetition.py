"""Repetition: loops in generated text and tokens that would repeat an n-gram."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks.functions.strings import collapse, strip


def has_loop(text: Column) -> Column:
    """A visible character 8 times, a block of 2 to 10 of them 4 times, or (from 5 words) a word 6 times or a phrase of 2
    to 5 words 4 times, one right after the other."""
    c = collapse(strip(text))
    blocks = r"(\S)\1{7}|(\S{2,10}?)\2{3}"
    single = r"(?:^| )(\S+)(?: \1){5}(?: |\z)"
    phrase = r"(?:^| )(\S+(?: \S+){1,4}?)(?: \1){3}(?: |\z)"
    enough = F.size(F.split(c, " ", -1)) >= 5
    return F.coalesce(c.rlike(blocks) | (enough & (c.rlike(single) | c.rlike(phrase))), F.lit(False))


def banned_tokens(tokens: Column, n: int, window: int) -> Column:
    """The tokens that would complete an n-gram already seen in the last `window` tokens."""
    recent = F.slice(tokens, F.greatest(F.size(tokens) - F.lit(window) + 1, F.lit(1)), F.least(F.size(tokens), F.lit(window)))
    tail = F.slice(tokens, F.greatest(F.size(tokens) - F.lit(n - 2), F.lit(1)), F.lit(n - 1))
    starts = F.when(F.size(recent) >= n, F.sequence(F.lit(1), F.size(recent) - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.slice(recent, i, F.lit(n - 1)) == tail)
    return F.array_distinct(F.transform(hits, lambda i: F.element_at(recent, i + F.lit(n - 1))))


def ctc_collapsed(indices: Column, blank: int = 0) -> Column:
    """A decoder's best indices without blanks and without repeats of the one before."""
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice(indices, 1, F.greatest(F.size(indices) - 1, F.lit(0))))
    pairs = F.arrays_zip(indices.alias("i"), before.alias("b"))
    return F.transform(F.filter(pairs, lambda p: (p["i"] != blank) & ~p["i"].eqNullSafe(p["b"])), lambda p: p["i"])
