"""Alignment of transcripts: units, timestamp classes, their repair, and sentence times from unit times."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASS_MS = 80
#: Characters that are units by themselves.
IDEOGRAPHS = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}"


def units(text: Column) -> Column:
    """Alignment units: ideographs one by one, other letters and digits as words; apostrophes belong to words."""
    return F.regexp_extract_all(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}'\s]", ""), F.lit(rf"[{IDEOGRAPHS}]|[^\s{IDEOGRAPHS}]+"), F.lit(0))


def class_times(classes: Column, ms: int = CLASS_MS) -> Column:
    """Seconds of timestamp classes after repair."""
    return F.transform(repaired(F.transform(classes, lambda c: (c * ms).cast("double"))), lambda x: x / 1000.0)


def longest_rising(values: list[float]) -> list[int]:
    """Places of the longest non-decreasing subsequence; of equally long ones that with the earliest places."""
    n = len(values)
    best, before = [1] * n, [-1] * n
    tails: list[tuple[float, int]] = []  # per length the smallest last value
    for i, v in enumerate(values):
        k = bisect.bisect_right([t[0] for t in tails], v)
        best[i] = k + 1
        for j in range(i):
            if best[j] == k and values[j] <= v:
                before[i] = j
                break
        if k == len(tails):
            tails.append((v, i))
        else:
            tails[k] = (v, i)
    if not n:
        return []
    i = best.index(max(best))
    out = []
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def repair(values: list[float]) -> list[int]:
    """Times off the longest rising sequence are replaced: one or two by the nearer kept neighbour (the left of equals), more
    by equal steps between both; at an end by the one there is. All are cut to whole milliseconds."""
    kept = set(longest_rising(values))
    out, i, n = list(values), 0, len(values)
    while i < n:
        if i in kept:
            i += 1
            continue
        j = i
        while j < n and j not in kept:
            j += 1
        left, right, count = (values[i - 1] if i else None), (values[j] if j < n else None), j - i
        for k in range(i, j):
            if left is None or right is None:
                out[k] = right if left is None else left
            elif count <= 2:
                out[k] = left if k + 1 - i <= j - k else right
            else:
                out[k] = left + (right - left) * (k - i + 1) / (count + 1)
        i = j
    return [int(x) for x in out]


@F.pandas_udf(T.ArrayType(T.LongType()))
def repaired(times: pd.Series) -> pd.Series:
    return pd.Series([repair([float(x) for x in t]) if t is not None else None for t in times])


def sentence_times(sentences: list[str], units_: list[dict]) -> list[dict]:
    """Times of sentences from timed units. Both are streams of lower-case letters and digits; each unit is sought from
    where the last one ended. A sentence lasts from its first owner's start to its last one's end; without owners it has
    the end of the sentence before."""
    stream, owner = [], []
    for n, s in enumerate(sentences):
        for c in s:
            for x in c.lower():
                if c.isalnum():
                    stream.append(x)
                    owner.append(n)
    text, cursor = "".join(stream), 0
    first: dict[int, float] = {}
    last: dict[int, float] = {}
    for u in units_:
        want = "".join(x for c in u["text"] if c.isalnum() for x in c.lower())
        if not want:
            continue
        at = text.find(want, cursor)
        if at < 0:
            continue
        cursor = at + len(want)
        for n in set(owner[at:cursor]):
            first.setdefault(n, u["start"])
            last[n] = u["end"]
    out, end = [], 0.0
    for n, s in enumerate(sentences):
        a, b = (first[n], max(last[n], first[n])) if n in first else (end, end)
        out.append({"text": s, "start": a, "end": b})
        end = b
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])))
def timed_sentences(sentences: pd.Series, units_: pd.Series) -> pd.Series:
    """A forward-moving search cannot be a fold of built-in functions, so it is a vectorized Python function."""
    return pd.Series([sentence_times(list(s), list(u)) if s is not None and u is not None else None for s, u in zip(sentences, units_, strict=True)])
