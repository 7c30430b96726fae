"""Times of media: clocks, time codes and the lines of caption files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def timecode_ms(ms: Column, mark: str = ",") -> Column:
    ms = F.greatest(ms.cast("long"), F.lit(0))
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def timecode(seconds: Column, mark: str = ",") -> Column:
    return timecode_ms(F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long"), mark)


def parsed(c: Column) -> Column:
    """Seconds of h:m:s or m:s with a comma or a point; null of anything else."""
    parts = F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":", -1)
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2)).when(F.size(parts) == 2, number(0) * 60 + number(1))


#: A line that holds a time range.
RANGE = r"\p{Nd}{1,2}:\p{Nd}{2}(:\p{Nd}{2})?[.,]\p{Nd}{2,3}\s*-->\s*\p{Nd}{1,2}:\p{Nd}{2}(:\p{Nd}{2})?[.,]\p{Nd}{2,3}"


def is_range(line: Column) -> Column:
    return line.rlike(RANGE)


def without_cue_markup(c: Column) -> Column:
    """A caption line without word times, caption tags and line-break tags."""
    c = F.regexp_replace(c, r"<\p{Nd}{1,2}:\p{Nd}{2}(:\p{Nd}{2})?[.,]\p{Nd}{2,3}>", "")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", " ")
    return F.regexp_replace(c, r"(?i)</?(c|v|b|i|u|lang|ruby|rt|font|span)([.\s][^>]*)?>", "")


def media_duration(probe: Column) -> Column:
    """Seconds in a prober's `Duration: h:m:s.f` line, or null."""
    m = lambda i: F.regexp_extract(probe, r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", i).try_cast("double")
    return m(1) * 3600 + m(2) * 60 + m(3)


def segment_plan(duration: Column, length: float) -> Column:
    """array of struct(no, start, end) that covers a duration in pieces of a fixed length."""
    n = F.greatest(F.ceil(duration / length).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("no"), (i * F.lit(length)).alias("start"), F.least((i + 1) * F.lit(length), duration).alias("end")))
