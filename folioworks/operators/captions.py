"""Captions: rendering and reading of SRT and VTT, native caption payloads, rolling captions, and cue splitting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.functions import timecode as tc
from folioworks.functions.strings import SPACE, strip, words

CUE = "array<struct<start:double,end:double,text:string>>"
LEAST_CUE = 0.5
LONGEST_CUE = 7.0
LINE_CHARS, LINE_CHARS_CJK = 84, 42
#: Characters after which a long cue may be cut.
BREAKS = "，、,;；：:—"


def rendered(rows: DataFrame, key: str, start: str, end: str, text: str, kind: str = "srt") -> DataFrame:
    """key and the caption file of its cues, in order of their times."""
    cues = F.array_sort(F.collect_list(F.struct(F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end"), F.col(text).alias("text"))))
    return rows.groupBy(key).agg(cues.alias("cues")).select(key, caption_file(F.col("cues"), kind).alias(kind))


def caption_file(cues: Column, kind: str = "srt") -> Column:
    mark = "," if kind == "srt" else "."
    times = lambda x: F.concat(tc.timecode(x["start"], mark), F.lit(" --> "), tc.timecode(x["end"], mark), F.lit("\n"), strip(x["text"]), F.lit("\n"))
    if kind == "srt":
        return F.array_join(F.transform(cues, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), times(x))), "\n")
    return F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(cues, times), "\n"))


def cue_times(line: Column) -> Column:
    """struct(start, end) of a line with an arrow, if both times can be read, else null."""
    a, b = tc.parsed(F.substring_index(line, "-->", 1)), tc.parsed(F.get(words(F.substring_index(line, "-->", -1)), F.lit(0)))
    return F.when(line.contains("-->") & a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))


def read_cues(content: Column) -> Column:
    """The cues of an SRT or VTT file. A line that the last kept cue ends with or holds is dropped, as rolling captions
    repeat it; cues left without a line vanish."""
    blocks = F.split(F.replace(content, F.lit("\r"), F.lit("")), f"\n(?=[^\n]*-->)|\n[{SPACE}]*\n|^(?=[^\n]*-->)", -1)
    state = F.struct(F.array().cast(CUE).alias("done"), F.lit("").alias("last"))

    def step(a: Column, block: Column) -> Column:
        rows = F.split(block, "\n", -1)
        times = cue_times(F.get(rows, F.lit(0)))
        body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: strip(without_tags(x)))
        fresh = F.filter(body, lambda x: (x != "") & ~((a["last"] != "") & a["last"].contains(x)))
        text = F.array_join(fresh, " ")
        cue = F.array(F.struct(times["start"].alias("start"), times["end"].alias("end"), text.alias("text")))
        return F.when(times.isNull() | (text == ""), a).otherwise(F.struct(F.concat(a["done"], cue).alias("done"), text.alias("last")))

    return F.aggregate(blocks, state, step, lambda a: a["done"])


def without_tags(line: Column) -> Column:
    """A caption line without <...>, and without {...} where it has {\\ commands."""
    plain = F.regexp_replace(line, r"<[^<>]*>", "")
    return F.when(line.contains("{\\"), F.regexp_replace(plain, r"\{[^{}]*\}", "")).otherwise(plain)


def timed_lines(content: Column) -> Column:
    """Texts of the cues of an SRT or VTT file, without headers, numbers, notes and markup."""
    rows = F.transform(F.split(F.replace(content, F.lit("\r"), F.lit("")), "\n", -1), strip)
    plain = F.filter(rows, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|NOTE|STYLE|REGION|Kind:|Language:)|^\p{Nd}+\z") & ~tc.is_range(x))
    return F.filter(F.transform(plain, lambda x: strip(tc.without_cue_markup(x))), lambda x: x != "")


def ttml_lines(content: Column) -> Column:
    """Texts of the paragraphs of a TTML file."""
    found = F.regexp_extract_all(content, F.lit(r"(?s)<p[\s>].*?</p>"), F.lit(0))
    bare = lambda x: strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", " "), "<[^>]*>", ""), f"[{SPACE}]+", " "))
    return F.filter(F.transform(found, lambda x: entities(bare(x))), lambda x: x != "")


def entities(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def rolled(cues: list[str]) -> list[str]:
    tokens: list[str] = []
    for cue in cues:
        own = re.split(_BLANKS, re.sub(_EDGES, "", cue or "")) if re.sub(_EDGES, "", cue or "") else []
        k = next((k for k in range(min(len(tokens), len(own)), 0, -1) if tokens[-k:] == own[:k]), 0)
        tokens += own[k:]
    return tokens


@F.pandas_udf(T.ArrayType(T.StringType()))
def merged_rolling(cues: pd.Series) -> pd.Series:
    """The words of all cues; of each cue the longest start that the words so far end with is left out. The words so far
    grow with each cue, which a fold of built-in functions would copy each time."""
    return pd.Series([rolled(list(c)) if c is not None else None for c in cues])


#: Tokens with a point that end no sentence.
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "vs.", "etc.", "e.g.", "i.e.", "u.s.", "u.k.", "no.", "inc.", "ltd.", "co.")
SPEAKERS = (">>", "<<")


def linear_transcript(tokens: Column) -> Column:
    """One sentence per line. A sentence ends at a token with an end mark, unless it is an abbreviation or an initial,
    where the next token starts like a sentence, is a speaker's turn, or is missing. Turns open a line with >>."""
    marker = lambda t: t.rlike(r"^(>>|<<)")
    bare = lambda t: F.regexp_replace(t, r"^(>>|<<)", "")
    ends = lambda t: t.rlike(r"[.!?。！？…][\"'”’)\]]*\z") & ~F.lower(t).isin(*ABBREVIATIONS) & ~t.rlike(r"^\p{L}\.\z")
    opens = lambda t: t.rlike(r"^[\"'“‘(\[]?[A-Z\x{3400}-\x{9fff}]")
    following = F.concat(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    pairs = F.arrays_zip(tokens.alias("t"), following.alias("n"))

    def piece(p: Column) -> Column:
        lead = F.when(marker(p["t"]), F.concat(F.lit("\n>> "), bare(p["t"]))).otherwise(p["t"])
        stop = ends(bare(p["t"])) & (p["n"].isNull() | marker(p["n"]) | opens(p["n"]))
        return F.concat(lead, F.when(stop, F.lit("\n")).otherwise(F.lit(" ")))

    whole = F.array_join(F.transform(pairs, piece), "")
    return strip(F.regexp_replace(F.regexp_replace(whole, " *\n+ *", "\n"), r">> +\n", ">> "))


def plain_transcript(content: Column) -> Column:
    """A caption file of any kind as running text; other texts stay as they are."""
    head = F.left(content, F.lit(500))
    cues = F.when(head.contains("<tt") | head.contains("<?xml"), ttml_lines(content)).when(tc.is_range(content), timed_lines(content))
    return F.when(cues.isNull(), content).otherwise(linear_transcript(merged_rolling(cues)))


def json3_cues(payload: Column) -> Column:
    """Cues (milliseconds) of a json3 payload; events without text are left out."""
    shape = "events array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>"
    events = F.from_json(payload, shape)["events"]
    cue = F.transform(events, lambda e: F.struct(F.coalesce(e["tStartMs"], F.lit(0)).alias("start_ms"), (F.coalesce(e["tStartMs"], F.lit(0)) + F.coalesce(e["dDurationMs"], F.lit(0))).alias("end_ms"), strip(F.replace(F.array_join(F.transform(e["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), F.lit("\n"), F.lit(" "))).alias("text")))
    return F.filter(cue, lambda c: F.coalesce(c["text"], F.lit("")) != "")


def xml_cues(payload: Column) -> Column:
    """Cues (milliseconds) of the XML payloads: <text start dur> in seconds or <p t d> in milliseconds."""
    found = F.regexp_extract_all(payload, F.lit(r"(?s)<(?:text|p)\s[^>]*>.*?</(?:text|p)>"), F.lit(0))
    number = lambda x, name: F.regexp_extract(x, rf"""\s{name}=["']([0-9.]+)["']""", 1).try_cast("double")

    def cue(x: Column) -> Column:
        scale = F.when(x.startswith("<text"), F.lit(1000.0)).otherwise(F.lit(1.0))
        start = F.coalesce(number(x, "start"), number(x, "t"), F.lit(0.0)) * scale
        length = F.coalesce(number(x, "dur"), number(x, "d"), F.lit(0.0)) * scale
        return F.struct(start.cast("long").alias("start_ms"), (start + length).cast("long").alias("end_ms"), strip(F.regexp_replace(entities(F.regexp_replace(x, "<[^>]*>", "")), f"[{SPACE}]+", " ")).alias("text"))

    return F.filter(F.transform(found, cue), lambda c: c["text"] != "")


def payload_kind(payload: Column) -> Column:
    """json3, ttml, xml, vtt, srt or text, from the payload's first characters."""
    head = F.ltrim(F.left(payload, F.lit(2000)))
    return F.when(head.startswith("{"), "json3").when(head.contains("<tt"), "ttml").when(head.contains("<transcript") | head.contains("<timedtext"), "xml").when(head.startswith("WEBVTT"), "vtt").when(tc.is_range(head), "srt").otherwise("text")


def milliseconds_srt(cues: Column, default_ms: int = 1000) -> Column:
    """SRT of cues in milliseconds; a cue without length lasts default_ms."""
    one = lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), tc.timecode_ms(x["start_ms"]), F.lit(" --> "), tc.timecode_ms(F.when(x["end_ms"] > x["start_ms"], x["end_ms"]).otherwise(x["start_ms"] + default_ms)), F.lit("\n"), x["text"], F.lit("\n"))
    return F.array_join(F.transform(cues, one), "\n")


_BLANKS = re.compile("[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_EDGES = re.compile(f"^{_BLANKS.pattern}|{_BLANKS.pattern}\\Z")
_WIDE = re.compile("[　-〿぀-ヿ㐀-䶿一-鿿가-힯豈-﫿＀-￯\U00020000-\U0002fa1f]")


def _cut(text: str, start: float, end: float) -> list[tuple[float, float, str]]:
    """A sentence as cues: cut at the break nearest its middle while it is too long or lasts too long."""
    out, todo = [], [(text.strip(), start, end)]
    while todo:
        text, start, end = todo.pop()
        visible = [c for c in text if not c.isspace()]
        wide = sum(1 for c in visible if _WIDE.match(c))
        mostly = wide * 2 > len(visible)
        n = len(text)
        at = None
        if n > (LINE_CHARS_CJK if mostly else LINE_CHARS) or end - start > LONGEST_CUE:
            middle = n // 2
            for marks in (BREAKS, " "):
                places = [i for i in range(1, n - 1) if text[i] in marks]
                if places:
                    at = min(places, key=lambda i: (abs(i - middle), i)) + 1
                    break
            else:
                at = middle if mostly and 0 < middle < n else None
        left, right = (text[:at].strip(), text[at:].strip()) if at else ("", "")
        if left and right:
            split = start + (end - start) * len(left) / (len(left) + len(right))
            todo += [(right, split, end), (left, start, split)]
        elif text:
            out.append((start, max(end, start + LEAST_CUE), text))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])))
def split_cues(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """The cues of a timed sentence. The cutting recurs into both sides, so it is a vectorized Python function."""
    return pd.Series([[{"start": a, "end": b, "text": t} for a, b, t in _cut(x or "", float(s), float(e))] for x, s, e in zip(text, start, end, strict=True)])
