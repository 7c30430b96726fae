"""Sentences, paragraphs and time shares of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.strings import CJK, SPACE, strip

#: What ends a sentence always, and what may close it.
ENDS = "。！？!?；…\\n"
CLOSERS = "\"'”’」』)）\\]】》"
#: Body up to an end, then the closers and further ends that belong to it; or the rest of the text. A point ends a
#: sentence before white space, a closer or the text's end. The body is possessive, so long texts need no stack.
SENTENCE = rf"(?:[^{ENDS}.]++|\.(?![{SPACE}{CLOSERS}]|\z))*+(?:[{ENDS}]|\.(?=[{SPACE}{CLOSERS}]|\z)|\z)[{CLOSERS}。！？!?….]*+"

PARAGRAPH_GAP = 2.0
PARAGRAPH_CHARS = 300


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip), lambda x: x != "")


def glued(a: Column, b: Column) -> Column:
    """Two pieces of running text: no blank beside a character that is written without blanks."""
    b = strip(b)
    tight = a.rlike(f"[{CJK}]\\z") | b.rlike(f"^[{CJK}]")
    return F.when(b == "", a).when(a == "", b).when(tight, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def gap_paragraphs(segments: Column, gap: float = PARAGRAPH_GAP, chars: int = PARAGRAPH_CHARS) -> Column:
    """array of struct(text, start, end) of timed sentences: a new paragraph after a pause, or once one is long."""
    paragraph = "array<struct<text:string,start:double,end:double>>"
    start = F.struct(F.array().cast(paragraph).alias("done"), F.lit("").alias("text"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
    row = lambda a: F.array(F.struct(a["text"].alias("text"), a["start"].alias("start"), a["end"].alias("end")))
    closed = lambda a: F.when(a["text"] != "", F.concat(a["done"], row(a))).otherwise(a["done"])

    def step(a: Column, x: Column) -> Column:
        new = (a["text"] != "") & ((x["start"] - a["end"] >= gap) | (F.length(a["text"]) >= chars))
        opened = F.struct(F.when(new, closed(a)).otherwise(a["done"]).alias("done"), F.when(new | (a["text"] == ""), strip(x["text"])).otherwise(glued(a["text"], x["text"])).alias("text"), F.when(new | (a["text"] == ""), x["start"]).otherwise(a["start"]).alias("start"), x["end"].alias("end"))
        return F.when(strip(x["text"]) == "", a).otherwise(opened)

    return F.aggregate(segments, start, step, closed)


def gap_islands(rows: DataFrame, key: str, start: str, end: str, gap: float) -> DataFrame:
    """rows with `island`: it grows where a row starts gap or more after the end of the one before."""
    order = Window.partitionBy(key).orderBy(start, end)
    new = F.coalesce((F.col(start) - F.lag(end).over(order) >= gap).cast("long"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def spread_times(rows: DataFrame, key: str, position: str, text: str, begin: Column, end: Column) -> DataFrame:
    """rows with start and end: a span of time shared out by the texts' characters, in order."""
    order = Window.partitionBy(key).orderBy(position)
    n = F.length(text)
    upto = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(n).over(Window.partitionBy(key))
    share = lambda x: F.when(total > 0, begin + (end - begin) * x / total).otherwise(begin)
    return rows.withColumn("start", share(upto - n)).withColumn("end", share(upto))
