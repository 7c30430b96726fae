"""Results around transcripts: metadata context, the Markdown template, JSON payloads and the cascade of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.strings import strip
from folioworks.functions.timecode import segment_plan

INFO = "id string, title string, description string, channel string, uploader string, duration double, view_count long, upload_date string, webpage_url string, language string, tags array<string>, chapters array<struct<title:string>>"


def info(payload: Column) -> Column:
    return F.from_json(payload, INFO)


def metadata_context(i: Column) -> Column:
    """Title, author, description (800 characters), 20 tags and 30 chapters, 2000 characters in all; null when empty."""
    given = lambda c: F.nullif(strip(c), F.lit(""))
    labelled = lambda name, c: F.when(given(c).isNotNull(), F.concat(F.lit(f"{name}: "), given(c)))
    clean = lambda a, n: F.slice(F.filter(F.transform(a, strip), lambda x: F.coalesce(x, F.lit("")) != ""), 1, n)
    listed = lambda name, a, glue: F.when(F.size(a) > 0, F.concat(F.lit(f"{name}: "), F.array_join(a, glue)))
    text = F.concat_ws("\n", labelled("Title", i["title"]), labelled("Author", F.coalesce(given(i["channel"]), i["uploader"])), labelled("Description", F.left(strip(i["description"]), F.lit(800))), listed("Tags", clean(i["tags"], 20), ", "), listed("Chapters", clean(F.transform(i["chapters"], lambda c: c["title"]), 30), "; "))
    return F.nullif(F.left(text, F.lit(2000)), F.lit(""))


def video_markdown(i: Column, body: Column) -> Column:
    """The transcript's Markdown page: heading, a line per known fact, and the text."""
    fact = lambda name, c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.concat(F.lit(f"- **{name}:** "), c))
    facts = F.concat_ws("\n", fact("Author", F.coalesce(F.nullif(i["uploader"], F.lit("")), i["channel"])), fact("Duration", F.format_number(i["duration"].cast("long"), 0)), fact("Views", F.format_number(i["view_count"], 0)), fact("Date", i["upload_date"]), fact("URL", i["webpage_url"]))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce(F.nullif(i["title"], F.lit("")), F.lit("Untitled"))), F.nullif(facts, F.lit("")), body)


def payload(result: Column) -> Column:
    """A result as JSON with its keys in order, absent values as null."""
    return F.to_json(result, {"ignoreNullFields": "false"})


def first_success(attempts: DataFrame, key: str, order: list[str], ok: str = "ok") -> DataFrame:
    """Of each key's attempts the first that succeeded; keys without one are left out."""
    from pyspark.sql import Window

    return attempts.where(ok).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def cheap_then_costly(rows: DataFrame, done: Column, costly) -> DataFrame:
    """rows whose cheap result is there, and costly(rest): the costly branch never sees a row that is done."""
    return rows.where(done).unionByName(costly(rows.where(~F.coalesce(done, F.lit(False)))))


def with_retry(text: Column, is_bad: Column, again: Column) -> Column:
    """The second model's text where the first one's is bad and there is a second."""
    return F.when(is_bad, F.coalesce(again, text)).otherwise(text)


def long_enough(text: Column, least: int = 10) -> Column:
    return F.length(strip(text)) > least


#: Seconds of a segment of sound, and of one whose words are aligned.
SEGMENT_SECONDS, ALIGNED_SECONDS = 600.0, 295.0


def transcribed(media: DataFrame, transcribe, key: str = "id", aligned: bool = False) -> DataFrame:
    """key and transcript of media (key, duration): each is cut into segments of a fixed length that the back end transcribe
    (rows of key, no, start, end to rows of key, no, text) takes one by one; their texts come together in order, blank ones
    left out."""
    length = ALIGNED_SECONDS if aligned else SEGMENT_SECONDS
    parts = media.select(key, F.explode(segment_plan(F.col("duration"), length)).alias("s")).select(key, "s.no", "s.start", "s.end")
    texts = transcribe(parts).withColumn("_t", strip(F.col("text"))).where("_t <> ''")
    return texts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "_t"))), lambda x: x["_t"]), " ").alias("transcript"))
