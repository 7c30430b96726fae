"""Streams: paragraphs of timed sentences as sessions, and count windows of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.operators.layout import page_windows


def session_paragraphs(sentences: DataFrame, key: str = "clip_id", gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """A stream of sentences (key, ts, seconds, text) as paragraphs that a pause of `gap` after a sentence's end closes.

    Batch DataFrames work alike. On a stream, sentences later than the watermark are left out."""
    held = sentences.withWatermark("ts", late) if sentences.isStreaming else sentences
    length = F.concat((F.col("seconds") * 1000).cast("long").cast("string"), F.lit(" milliseconds"))
    pause = F.concat(F.lit(gap), F.lit(" "), length)
    return held.groupBy(key, F.session_window("ts", pause).alias("w")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "text"))), lambda x: x["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n_sentences")).select(key, F.col("w.start").alias("start"), "n_sentences", "text")


def windows_of_pages(size: int, handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands over each micro-batch's pages with their count windows."""

    def run(batch: DataFrame, number: int) -> None:
        handle(page_windows(batch, "doc_id", "page_no", size), number)

    return run
