"""Back ends that the engine calls but does not have: speech, page recognition, conversion and downloads.

A back end is a function over iterators of pandas frames, so a model loads once per Python worker. Deterministic stand-ins
serve tests; no real results come from them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    """Frames with the columns `id` and `input` in; frames with `id`, `text` and `error` out."""

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


class Fixed:
    """A stand-in that answers from a table; unknown inputs are `backend_unavailable`."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = f["input"].map(self.answers.get)
            yield pd.DataFrame({"id": f["id"], "text": text, "error": text.map(lambda t: None if t is not None else "backend_unavailable")})


def call(rows: DataFrame, key: str, column: str, backend: Backend) -> DataFrame:
    """key, text and error of a back end's answers to rows."""
    return rows.select(F.col(key).cast("string").alias("id"), F.col(column).cast("string").alias("input")).mapInPandas(backend, "id string, text string, error string").withColumnRenamed("id", key)


def answered(rows: DataFrame, key: str, column: str, first: Backend, second: Backend) -> DataFrame:
    """The first back end's answers, and the second one's for what the first left unanswered."""
    a = call(rows, key, column, first)
    left = rows.withColumn(key, F.col(key).cast("string")).join(a.where("text IS NULL").select(key), key, "left_semi")
    return a.where("text IS NOT NULL").unionByName(call(left, key, column, second))
