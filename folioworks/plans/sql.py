"""The registry of queries and what their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioworks.functions import strings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Tables whose rows cost much more to compute on than to move.
TEXTS = ("documents", "pages", "conversations", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One of TEXTS that comes in fewer splits than there are cores (a small file) is dealt over the cores; a
    table of many files is read where it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


S = strings.SPACE


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def sql_normalized(x: str) -> str:
    line = strings.SPACE_IN_LINE
    return rf"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(13), ''), '[{line}]+\n', chr(10), 'g'), '[{line}]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


def sql_words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{S}]+')"
