"""Accuracy of texts against references: edit distances, error rates, bag F1 and grouped means."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.functions.strings import scoring_chars, scoring_words, similarity


@F.pandas_udf(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))
def coded_words(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Both word arrays as texts with a character per word: equal words are equal characters."""

    def code(names: dict, ws) -> str:
        places = (names.setdefault(w, len(names)) for w in (ws if ws is not None else []))
        return "".join(chr(0x4E00 + i) if 0x4E00 + i < 0xD800 else chr(0x10000 + i) for i in places)

    rows = []
    for x, y in zip(a, b, strict=True):
        names: dict = {}
        rows.append((code(names, x), code(names, y)))
    return pd.DataFrame(rows, columns=["a", "b"])


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays: words become characters, then the built-in distance counts."""
    coded = coded_words(a, b)
    return F.levenshtein(coded["a"], coded["b"])


def error_rates(pairs: DataFrame, group: str, reference: str, hypothesis: str, by_chars: bool = False) -> DataFrame:
    """group, edits, units and rate (edits / units) of word or character edits."""
    if by_chars:
        r, h = scoring_chars(F.col(reference)), scoring_chars(F.col(hypothesis))
        edits, units = F.levenshtein(r, h), F.length(r)
    else:
        r, h = scoring_words(F.col(reference)), scoring_words(F.col(hypothesis))
        edits, units = word_distance(r, h), F.size(r)
    rows = pairs.select(group, edits.cast("long").alias("edits"), units.cast("long").alias("units"))
    total = rows.groupBy(group).agg(F.sum("edits").alias("edits"), F.sum("units").alias("units"))
    return total.withColumn("rate", F.col("edits") / F.greatest("units", F.lit(1)))


def bag(words: Column) -> Column:
    """Counts of the words, as a map."""
    names = F.array_distinct(words)
    return F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(words, lambda w: w == n))))


def bag_overlap(docs: DataFrame, refs: DataFrame, key: str, words: str) -> DataFrame:
    """key, common, n_doc, n_ref and f1 of the two sides' word multisets."""
    side = lambda df, n: df.select(key, F.explode(words).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias(n))
    both = side(docs, "a").join(side(refs, "b"), [key, "w"], "full_outer")
    out = both.groupBy(key).agg(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("common"), F.sum(F.coalesce("a", F.lit(0))).alias("n_doc"), F.sum(F.coalesce("b", F.lit(0))).alias("n_ref"))
    return out.withColumn("f1", F.when((F.col("n_doc") + F.col("n_ref")) > 0, F.col("common") * 2.0 / (F.col("n_doc") + F.col("n_ref"))).otherwise(0.0))


def document_similarity(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    return pairs.withColumn("similarity", similarity(scoring_chars(F.col(reference)), scoring_chars(F.col(hypothesis))))


def grouped_means(scores: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Means over everything and over each group column by itself, in one pass of grouping sets."""
    sets = ", ".join(["()", *(f"(`{g}`)" for g in groups)])
    cols = ", ".join([*(f"`{g}`" for g in groups), "count(*) AS n", *(f"avg(`{v}`) AS `{v}`" for v in values)])
    return scores.sparkSession.sql(f"SELECT {cols} FROM {{scores}} GROUP BY GROUPING SETS ({sets})", scores=scores)


def sampled_groups(rows: DataFrame, groups: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group, the first by a seeded hash of the key: a sampling operator."""
    from pyspark.sql import Window

    order = Window.partitionBy(*groups).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
