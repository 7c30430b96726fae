"""The corpus pipeline: language ID, quality, near-duplicates, decontamination and packing, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioworks.llm.common import hold, read_table
from folioworks.llm.decontaminate import stage_decontaminate
from folioworks.llm.jaccard import stage_near_duplicates
from folioworks.llm.langid import stage_language
from folioworks.llm.packing import stage_packing
from folioworks.llm.quality import stage_quality

STAGES = [
    ("language", stage_language),
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontaminate),
    ("packing", stage_packing),
]

#: The language and quality stages are trained models, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that every stage kept."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = hold(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
