"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from folioworks.llm.chat import OP4_SQL, op4_chat_format
from folioworks.llm.decontaminate import op1_decontaminate
from folioworks.llm.jaccard import OP3_SQL, op3_jaccard_join
from folioworks.llm.langid import op5_langid
from folioworks.llm.packing import op10_packing
from folioworks.llm.quality import op7_quality
from folioworks.llm.sharding import op9_virtual_slots
from folioworks.llm.token_files import op8_token_files
from folioworks.llm.topk import OP2_SQL, op2_top_k
from folioworks.llm.warc import OP6_SQL, op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_decontaminate, op2_top_k, op3_jaccard_join, op4_chat_format, op5_langid, op6_warc, op7_quality, op8_token_files, op9_virtual_slots, op10_packing)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return whole | {"op2_top_k": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op4_chat_format": OP4_SQL, "op6_warc": OP6_SQL}
