"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm.decontaminate import op7_decontamination
from veridoc.llm.neighbours import op3_neighbours
from veridoc.llm.packing import op10_packing
from veridoc.llm.pitman_yor import op9_language_model
from veridoc.llm.quality import op4_quality
from veridoc.llm.secrets import op8_secrets
from veridoc.llm.simhash import op5_simhash
from veridoc.llm.toxicity import op6_toxicity
from veridoc.llm.urlfilter import op1_sql, op1_url_filter
from veridoc.llm.warc import op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_warc": op2_warc,
        "op3_neighbours": op3_neighbours,
        "op4_quality": op4_quality,
        "op5_simhash": op5_simhash,
        "op6_toxicity": op6_toxicity,
        "op7_decontamination": op7_decontamination,
        "op8_secrets": op8_secrets,
        "op9_language_model": op9_language_model,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": op1_sql()}
