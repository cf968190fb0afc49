"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontam, lexical, mixing, neardup, pii, pitmanyor, quality, secrets, sortmeans, tokenids, toxicity, unitdedup, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_secrets": secrets.op2_secrets,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_neardup": neardup.op4_neardup,
        "op5_unitdedup": unitdedup.op5_unitdedup,
        "op6_decontamination": decontam.op6_decontamination,
        "op7_pii": pii.op7_pii,
        "op8_mixing": mixing.op8_mixing,
        "op9_pitmanyor": pitmanyor.op9_pitmanyor,
        "op10_warc": warc.op10_warc,
        "op11_lexical": lexical.op11_lexical,
        "op12_tokenids": tokenids.op12_tokenids,
        "op13_sortmeans": sortmeans.op13_sortmeans,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality.SQL, "op4_neardup": neardup.SQL, "op6_decontamination": decontam.SQL, "op8_mixing": mixing.SQL, "op10_warc": warc.SQL, "op11_lexical": lexical.SQL, "op13_sortmeans": sortmeans.SQL}
