"""A training corpus from documents: five stages, each written as Parquet and read again.

language_id drops documents without a sure language; near_dedup keeps one document of each group
of near copies; decontaminate drops documents that hold a benchmark passage; pii replaces
personal data in the texts; mix says how many times each remaining document is taken. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeloom.llm import decontam, langid, mixing, pii, simhash
from placeloom.llm.common import stored, table

STAGES = [
    ("language_id", langid.reject_unsure),
    ("near_dedup", simhash.keep_one_of_each),
    ("decontaminate", decontam.drop_contaminated),
    ("pii", pii.redact),
    ("mix", mixing.mix_sources),
]

#: The learnt and the random stages have no SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
