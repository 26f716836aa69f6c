"""The corpus pipeline: quality, language, near-duplicates, contamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from profseg.llm import stages
from profseg.llm.common import read, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", stages.keep_good),
    ("language", stages.keep_known_language),
    ("near_duplicates", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_contaminated),
    ("byte_bpe", stages.encode),
]

#: SQL can't express the learned stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared folder before the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
