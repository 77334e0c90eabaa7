"""A training corpus from raw documents: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, line_dedup, near_dedup, quality_rules, source_mixing
from foliant.llm.common import Scratch, table

STAGES = [
    ("quality rules", quality_rules.stage),
    ("line dedup", line_dedup.stage),
    ("minhash near-dedup", near_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("source mixing", source_mixing.stage),
]

#: Learned rules, MinHash and a singular value decomposition have no SQL form;
#: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
