"""The training-data pipeline: five stages, each of which works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontam, packing, quality, secretscan, simhash
from siltstone.llm._shared import table, written

STAGES = [
    ("quality_classifier", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontam.stage),
    ("secret_scans", secretscan.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL has no XXH64, boosted model, random forest or tokenizer; tests/llm/test_pipeline.py checks every stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
