"""Corpus pipeline: quality rules, line dedup, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm._common import table, written
from lattica.llm.decision_rules import rules_stage
from lattica.llm.line_chunks import line_stage
from lattica.llm.packing import packing_stage
from lattica.llm.pii import pii_stage
from lattica.llm.similar import similar_stage

STAGES = [
    ("quality rules", rules_stage),
    ("line dedup", line_stage),
    ("near-duplicates", similar_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: Rolling hashes, message passing and tokenizing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
