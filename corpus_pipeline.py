"""The pipeline from raw documents to packed sequences."""

from __future__ import annotations

from quaestor.llm import pipeline

STAGES = pipeline.STAGES
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to ``documents``; each result is stored and read again as the next one's input."""
    return pipeline.run(spark, sf_dir)
