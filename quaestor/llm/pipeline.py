"""The stages of the pipeline: quality rules, exact dedup, n-gram join, mixing, packing.

Each takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of ``documents``; extra columns are dropped. Filtering stages return rows unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quaestor.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from quaestor.llm.common import documents, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject. The verdict is a projection of the row, so nothing is joined."""
    return quality_rules.passing(docs.select(*COLUMNS))


def keep_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one with the smallest doc_id; decided on the row itself."""
    return exact_dedup.exact_groups(docs, carry=COLUMNS).where("kept").select("document.*")


def keep_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by the n-gram join stays, the one with the smallest doc_id."""
    return ngram_join.first_documents(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: per document and pass over its source the words taken; see ``mixing.mixed_documents``."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents with their place in the packed sequences."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", keep_exact),
    ("n-gram join", keep_near),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
