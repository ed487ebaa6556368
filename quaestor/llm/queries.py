"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaestor.llm import (
    chat,
    exact_dedup,
    fill_in_middle,
    language_id,
    license_scan,
    mixing,
    ngram_join,
    packing,
    quality_model,
    quality_rules,
    secrets,
    token_alignment,
    warc,
)
from quaestor.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_exact_dedup(spark, d):
    return exact_dedup.exact_groups(documents(spark, d))


@query
def op5_quality_rules(spark, d):
    return quality_rules.quality_rules(documents(spark, d))


@query
def op3_best_fit_packing(spark, d):
    import public_tokenizers

    return packing.pack(documents(spark, d), public_tokenizers.path(packing.TOKENIZER))


@query
def op9_source_mixing(spark, d):
    return mixing.taken_words(documents(spark, d))


@query
def op2_ngram_jaccard_join(spark, d):
    return ngram_join.jaccard_components(documents(spark, d))


@query
def op1_language_id(spark, d):
    return language_id.identify(documents(spark, d))


@query
def op6_secret_scan(spark, d):
    return secrets.findings(documents(spark, d))


@query
def op7_quality_classifier(spark, d):
    return quality_model.score(documents(spark, d))


@query
def op8_chat_formatting(spark, d):
    fixed = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-7, 0, "user", fixed), (-7, 1, "assistant", fixed)], "conv_id long, turn long, role string, text string"
    )
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(*own.columns).union(own)
    return chat.digests(chat.formatted(chat.canonical(turns)))


@query
def op10_warc(spark, d):
    return warc.round_trip(spark.read.parquet(f"{d}/pages.parquet"))


@query
def op11_license_scan(spark, d):
    return license_scan.license_labels(documents(spark, d))


@query
def op12_token_alignment(spark, d):
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in (token_alignment.BYTE_TOKENIZER, token_alignment.PIECE_TOKENIZER)]
    return token_alignment.align(documents(spark, d), *paths)


@query
def op13_fill_in_middle(spark, d):
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(documents(spark, d)))
