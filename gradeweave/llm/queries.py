"""The registered queries of this subpackage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (
    decontaminate,
    exact_dedup,
    language,
    lattice,
    licences,
    mixing,
    ngram_model,
    secrets,
    seekable,
    sharding,
    simhash,
    token_rollup,
    whitening,
)

SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_jump_shards(spark, sf_dir):
    return sharding.shard_layout(table(spark, sf_dir, "documents"), SHARDS)


def op4_ngram_scores(spark, sf_dir):
    out = language.held_out(F.col("doc_id"), 7, 2)
    docs = table(spark, sf_dir, "documents")
    scored = ngram_model.train_and_score(docs, ~out)
    return scored.select("doc_id", out.alias("held_out"), *[c for c in scored.columns if c != "doc_id"])


def op5_language_id(spark, sf_dir):
    return language.train_and_predict(table(spark, sf_dir, "documents"))


def op6_token_rollup(spark, sf_dir):
    return token_rollup.documents_rollup(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark, sf_dir):
    return licences.find_licenses(table(spark, sf_dir, "documents"))


def op8_simhash_groups(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.found_items(docs, items).drop("text_key")


def op10_source_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_lattice_groups(spark, sf_dir):
    return lattice.near_vector_report(table(spark, sf_dir, "embeddings"))


def op12_sliced_whitening(spark, sf_dir):
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


def op13_seekable_fim(spark, sf_dir):
    return seekable.fim_report(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def registry():
    named = (
        op1_secret_scan,
        op2_exact_dedup,
        op3_jump_shards,
        op4_ngram_scores,
        op5_language_id,
        op6_token_rollup,
        op7_license_scan,
        op8_simhash_groups,
        op9_benchmark_leaks,
        op10_source_mix,
        op11_lattice_groups,
        op12_sliced_whitening,
        op13_seekable_fim,
        pipeline,
    )
    return {query.__name__: query for query in named}
