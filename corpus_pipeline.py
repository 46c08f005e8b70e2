"""The corpus pipeline: documents in, sharded training rows out.

Stages keep the columns of the documents, also further ones, and take nulls in any column,
empty and very long texts and repeated rows as each says; of an empty table nothing is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's
rows as Parquet into the shared folder and reads them back as the next stage's documents.
"""

from pyspark.sql import functions as F

from gradeweave.llm import decontaminate, language, mixing, sharding, simhash
from gradeweave.llm.common import stored

SHARDS = 8


def language_id(spark, docs, sf_dir):
    """Drops documents without a language: null texts and texts without a letter."""
    return language.with_language(docs)


def near_dedup(spark, docs, sf_dir):
    """Keeps one document of each SimHash component: the longest, then the one of smallest id."""
    return simhash.one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark, docs, sf_dir):
    """Takes each document as often as the mix of the sources asks for.

    Null sources are one source, the last; null and empty texts have no words and may be
    taken; repeated rows are rows of their own.
    """
    return mixing.mix(docs)


def sharded(spark, docs, sf_dir):
    """Adds the shard of each row's doc_id, and the shard it would have with one shard more.

    Null ids count as id 0. Columns that are named `shard` or `grown_shard` are replaced.
    """
    out = sharding.assign_shards(docs, SHARDS)
    return out.withColumn("grown_shard", sharding.jump_shard(F.col("doc_id"), SHARDS + 1))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", sharded),
]

#: The stages of models, hashes and templates are beyond SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows for the tables below sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
