"""Token counts kept up to date by signed deltas.

A batch of changes (insert, delete, revise) becomes additive deltas per source, language and
tokenizer version, written as one partition named by the batch. Committing a batch again
replaces its partition by the same rows, so a retry changes nothing; totals are sums of all
partitions.
"""

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import word_count

KEYS = ("source", "lang", "version")
SUMS = ("docs", "tokens")
DELTA_SCHEMA = "source string, lang string, version string, docs bigint, tokens bigint, batch string"
#: Tokenizers by version: words between blanks; runs of letters or digits, and single marks.
WORDS, PIECES = "blank-words-1", "word-pieces-1"
PIECE_PATTERN = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x00-\x20]"


def pieces(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PIECE_PATTERN)), F.lit(0)).cast("bigint")


TOKENIZERS = {WORDS: word_count, PIECES: pieces}


def counted(docs: DataFrame, version: str) -> DataFrame:
    """doc_id, source, lang, version and tokens of each document; a null text has 0."""
    return docs.select(
        "doc_id", "source", "lang", F.lit(version).alias("version"), TOKENIZERS[version]("text").alias("tokens")
    )


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Rows of `counted` as additions (1) or withdrawals (-1)."""
    return rows.select(*KEYS, F.lit(sign).cast("bigint").alias("docs"), (F.col("tokens") * sign).alias("tokens"))


def commit(path: str, batch: str, changes: DataFrame) -> None:
    """Write a batch's deltas (rows of source, lang, version, docs, tokens) below the path.

    A hot source is summed in each task before its shuffle. The batch's own folder is replaced
    as a whole, also by a batch without any row, and no other is touched.
    """
    sums = [F.sum(name).cast("bigint").alias(name) for name in SUMS]
    deltas = changes.groupBy(*KEYS).agg(*sums)
    deltas.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={quote(batch, safe='')}")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """source, lang, version, docs, tokens and batches (that touched them), without what is used up."""
    deltas = spark.read.schema(DELTA_SCHEMA).parquet(path)
    sums = [F.sum(name).cast("bigint").alias(name) for name in SUMS]
    all_ = deltas.groupBy(*KEYS).agg(*sums, F.countDistinct("batch").alias("batches"))
    return all_.where("docs <> 0 or tokens <> 0")


def documents_rollup(docs: DataFrame, labels: DataFrame, path: str | None = None) -> DataFrame:
    """Totals after three batches over all documents.

    `load` inserts every document with its words; `retokenize` revises every document to the
    pieces, and is committed twice, as by a retry; `takedown` deletes the documents that are
    labelled toxic. Null sources and languages are groups of their own; repeated rows count
    each; repeated labels of one document delete it once; documents without an id are never
    deleted, as no label names them. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-rollup")
    words, parts = counted(docs, WORDS), counted(docs, PIECES)
    commit(path, "load", signed(words, 1))
    # Both counts of a row are made in one pass over the texts.
    both = docs.select(
        "source",
        "lang",
        F.explode(
            F.array(
                F.struct(F.lit(WORDS).alias("version"), F.lit(-1).alias("docs"), (-word_count("text")).alias("tokens")),
                F.struct(F.lit(PIECES).alias("version"), F.lit(1).alias("docs"), pieces("text").alias("tokens")),
            )
        ).alias("d"),
    ).select("source", "lang", "d.*")
    for _ in range(2):
        commit(path, "retokenize", both)
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    commit(path, "takedown", signed(parts.join(toxic, "doc_id", "left_semi"), -1))
    return totals(spark, path)
