"""Exact duplicates by a tree merge of sorted digest runs.

Each partition sorts its digests into a run that holds, per digest, the number of rows and
the row that stays. Runs are then exchanged in rounds: in a round, the partitions whose
numbers differ in one group of bits swap, each keeping the digests whose own bits match its
number, and every partition merges what it got. After the last round a partition holds its
share of the digest space, merged over all runs; no round puts the whole table in one place,
and a text with many copies is one entry per run from the start.
"""

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_copy, parts_of, stored

#: The characters that do not count.
BLANKS = r"[\x20\x09-\x0D]+"
#: Runs that meet in a round are 2 to this power.
ROUND_BITS = 2
RUN_SCHEMA = "digest string, check bigint, length bigint, doc_id bigint, rows bigint, home int, run int"


def merge_runs(batches):
    """Entries of equal digests, adjacent and best first, as one entry with the rows of all.

    An entry is only merged with another of the same digest whose check value, a second hash
    of the normalised text, agrees: identifiers are verified at every level.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        digest, check = table["digest"].combine_chunks(), table["check"].to_numpy()
        codes = digest.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (check[1:] != check[:-1])])
        sums = np.add.reduceat(table["rows"].to_numpy(), starts)
        merged = table.take(pa.array(starts))
        at = merged.schema.get_field_index("rows")
        merged = merged.set_column(at, "rows", pa.array(sums, pa.int64()))
        # The last digest may go on in the next batch.
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
        held = merged.slice(merged.num_rows - 1)
    if held is not None:
        yield from held.to_batches()


def sorted_merge(runs: DataFrame) -> DataFrame:
    """Each partition's entries, sorted and merged; the longest text, then the smallest id, first."""
    order = ["digest", "check", F.desc("length"), F.asc_nulls_last("doc_id")]
    return runs.sortWithinPartitions(*order).mapInArrow(merge_runs, RUN_SCHEMA)


def tree_merge(entries: DataFrame, parts: int | None = None, round_bits: int = ROUND_BITS) -> DataFrame:
    """One entry per digest of `entries` (digest, check, length, doc_id, rows)."""
    parts = parts or parts_of(entries.sparkSession)
    rounds = max(1, ceil(log(max(parts, 2), 2) / round_bits - 1e-9))
    slots = 1 << (round_bits * rounds)
    home = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") % slots
    runs = entries.withColumn("home", home.cast("int"))
    runs = sorted_merge(runs.withColumn("run", F.spark_partition_id() % slots))
    for level in range(rounds):
        mask = ((1 << round_bits) - 1) << (round_bits * level)
        to = F.col("run").bitwiseAND(F.lit(slots - 1 - mask)).bitwiseOR(F.col("home").bitwiseAND(mask))
        runs = sorted_merge(runs.withColumn("run", to).repartitionById(slots, "run"))
    return runs


def exact_groups(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they agree without blanks; null counts as empty. Of equal texts the
    one with the most code points stays, then the one with the smallest doc_id (null ids
    last). Of repeated rows, equal in doc_id and text, one is kept; all are counted and
    returned. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.length(text).cast("bigint").alias("length"),
        F.regexp_replace(text, BLANKS, "").alias("_plain"),
    ).select("doc_id", "length", F.sha2("_plain", 256).alias("digest"), F.xxhash64("_plain").alias("check"))
    entries = stored(
        plain.groupBy("digest", "check", "length", "doc_id").agg(F.count("*").alias("rows")), "digests"
    )
    best = tree_merge(entries, parts).where("rows > 1").select(
        "digest",
        "check",
        F.col("doc_id").alias("keep_id"),
        F.col("length").alias("keep_length"),
        F.col("rows").alias("group_size"),
        F.lit(True).alias("shared"),
    )
    # Adaptive execution splits the entries of a text with many ids; the other side is a row.
    rows = each_copy(entries.join(best, ["digest", "check"], "left"), "rows")
    stays = (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length")))
    return rows.select(
        "doc_id",
        F.when(F.col("shared"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        ((F.coalesce("shared", F.lit(False)) == False) | (stays & (F.col("copy") == 0))).alias("kept"),  # noqa: E712
        F.col("digest").alias("text_sha256"),
    )
