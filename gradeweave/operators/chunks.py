"""Even work on uneven keys.

Positions inside a key (sample, group or rollout numbers) are dense, so `index div rows`
cuts a key of any size into chunks of bounded size: a small key is one chunk, a key with
a third of the table is many. Heavy rows are shuffled by (key, chunk); what a whole key
must know is aggregated before it is shuffled and joined back per chunk.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

CHUNK_ROWS = 4096
#: Copies of a key's row that one task makes; the blocks of a key with more are dealt out first.
BLOCK_CHUNKS = 64


def chunk_number(index: str, rows: int = CHUNK_ROWS):
    """Chunk of a dense position; null positions go with the first."""
    return F.coalesce(F.expr(f"cast({index} as bigint) div {int(rows)}"), F.lit(0).cast("bigint"))


def join_by_key(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    index: str,
    chunk_rows: int = CHUNK_ROWS,
    keep_all_keys: bool = False,
    only: Column | None = None,
    numbering: DataFrame | None = None,
) -> DataFrame:
    """`rows` with the columns of their key's one row in `per_key`.

    The key's row is copied once per chunk that its rows fill, and the join is on
    (key, chunk), so no task gets more than `chunk_rows` of a key's rows. With
    `keep_all_keys`, keys without rows stay, with nulls in the columns of `rows`;
    `only`, a condition on `per_key`, says which keys take rows at all. `numbering` gives
    the (key, index) of these rows, and maybe of more, where it is cheaper to read than the
    rows themselves; it needs inner joins.
    """
    chunked = rows.withColumn("_chunk", chunk_number(index, chunk_rows))
    numbered = rows if numbering is None else numbering
    how = "left" if keep_all_keys else "inner"
    copies = chunk_copies(per_key, key, numbered, index, chunk_rows, how, only)
    return copies.join(chunked, [key, "_chunk"], how).drop("_chunk")


def chunk_copies(
    per_key: DataFrame,
    key: str,
    numbering: DataFrame,
    index: str,
    chunk_rows: int = CHUNK_ROWS,
    how: str = "inner",
    only: Column | None = None,
) -> DataFrame:
    """The rows of `per_key`, each once per `_chunk` that its key fills in `numbering`.

    Copies are made on two levels: a key's chunks are listed in blocks, and its row is joined
    to the list of each block. A key's first block is spread where it is; further blocks, of a
    hot key only, are dealt over tasks before their copies are made, so the copies of one key
    are no task's alone. With how='left', a key without chunks stays, with a null chunk.
    """
    chunk = chunk_number(index, chunk_rows)
    block = F.expr(f"_chunk div {BLOCK_CHUNKS}")
    blocks = (
        numbering.select(F.col(key).alias("_key"), chunk.alias("_chunk"))
        .groupBy("_key", block.alias("_block"))
        # The block once more: a filter on a result is not pushed below the shared shuffle.
        .agg(F.collect_set("_chunk").alias("_chunks"), F.max(block).alias("_at"))
        .drop("_block")
    )
    takes = F.col(key) == F.col("_key")
    if only is not None:
        takes = takes & only
    placed = per_key.join(blocks, takes, how).drop("_key")
    first = placed.where(F.coalesce("_at", F.lit(0)) == 0)
    more = placed.where(F.col("_at") > 0).repartition(key, "_at")
    spread = [
        part.select(*per_key.columns, F.explode_outer("_chunks").alias("_chunk")) for part in (first, more)
    ]
    return spread[0].union(spread[1])


def dense_index(
    rows: DataFrame, key: str, index: str, name: str, ranges: int | None = None
) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the order of (key, index), without one big sort.

    One pass over the keys counts rows per (key, chunk) and stores the counts in ranges of
    keys, as many as the session has shuffle partitions. The sums before each range, a number
    per range, and the sums inside the ranges give each chunk's offset; rows then only need
    their place inside their own chunk.
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunked = rows.withColumn("_chunk", chunk_number(index))
    units = chunked.groupBy(key, "_chunk").agg(F.count("*").alias("_rows"))
    # Which range a count is in is stored with it: a later run may cut ranges elsewhere.
    ranged = units.repartitionByRange(ranges, key, "_chunk").withColumn("_range", F.spark_partition_id())
    path = scratch_path(spark, "chunk-counts")
    ranged.write.parquet(path)
    counts = spark.read.schema(ranged.schema).parquet(path)

    shifts, total = [0] * ranges, 0
    for row in counts.groupBy("_range").agg(F.sum("_rows").alias("n")).orderBy("_range").collect():
        shifts[row["_range"]] = total
        total += row["n"]
    shift = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in shifts]), F.col("_range") + 1)
    inside_range = (
        Window.partitionBy("_range")
        .orderBy(key, "_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("_rows").over(inside_range), F.lit(0))
    offsets = counts.select(key, "_chunk", (shift + before).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(index)) - 1
    return (
        chunked.join(offsets, [key, "_chunk"])
        .withColumn(name, (F.col("_offset") + inside).cast("bigint"))
        .drop("_chunk", "_offset")
    )
