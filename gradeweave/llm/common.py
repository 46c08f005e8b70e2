"""What several operators share: stored intermediates, row numbers, words of Arrow texts."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Words of the contracts: runs of anything but space, tab, line feed, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows that one explode makes from one row before they are dealt out again.
BLOCK_ROWS = 4096
#: Bytes of text whose words a task holds at a time.
SLICE_BYTES = 4 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back, so that it is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(spark) -> int:
    """The number of shuffle partitions the session is set to, which its owner fits to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text) -> Column:
    """Number of words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def md5_int(value: Column, digits: int) -> Column:
    """The first hex digits of the value's md5 as a number; null counts as an empty text."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def row_key(docs: DataFrame) -> Column:
    """96 bits of hash over all columns of a row; equal rows, nulls included, have equal keys."""
    values = [F.col(c) for c in docs.columns]
    values.append(F.array(*[F.col(c).isNull() for c in docs.columns]))
    return F.struct(F.xxhash64(*values).alias("high"), F.hash(*values).alias("low"))


def rows_once(docs: DataFrame) -> DataFrame:
    """(_row_key, _row): each distinct row, all columns in a struct; repeats end before the shuffle."""
    keyed = docs.select(row_key(docs).alias("_row_key"), F.struct(*docs.columns).alias("_row"))
    return keyed.groupBy("_row_key").agg(F.first("_row").alias("_row"))


def number_rows(rows: DataFrame, group, order, identity, stratum: Column) -> DataFrame:
    """Equal rows once, with `copies` and `position`: their first place in their group, from 0.

    Rows of a group are ordered by (`order`, `stratum`, `identity`). No task holds a group:
    rows are counted per (group, order, stratum), and these few counts give the offsets.
    `stratum` is a hash of the identity, which splits a group whose rows agree in `order`;
    rows that agree in everything are one row here however many there are. Columns of
    `group` and `order` are not null.
    """
    group, order, identity = list(group), list(order), list(identity)
    cell = [*group, *order, "_stratum"]
    rest = [name for name in identity if name not in group + order]
    units = stored(
        rows.groupBy(*group, *order, *rest)
        .agg(F.count("*").alias("copies"))
        .withColumn("_stratum", stratum),
        "units",
    )

    def before(value, by, sort):
        window = Window.partitionBy(*by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(window), F.lit(0))

    # A row per stratum, then a row per (group, order): each window sees one group's counts only.
    cells = units.groupBy(*cell).agg(F.sum("copies").alias("_rows"))
    classes = cells.groupBy(*group, *order).agg(F.sum("_rows").alias("_rows"))
    if order:
        classes = classes.select(*group, *order, before("_rows", group, order).alias("_base"))
    else:
        classes = classes.select(*group, F.lit(0).cast("bigint").alias("_base"))
    offsets = cells.withColumn("_inside", before("_rows", [*group, *order], ["_stratum"])).join(
        classes, [*group, *order]
    )
    offsets = offsets.select(*cell, (F.col("_inside") + F.col("_base")).alias("_offset"))
    placed = units.withColumn("_place", before("copies", cell, rest))
    return (
        placed.join(offsets, cell)
        .withColumn("position", (F.col("_offset") + F.col("_place")).cast("bigint"))
        .drop("_offset", "_place", "_stratum")
    )


def each_copy(units: DataFrame, copies: str = "copies", name: str = "copy") -> DataFrame:
    """One row per copy, numbered from 0; no row for none. Many copies are dealt over tasks."""
    last = F.floor((F.col(copies) - 1) / BLOCK_ROWS)
    blocks = F.when(F.col(copies) > 0, F.sequence(F.lit(0).cast("bigint"), last))
    dealt = units.withColumn("_block", F.explode(blocks))
    dealt = dealt.repartition(*[F.col(c) for c in units.columns], "_block")
    first = F.col("_block") * BLOCK_ROWS
    to = F.least(first + BLOCK_ROWS, F.col(copies)) - 1
    return dealt.withColumn(name, F.explode(F.sequence(first, to))).drop("_block")


def copied(rows, first: int, until: int):
    """These rows of a batch, in buffers of their own.

    Arrow's string functions misread a slice that was cast to longer offsets.
    """
    whole = first == 0 and until == rows.num_rows
    return rows if whole else rows.take(pa.array(np.arange(first, until)))


def by_bytes(batches, column: str = "text", most: int = SLICE_BYTES):
    """The batches in slices of about `most` bytes of text each; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > first and total + size > most:
                yield copied(batch, first, i)
                first, total = i, 0
            total += size
        if first < len(sizes):
            yield copied(batch, first, len(sizes))
    # What the pool holds for reuse would stay with the process through the stages to come.
    pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array, lower: bool = True):
    """(words, counts): the words of all texts in a row, and how many each text has. Null: none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        if texts.offset:
            texts = texts.take(pa.array(np.arange(len(texts))))
        texts = texts.cast(pa.large_string())  # a batch of long texts may pass 2 GB of offsets
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = split.flatten()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(words, "")
    if pc.all(real).as_py() is False:
        keep = real.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[keep], minlength=len(counts)).astype(np.int64)
        words = words.filter(real)
    return words, counts


def coded(words: pa.Array):
    """(codes, distinct words) of an array of words."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def hashes(distinct: pa.Array, seed: int = 42) -> np.ndarray:
    """XXH64 of each word's UTF-8."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that any of their bits may pick a shard."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))
