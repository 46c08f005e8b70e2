"""Sharding by jump consistent hashing, in DataFrame operations only.

A key walks a fixed sequence of pseudo-random jumps over ever larger shard numbers; the last
one below the shard count is its shard. One more shard therefore only takes keys into itself,
about 1/(n+1) of them, and no table of ring positions is kept.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_copy, md5_int, number_rows

#: The generator's multiplier, as four 16-bit digits from the lowest, and its range.
MULTIPLIER = 2862933555777941757
DIGITS = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
RANGE = float(1 << 31)
LOW32 = 0xFFFFFFFF
#: Jumps tried at first; the number of jumps grows with the logarithm of the shard count.
FIRST_JUMPS = 64
#: Strata per shard when slots are numbered.
STRATA_DIGITS = 3


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """64-bit multiply and add one, in halves of 32 bits that never pass a signed 64-bit number."""
    c0, c1, c2, c3 = (F.lit(d).cast("bigint") for d in DIGITS)
    step = low * c0 + F.shiftleft((low * c1).bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(step, 32)
    upper = (
        carry
        + F.shiftright(low * c1, 16)
        + low * c2
        + F.shiftleft((low * c3).bitwiseAND(0xFFFF), 16)
        + high * c0
        + F.shiftleft((high * c1).bitwiseAND(0xFFFF), 16)
    )
    return upper.bitwiseAND(LOW32), step.bitwiseAND(LOW32)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a 64-bit key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))

    def walk(jumps):
        start = F.struct(
            F.lit(-1).cast("bigint").alias("shard"),
            F.lit(0).cast("bigint").alias("jump"),
            F.shiftrightunsigned(key, 32).alias("high"),
            key.bitwiseAND(LOW32).alias("low"),
        )

        def step(state, _):
            high, low = _next_state(state["high"], state["low"])
            drawn = (F.shiftright(high, 1) + 1).cast("double")
            jump = F.floor((state["jump"] + 1).cast("double") * (F.lit(RANGE) / drawn))
            moved = F.struct(
                state["jump"].alias("shard"),
                jump.cast("bigint").alias("jump"),
                high.alias("high"),
                low.alias("low"),
            )
            return F.when(state["jump"] < shards, moved).otherwise(state)

        return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), start, step)

    # Each jump goes up by one at least, so `shards` jumps always reach the end.
    if shards <= FIRST_JUMPS:
        return walk(shards)["shard"].cast("int")
    tried = walk(FIRST_JUMPS)
    done = F.when(tried["jump"] >= shards, tried["shard"]).otherwise(walk(shards)["shard"])
    return done.cast("int")


def key_of(docs: DataFrame, column: str) -> Column:
    """A 64-bit key: the number itself, or a hash of another type's value."""
    if dict(docs.dtypes)[column] in ("tinyint", "smallint", "int", "bigint"):
        return F.col(column).cast("bigint")
    return F.xxhash64(F.col(column))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """`docs` with the shard of each row's key: a projection, no shuffle.

    Null keys count as key 0. Rows of one key share a shard. Other columns are untouched; an
    existing column of the given name is replaced.
    """
    return docs.withColumn(name, jump_shard(key_of(docs, key), shards))


def shard_layout(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, size, text_crc32, law, shard, slot and grown_shard.

    `size` is the text's UTF-8 bytes plus 1 (null: 1), `slot` its gapless place in the shard
    from 0, `grown_shard` its shard with one shard more. Null, empty and very long texts,
    repeated rows and null keys are rows like any other; an empty table gives none.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(value) + 1).cast("bigint").alias("size"),
        F.crc32(value).alias("text_crc32"),
    )
    rows = narrow.withColumn("shard", jump_shard(key_of(narrow, "_key"), shards))
    identity = ["_key", "size", "text_crc32"]
    # By the whole identity: one key, such as null, may have very many rows.
    stratum = md5_int(F.concat_ws("|", *identity), STRATA_DIGITS)
    units = number_rows(rows, ["shard"], [], identity, stratum)
    units = units.withColumn("grown_shard", jump_shard(key_of(units, "_key"), shards + 1))
    return each_copy(units).select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("position") + F.col("copy")).cast("bigint").alias("slot"),
        "grown_shard",
    )
