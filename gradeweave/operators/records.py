"""Training records from groups: prompts, ground truth, index, exact split."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fx
from ..functions import text
from .chunks import dense_index

TRAIN, TEST = "train", "test"
#: Hash digits that a step of the split counts by: at most 65,536 counts.
DIGITS = 4
#: Hashes, of 32 characters, that one task ranks.
MOST_RANKED = 1 << 20


def array_or_json(df: DataFrame, name: str, element: str) -> Column:
    """The column as an array, whether it is stored as one or as JSON text."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.from_json(column, f"array<{element}>")
    return column.cast(f"array<{element}>")


def read_groups_columns(groups: DataFrame) -> DataFrame:
    """Groups with `candidates_code` and `pass_rates` as arrays."""
    return groups.withColumns(
        {
            "candidates_code": array_or_json(groups, "candidates_code", "string"),
            "pass_rates": array_or_json(groups, "pass_rates", "double"),
        }
    )


def length_violations(groups: DataFrame) -> DataFrame:
    """Groups whose candidates and pass rates differ in number."""
    return groups.where(F.size("candidates_code") != F.size("pass_rates"))


def checked(groups: DataFrame) -> DataFrame:
    """The same groups; running it fails on the first length mismatch."""
    mismatch = F.raise_error(
        F.concat(
            F.lit("length mismatch: "),
            F.size("candidates_code").cast("string"),
            F.lit(" candidates, "),
            F.size("pass_rates").cast("string"),
            F.lit(" pass rates"),
        )
    )
    return groups.withColumn(
        "pass_rates",
        F.when(F.size("candidates_code") == F.size("pass_rates"), F.col("pass_rates")).otherwise(
            mismatch.cast("array<double>")
        ),
    )


def record_index(groups: DataFrame) -> DataFrame:
    """Add `index`: the row's place in the order of (problem_id, group_idx), from 0.

    Rows are numbered by their keys alone and then joined to their numbers, so where those
    are few enough to be sent along, the rows stay where they are.
    """
    keys = ["problem_id", "group_idx"]
    numbered = dense_index(groups.select(*keys), *keys, "index")
    return numbered if groups.columns == keys else groups.join(numbered, keys)


def write_slots(spark, parts: int) -> Column:
    """An array with a number for each of `parts` partitions that `repartition` deals to it."""
    tried = 16 * parts
    while True:
        numbers = spark.range(tried).select(F.col("id").cast("int").alias("slot"))
        placed = numbers.groupBy(F.pmod(F.hash("slot"), F.lit(parts)).alias("part")).agg(F.min("slot").alias("slot"))
        found = {r["part"]: r["slot"] for r in placed.collect()}
        if len(found) == parts:
            return F.array(*[F.lit(found[part]) for part in range(parts)])
        tried *= 4


def dealt_with_index(labelled: DataFrame) -> DataFrame:
    """`labelled` groups with `index`, dealt and sorted as `write_split` stores them: by shuffle key.

    The numbers are made from the keys alone. Each then travels to where its row is written,
    and both meet there by their shuffle key, which no two rows share; so the rows with their
    texts are shuffled once, into the ranges of the key.
    """
    spark = labelled.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefix = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint")
    part = F.floor(prefix * parts / 16**8).cast("int")
    slot = F.element_at(write_slots(spark, parts), part + 1).alias("_slot")
    keys = labelled.select("problem_id", "group_idx", "split", "shuffle_key")
    numbers = dense_index(keys, "problem_id", "group_idx", "index")
    numbers = numbers.select("split", "shuffle_key", "index", slot, F.lit(0).alias("_turn"))
    rows = labelled.select("*", F.lit(None).cast("bigint").alias("index"), slot, F.lit(1).alias("_turn"))
    both = rows.unionByName(numbers, allowMissingColumns=True).repartition(parts, "_slot")
    turn = Window.partitionBy("_slot", "split", "shuffle_key").orderBy("_turn")
    met = both.withColumn("index", F.first("index").over(turn)).where("_turn = 1")
    return met.drop("_slot", "_turn").sortWithinPartitions("split", "shuffle_key")


def training_records(groups: DataFrame, *keep: str) -> DataFrame:
    """Nested records (data_source, prompt, ability, reward_model, extra_info).

    groups: (prompt, candidates_code, pass_rates, index); `keep` adds further columns.
    """
    chat = F.array(
        F.struct(
            F.lit("user").alias("role"),
            text.ranking_prompt(F.col("prompt"), F.col("candidates_code")).alias("content"),
        )
    )
    return checked(groups).select(
        *keep,
        F.lit(fx.RECORD_KIND).alias("data_source"),
        chat.alias("prompt"),
        F.lit(fx.RECORD_KIND).alias("ability"),
        F.struct(
            F.lit(fx.REWARD_STYLE).alias("style"),
            text.json_array(F.col("pass_rates")).alias("ground_truth"),
        ).alias("reward_model"),
        F.struct(
            F.col("index"), F.size("candidates_code").alias("n_candidates")
        ).alias("extra_info"),
    )


def within_prompt_limit(
    records: DataFrame, tokens: Column, limit: int = fx.MAX_PROMPT_TOKENS
) -> DataFrame:
    """Records whose prompt has at most `limit` tokens by the given count."""
    return records.where(tokens <= limit)


def shuffle_key(keys, seed: int = fx.SPLIT_SEED) -> Column:
    """Text that sorts the rows in an order that looks random and never changes."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _first_after(hashes: DataFrame, share: float) -> str | None:
    """The hash with floor(n * share) others before it; None where that is all of them.

    One pass counts hashes per prefix, at most 16 ** DIGITS counts, and tells in which prefix
    the hash lies; the next ranks that prefix alone, or, if it holds more than MOST_RANKED,
    first counts longer prefixes in it.
    """
    near, digits, place = hashes, 0, None
    while True:
        digits += DIGITS
        counts = near.groupBy(F.substring("h", 1, digits).alias("prefix")).agg(F.count("*").alias("n"))
        whole = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        wanted = F.floor(F.sum("n").over(whole) * F.lit(share)) if place is None else F.lit(place)
        placed = counts.select(
            "prefix", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), wanted.alias("place")
        )
        held = placed.where(F.col("before") + F.col("n") > F.col("place"))
        edge = held.agg(F.min(F.struct("prefix", "n", (F.col("place") - F.col("before")).alias("inside"))).alias("e")).first()["e"]
        if edge is None:
            return None
        near = near.where(F.substring("h", 1, digits) == edge["prefix"])
        place = int(edge["inside"])
        if edge["n"] <= MOST_RANKED or digits >= 32:
            break
    ranked = near.select("h", F.row_number().over(Window.orderBy("h")).alias("i"))
    # The hash, and the one before it, if that has the same prefix.
    around = [r["h"] for r in ranked.where(F.col("i").between(place, place + 1)).orderBy("i").collect()]
    if len(set(around)) < len(around):
        raise ValueError("split keys are not unique")
    return around[-1]


def train_val_split(
    rows: DataFrame,
    val_ratio: float = fx.VAL_RATIO,
    seed: int = fx.SPLIT_SEED,
    by: str = "group",
) -> DataFrame:
    """Add `shuffle_key` and `split`: exactly int(n * (1 - val_ratio)) units are 'train'.

    The units are rows, told apart by (problem_id, group_idx); with by='problem' they are
    problems, so that no problem is on both sides. The first hash of the validation part is
    looked up at once, in two passes over the keys; whole rows are then labelled by
    comparing with it, in any later plan, and never shuffled.
    """
    keys = ("problem_id",) if by == "problem" else ("problem_id", "group_idx")
    key = shuffle_key(keys, seed)
    units = rows.select(*keys).distinct() if by == "problem" else rows
    first_val = _first_after(units.select(key.alias("h")), 1 - val_ratio)
    # No such hash means an empty validation part.
    is_train = F.lit(True) if first_val is None else F.col("shuffle_key") < first_val
    return rows.withColumn("shuffle_key", key).withColumn(
        "split", F.when(is_train, TRAIN).otherwise(TEST)
    )


def split_counts(labelled: DataFrame) -> DataFrame:
    """Rows per side of the split."""
    return labelled.groupBy("split").agg(F.count("*").alias("n"))
