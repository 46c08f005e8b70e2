"""Candidate groups: valid samples, problem filters, groups of K, statistics.

Two inputs, one meaning. The nested table (a row holds a problem's arrays) is grouped
inside the row, with no shuffle. The long table (a row per sample) is cut into chunks
(see `chunks`), so one problem may hold any share of the rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions import text
from ..functions.text import let
from .chunks import CHUNK_ROWS, chunk_number, join_by_key
from .completions import paired, unnest_samples
from .rows import each, with_known

KEPT, ALL_CORRECT, ALL_WRONG, HIGH_RATIO = "kept", "all_correct", "all_wrong", "high_ratio"


def drop_reason(lowest: Column, highest: Column, full_share: Column, max_pass_ratio) -> Column:
    """Why a problem gives no groups; the first reason that holds, else 'kept'."""
    return (
        F.when((lowest == 1.0) & (highest == 1.0), ALL_CORRECT)
        .when((lowest == 0.0) & (highest == 0.0), ALL_WRONG)
        .when(full_share > max_pass_ratio, HIGH_RATIO)
        .otherwise(KEPT)
    )


def mixed(rates: Column) -> Column:
    """Some rate is exactly 1 and some is below 1."""
    return F.array_contains(rates, 1.0) & (F.array_min(rates) < 1.0)


def valid_samples(samples: DataFrame) -> DataFrame:
    """Samples whose pass rate is known."""
    return samples.where(F.col("pass_rate").isNotNull())


# --- long form


def chunk_stats(valid: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per (problem, chunk): its rows, the rows before it, and the whole problem's figures.

    Reads three narrow columns; counts are combined before the shuffle, and the windows
    run over chunks, not samples.
    """
    rate = F.col("pass_rate")
    per_chunk = (
        valid.select("problem_id", chunk_number("sample_idx", chunk_rows).alias("chunk"), rate)
        .groupBy("problem_id", "chunk")
        .agg(
            F.count("*").alias("chunk_n"),
            F.min(rate).alias("chunk_lowest"),
            F.max(rate).alias("chunk_highest"),
            F.count_if(rate == 1.0).alias("chunk_full"),
        )
    )
    earlier = (
        Window.partitionBy("problem_id")
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy("problem_id")
    return per_chunk.select(
        "problem_id",
        "chunk",
        "chunk_n",
        F.coalesce(F.sum("chunk_n").over(earlier), F.lit(0)).alias("n_before"),
        F.sum("chunk_n").over(whole).alias("n"),
        F.count("*").over(whole).alias("n_chunks"),
        F.min("chunk_lowest").over(whole).alias("lowest"),
        F.max("chunk_highest").over(whole).alias("highest"),
        F.sum("chunk_full").over(whole).alias("n_full"),
    )


def with_positions(samples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Valid samples with their 0-based position within the problem."""
    valid = valid_samples(samples)
    return _placed(valid, chunk_stats(valid, chunk_rows), chunk_rows).drop(
        "chunk", "chunk_n", "n_before", "n_chunks", "lowest", "highest", "n_full"
    )


def _placed(valid: DataFrame, stats: DataFrame, chunk_rows: int) -> DataFrame:
    in_chunk = Window.partitionBy("problem_id", "chunk").orderBy("sample_idx")
    return (
        valid.withColumn("chunk", chunk_number("sample_idx", chunk_rows))
        .join(stats, ["problem_id", "chunk"])
        .withColumn("position", F.col("n_before") + F.row_number().over(in_chunk) - 1)
    )


def candidate_groups(
    samples: DataFrame,
    group_size: int = fx.GROUP_SIZE,
    max_pass_ratio: float = fx.MAX_PASS_RATIO,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Mixed groups of `group_size` consecutive valid samples, from one row per sample.

    samples: (problem_id, sample_idx, output, pass_rate), sample_idx dense per problem.
    Sample texts are shuffled once, by (problem, chunk). Groups inside a chunk, so all
    groups of a problem with one chunk, are complete there; only groups that cross the
    edge of a chunk are put together by a second, small shuffle.
    """
    valid = valid_samples(samples.select("problem_id", "sample_idx", "output", "pass_rate"))
    reason = drop_reason(
        F.col("lowest"), F.col("highest"), F.col("n_full") / F.col("n"), max_pass_ratio
    )
    kept = chunk_stats(valid, chunk_rows).where(reason == KEPT)

    start = F.col("group_idx") * group_size
    inside = (start >= F.col("n_before")) & (
        start + group_size <= F.col("n_before") + F.col("chunk_n")
    )
    complete = start + group_size <= F.col("n")
    member = F.struct("position", "output", "pass_rate")

    def grouped(stats):
        return _placed(valid, stats, chunk_rows).withColumn(
            "group_idx", F.expr(f"position div {int(group_size)}")
        )

    # The row that opens a group sees the rest of it in the next rows of its chunk.
    ahead = (
        Window.partitionBy("problem_id", "chunk").orderBy("sample_idx").rowsBetween(0, group_size - 1)
    )
    within = (
        grouped(kept)
        .withColumn("members", F.collect_list(member).over(ahead))
        .where(inside & (F.col("position") == start))
        .select("problem_id", "group_idx", "members")
    )
    across = (
        grouped(kept.where(F.col("n_chunks") > 1))
        .where(~inside & complete)
        .groupBy("problem_id", "group_idx")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
    )
    groups = within.unionByName(across).select(
        "problem_id",
        "group_idx",
        F.col("members.output").alias("candidates"),
        F.col("members.pass_rate").alias("pass_rates"),
    )
    return _finish(groups.where(mixed(F.col("pass_rates"))))


def _finish(groups: DataFrame) -> DataFrame:
    """Extract code last, for the groups that are kept."""
    return groups.withColumn(
        "candidates_code", F.transform("candidates", text.extract_code_or_text)
    )


def with_problems(
    groups: DataFrame,
    problems: DataFrame,
    samples: DataFrame,
    group_size: int = fx.GROUP_SIZE,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The groups with the columns (canonical_id, prompt, ...) of their problem.

    The sample numbers bound the group numbers, so the groups are not made a second time
    to count them.
    """
    possible = samples.select(
        "problem_id", F.expr(f"sample_idx div {int(group_size)}").alias("group_idx")
    )
    return join_by_key(
        groups, problems, "problem_id", "group_idx", chunk_rows, numbering=possible
    )


def problem_outcomes(
    samples: DataFrame, max_pass_ratio: float = fx.MAX_PASS_RATIO
) -> DataFrame:
    """Per problem with a valid sample: counts, extremes and the drop reason."""
    rate = F.col("pass_rate")
    return (
        valid_samples(samples)
        .groupBy("problem_id")
        .agg(
            F.count("*").alias("n"),
            F.min(rate).alias("lowest"),
            F.max(rate).alias("highest"),
            F.avg((rate == 1.0).cast("double")).alias("full_share"),
        )
        .withColumn(
            "drop_reason",
            drop_reason(
                F.col("lowest"), F.col("highest"), F.col("full_share"), max_pass_ratio
            ),
        )
    )


# --- nested form


def _known_pairs() -> Column:
    """The row's (output, pass_rate) pairs whose rate is known.

    A null prompt marks a row of a file without that column: it has no pairs.
    """
    known = F.filter(paired(), lambda pair: pair["pass_rate"].isNotNull())
    return F.when(F.col("prompt").isNotNull(), known)


def _whole_pairs(generated: DataFrame) -> Column:
    """`_known_pairs`, but running it fails on a row that holds only a part of its problem."""
    pairs = _known_pairs()
    if "n_parts" not in generated.columns:
        return pairs
    kind = "array<struct<output:string,pass_rate:double>>"
    part = F.raise_error(F.lit("a problem in several rows: use candidate_groups_of_parts"))
    return F.when(F.col("n_parts") > 1, part.cast(kind)).otherwise(pairs)


def valid_candidates(generated: DataFrame) -> DataFrame:
    """Rows with at least one valid sample; `valid` is the array of (output, pass_rate)."""
    valid = let(_known_pairs(), lambda pairs: F.when(F.size(pairs) > 0, pairs))
    return with_known(generated, "valid", valid).drop(fx.OUTPUTS, fx.PASS_RATES)


def _array_reason(rates: Column, max_pass_ratio: float) -> Column:
    full_share = F.size(F.filter(rates, lambda r: r == 1.0)) / F.size(rates)
    return drop_reason(F.array_min(rates), F.array_max(rates), full_share, max_pass_ratio)


def _mixed_groups(pairs: Column, group_size: int, max_pass_ratio: float) -> Column:
    """Array of (group_idx, members): the mixed groups of a problem that is kept."""

    def group(g):
        return F.struct(
            g.alias("group_idx"),
            F.slice(pairs, g * group_size + 1, F.lit(group_size)).alias("members"),
        )

    n_groups = F.floor(F.size(pairs) / group_size).cast("int")
    kept = (n_groups > 0) & (_array_reason(pairs["pass_rate"], max_pass_ratio) == KEPT)
    groups = F.transform(F.sequence(F.lit(0), n_groups - 1), group)
    return F.when(kept, F.filter(groups, lambda g: mixed(g["members"]["pass_rate"])))


def candidate_groups_nested(
    generated: DataFrame,
    *keep: str,
    group_size: int = fx.GROUP_SIZE,
    max_pass_ratio: float = fx.MAX_PASS_RATIO,
) -> DataFrame:
    """As `candidate_groups`, from one row per problem; no shuffle at all.

    `keep` names the problem's columns that each group repeats. The rows must hold whole
    problems, which is checked where the table tells `n_parts`; see
    `candidate_groups_of_parts` for tables where one may fill several rows.
    """
    found = let(_whole_pairs(generated), lambda pairs: _mixed_groups(pairs, group_size, max_pass_ratio))
    groups = each(generated, keep, found, "_pos", "_group").select(
        *keep,
        F.col("_group.group_idx").cast("bigint").alias("group_idx"),
        F.col("_group.members.output").alias("candidates"),
        F.col("_group.members.pass_rate").alias("pass_rates"),
    )
    return _finish(groups)


def candidate_groups_of_parts(
    generated: DataFrame,
    group_size: int = fx.GROUP_SIZE,
    max_pass_ratio: float = fx.MAX_PASS_RATIO,
    chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Groups (problem_id, canonical_id, prompt, group_idx, ...) and outcomes of a nested table with
    `problem_id`, `part`, `n_parts` and `first_sample`.

    Whole problems are grouped inside their row, without a shuffle; those that fill several
    rows go through the long form. A stored column tells them apart, so both are filters of
    the scan; where no problem has parts, the second one reads no row.
    """
    keep = ("problem_id", "canonical_id", "prompt")
    names = (*keep, "group_idx", "candidates", "pass_rates", "candidates_code")
    several = F.coalesce(F.col("n_parts"), F.lit(1)) > 1
    whole, parts = generated.where(~several), generated.where(F.col("n_parts") > 1)
    groups = candidate_groups_nested(
        whole.drop("n_parts"), *keep, group_size=group_size, max_pass_ratio=max_pass_ratio
    )
    outcomes = nested_outcomes(whole.drop("n_parts"), group_size, max_pass_ratio)
    usable = parts.where(F.col("prompt").isNotNull())
    long = unnest_samples(usable, "problem_id")
    problems = usable.where(F.col("part") == 0).select(*keep)
    made = candidate_groups(long, group_size, max_pass_ratio, chunk_rows)
    more = with_problems(made, problems, long, group_size, chunk_rows)
    reasons = problem_outcomes(long, max_pass_ratio).select("drop_reason")
    return (
        groups.select(*names).unionByName(more.select(*names)),
        outcomes.select("drop_reason").unionByName(reasons),
    )


def nested_outcomes(
    generated: DataFrame,
    group_size: int = fx.GROUP_SIZE,
    max_pass_ratio: float = fx.MAX_PASS_RATIO,
) -> DataFrame:
    """Per problem with a valid sample: the drop reason and the number of mixed groups."""
    outcome = let(
        _whole_pairs(generated),
        lambda pairs: F.when(
            F.size(pairs) > 0,
            F.struct(
                _array_reason(pairs["pass_rate"], max_pass_ratio).alias("drop_reason"),
                F.coalesce(
                    F.size(_mixed_groups(pairs, group_size, max_pass_ratio)), F.lit(0)
                ).alias("n_groups"),
            ),
        ),
    )
    return with_known(generated, "_outcome", outcome).select("_outcome.*")


# --- statistics


def grouping_stats(outcomes: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row: problems seen, dropped by reason and kept, groups, shares and averages.

    The groups are counted from `groups` or, without it, by the outcomes' `n_groups`.
    """

    def of(reason):
        return F.count_if(F.col("drop_reason") == reason)

    def percent(part):
        return 100 * F.col(part) / F.greatest("total_queries", F.lit(1))

    in_outcomes = groups is None
    stats = outcomes.agg(
        F.count("*").alias("total_queries"),
        of(ALL_CORRECT).alias("all_correct"),
        of(ALL_WRONG).alias("all_wrong"),
        of(HIGH_RATIO).alias("high_ratio"),
        of(KEPT).alias("remaining"),
        *([F.sum("n_groups").alias("total_groups")] if in_outcomes else []),
    )
    if not in_outcomes:
        stats = stats.withColumn("total_groups", groups.agg(F.count("*")).scalar())
    return stats.withColumns(
        {
            "all_correct_pct": percent("all_correct"),
            "all_wrong_pct": percent("all_wrong"),
            "remaining_pct": percent("remaining"),
            "groups_per_query": F.col("total_groups") / F.greatest("remaining", F.lit(1)),
        }
    )
