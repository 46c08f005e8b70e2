"""Completions: attach them to problems, nest and unnest the per-problem arrays."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions import text
from .chunks import CHUNK_ROWS, chunk_copies, chunk_number, join_by_key
from .rows import each, with_known

# Samples per nested row: at 0.4 MB a text, the most a context window holds, about 100 MB.
PART_ROWS = 256


def attach_completions(
    problems: DataFrame, completions: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One row per problem and completion, texts stripped.

    completions: (problem_id, sample_idx, output, finish_reason). A problem over budget
    takes none, whatever the table holds; a problem without any keeps one row with nulls.
    """
    asked = completions.withColumn("output", text.strip(F.col("output")))
    return join_by_key(
        asked,
        problems,
        "problem_id",
        "sample_idx",
        chunk_rows,
        keep_all_keys=True,
        only=~F.col("over_budget"),
    )


def nest_samples(samples: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Arrays per problem: outputs, finish reasons and pass rates in sample order.

    A problem whose sample numbers pass `part_rows` fills several rows, numbered by `part`;
    problems of usual size fill one. Each row tells its problem's `n_parts` and the number
    of its `first_sample`. A problem without samples gets empty arrays.
    """
    member = F.when(
        F.col("sample_idx").isNotNull(),
        F.struct("sample_idx", "output", "finish_reason", "pass_rate"),
    )
    part = chunk_number("sample_idx", part_rows).alias("part")
    nested = (
        samples.withColumn("part", part)
        .groupBy("problem_id", "part")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
    )
    # Numbers only; the join is on the keys that the texts are grouped by already.
    numbers = samples.select("problem_id", part).distinct()
    last = numbers.groupBy("problem_id").agg((F.max("part") + 1).alias("n_parts"))
    nested = nested.join(numbers.join(last, "problem_id"), ["problem_id", "part"])
    return nested.select(
        "problem_id",
        "part",
        "n_parts",
        (F.col("part") * part_rows).alias("first_sample"),
        F.col("members.output").alias(fx.OUTPUTS),
        F.col("members.finish_reason").alias(fx.FINISH_REASONS),
        F.col("members.pass_rate").alias(fx.PASS_RATES),
    )


def nest_completions(completions: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(problem_id, part, members): stripped outputs and finish reasons in sample order."""
    member = F.struct("sample_idx", text.strip(F.col("output")).alias("output"), "finish_reason")
    part = chunk_number("sample_idx", part_rows).alias("part")
    return completions.groupBy("problem_id", part).agg(F.array_sort(F.collect_list(member)).alias("members"))


def first_parts(completions: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(problem_id, members, last): the samples of a problem's first part, and its last part's number.

    Of further parts, which only a hot problem has, no text is moved.
    """
    member = F.struct("sample_idx", text.strip(F.col("output")).alias("output"), "finish_reason")
    part = chunk_number("sample_idx", part_rows)
    return completions.groupBy("problem_id").agg(
        F.array_sort(F.collect_list(F.when(part == 0, member))).alias("members"), F.max(part).alias("last")
    )


def nest_rates(rates: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(problem_id, part, rates): a map from sample number to pass rate, in parts as the texts are."""
    part = chunk_number("sample_idx", part_rows)
    entries = F.collect_list(F.struct("sample_idx", "pass_rate"))
    # The part as a result: a filter on it is not pushed below the shared shuffle.
    nested = rates.groupBy("problem_id", part.alias("_part")).agg(
        F.map_from_entries(entries).alias("rates"), F.max(part).alias("part")
    )
    return nested.select("problem_id", "part", "rates")


def generated_table(
    asked: DataFrame,
    completions: DataFrame,
    rates: DataFrame | None = None,
    part_rows: int = PART_ROWS,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The nested table: problem columns beside the arrays of their samples.

    asked: problems with `over_budget`; completions: (problem_id, sample_idx, output,
    finish_reason); rates: (problem_id, sample_idx, pass_rate), or None where nothing was
    verified. `prepare` adds problem columns, `over_budget` among them, where `asked` lacks
    them: it works on the joined rows, so what it adds is not shuffled. Rows are parts as in
    `nest_samples`. Texts are nested once; rates are nested by the same keys and zipped in the
    row. A problem's row meets its first part by the problem's number alone; only where there
    are more parts is it copied, once per part, and dealt by (problem, part). A problem over
    budget takes no samples; it, and one without any, keeps one row with empty arrays.
    """
    number = chunk_number("sample_idx", part_rows)
    beyond = completions.where(number != 0)
    own, further = first_parts(completions, part_rows), nest_completions(beyond, part_rows)
    if rates is None:
        own, further = (df.withColumn("rates", F.lit(None).cast("map<bigint,double>")) for df in (own, further))
    else:
        rated = nest_rates(rates, part_rows)
        own = own.join(rated.where(F.col("part") == 0).drop("part"), "problem_id", "left")
        further = further.join(rated, ["problem_id", "part"], "left")
    names = {name: f"_{name}" for name in ("part", "members", "rates", "last")}
    own = own.withColumn("part", F.lit(0).cast("bigint")).withColumnsRenamed(names)
    # With no number a problem has no samples; set apart, they leave both joins one shuffle of the rest.
    known, nameless = asked.where(F.col("problem_id").isNotNull()), asked.where(F.col("problem_id").isNull())
    first = known.join(own, "problem_id", "left").unionByName(nameless, allowMissingColumns=True)
    lasts = beyond.groupBy("problem_id").agg(F.greatest(F.max(number), F.lit(0)).alias("_last"))
    copies = chunk_copies(known.join(lasts, "problem_id"), "problem_id", beyond, "sample_idx", part_rows)
    more = copies.withColumnRenamed("_chunk", "_part").join(further.withColumnsRenamed(names), ["problem_id", "_part"])
    if prepare is not None:
        first, more = prepare(first), prepare(more)
    takes = F.coalesce(~F.col("over_budget"), F.lit(False))
    alone = F.col("_last").isNull() | (F.size("_members") > 0) | ~takes
    # Marks, not filters on the budget: those would move below the joins, and the prompts with them.
    first = with_known(first, "_mark", F.when(alone, True))
    more = with_known(more, "_mark", F.when(takes, True))
    kept = takes & F.col("_last").isNotNull()
    members = F.when(kept, F.col("_members")).otherwise(F.array())
    rate = lambda member: F.try_element_at(F.col("_rates"), member["sample_idx"].cast("bigint"))
    part = F.coalesce("_part", F.lit(0).cast("bigint"))
    problem = [c for c in first.columns if c not in ("problem_id", "_mark", *names.values())]

    def finished(rows):
        return rows.withColumn("_members", members).select(
            "problem_id",
            *problem,
            part.alias("part"),
            F.when(kept, F.col("_last") + 1).otherwise(1).cast("bigint").alias("n_parts"),
            (part * part_rows).alias("first_sample"),
            F.col("_members.output").alias(fx.OUTPUTS),
            F.col("_members.finish_reason").alias(fx.FINISH_REASONS),
            F.transform("_members", rate).alias(fx.PASS_RATES),
        )

    return finished(first).union(finished(more))


def paired(outputs: str = fx.OUTPUTS, rates: str = fx.PASS_RATES) -> Column:
    """Array of (output, pass_rate) by place, cut to the shorter; null when there is none."""
    both = F.least(F.size(outputs), F.size(rates))
    return F.when(
        both > 0,
        F.arrays_zip(
            F.slice(outputs, F.lit(1), both).alias("output"),
            F.slice(rates, F.lit(1), both).alias("pass_rate"),
        ),
    )


def unnest_samples(generated: DataFrame, *keep: str) -> DataFrame:
    """Rows (sample_idx, output, pass_rate) of the nested table, after the `keep` columns.

    Numbers go on from the row's stored `first_sample`; without one, from 0.
    """
    first = F.col("first_sample") if "first_sample" in generated.columns else F.lit(None)
    numbered = generated.withColumn("_offset", F.coalesce(first, F.lit(0)))
    return each(numbered, [*keep, "_offset"], paired(), "_pos", "_pair").select(
        *keep,
        (F.col("_offset") + F.col("_pos")).cast("bigint").alias("sample_idx"),
        F.col("_pair.output").alias("output"),
        F.col("_pair.pass_rate").alias("pass_rate"),
    )
