"""From completions to pass rates: the work list for a runner, and its results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .chunks import CHUNK_ROWS, chunk_copies, chunk_number, join_by_key
from .problems import test_cases
from .rows import each, with_known

RUN = ("problem_id", "sample_idx", "test_idx")
#: Test number and digest that stand for the sample itself among its runs.
NO_TEST, NOTHING = -1, b""


def execution_worklist(
    samples: DataFrame,
    problems: DataFrame,
    max_tests: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per sample with code and test of its problem, for an outside runner.

    samples: (problem_id, sample_idx, output); problems: (problem_id, test_suites,
    function_name). Blank outputs and outputs without code give no rows.
    """
    coded = with_known(
        samples.select("problem_id", "sample_idx", "output"),
        "code",
        text.extract_code(F.col("output"), empty_is_none=True),
    ).drop("output")
    tested = problems.select(
        "problem_id", "function_name", test_cases(F.col("test_suites"), max_tests).alias("tests")
    )
    # The samples tell their chunks without a look at their texts.
    joined = join_by_key(
        coded, tested, "problem_id", "sample_idx", chunk_rows, numbering=samples
    )
    sample = ("problem_id", "sample_idx", "code", "function_name")
    return each(joined, sample, F.col("tests"), "test_idx", "test").select(
        "problem_id",
        "sample_idx",
        F.col("test_idx").cast("bigint").alias("test_idx"),
        "code",
        "function_name",
        F.col("test.input").alias("input"),
        F.col("test.output").alias("expected_output"),
    )


def with_programs(worklist: DataFrame) -> DataFrame:
    """Add what a runner executes: `program`, and its `stdin`.

    A problem with a function name has the call and the input in its program, and no stdin.
    """
    calls = F.col("function_name").isNotNull()
    called = text.call_program(F.col("code"), F.col("function_name"), F.col("input"))
    return worklist.withColumns(
        {
            "program": F.when(calls, called).otherwise(F.col("code")),
            "stdin": F.when(calls, F.lit("")).otherwise(F.col("input")),
        }
    )


def text_digest(value: Column) -> Column:
    """16 bytes that tell stripped texts apart; texts themselves are not shuffled to compare them."""
    return F.unhex(F.md5(text.strip(value)))


def succeeded(executions: DataFrame) -> DataFrame:
    """(problem_id, sample_idx, test_idx, said) of the runs that ended well; `said` is the output's digest.

    The others cannot have passed, so they end at the scan. A null output counts as empty.
    """
    well = (
        (F.col("status") == 200)
        & ~F.coalesce(F.col("timed_out"), F.lit(False))
        & (F.col("exit_code") == 0)
    )
    return executions.where(well).select(*RUN, text_digest(F.coalesce("stdout", F.lit(""))).alias("said"))


def verify(worklist: DataFrame, executions: DataFrame) -> DataFrame:
    """The work list with `passed`; work that came back with no result did not pass.

    A run with several results, as from a retry, counts once, and passed if any of them did.
    """
    wanted = worklist.select(*RUN, text_digest(F.col("expected_output")).alias("said"))
    right = succeeded(executions).distinct().withColumn("_right", F.lit(True))
    joined = wanted.join(right, [*RUN, "said"], "left")
    return joined.select(*RUN, F.coalesce("_right", F.lit(False)).alias("passed"))


def sample_verdicts(
    samples: DataFrame,
    problems: DataFrame,
    executions: DataFrame,
    max_tests: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(problem_id, sample_idx, n_tests, n_passed, passed): a row per sample with code and tests.

    samples and problems as for `execution_worklist`, whose rows are never made here. `passed`
    holds, per 64 tests, a bit for each that any run of it passed, so retries count once.
    Expected texts become digests in their problem's row; a run passed if its digest is that
    of its test, found by a join on (problem, sample chunk, test, digest). A sample with code
    goes through the same join as a run of no test, and so learns how many tests there are.
    A sample that comes twice has one row, with code if either has.
    """
    cases = test_cases(F.col("test_suites"), max_tests)
    digest = lambda case, i: F.struct(i.cast("bigint").alias("test"), text_digest(case["output"]).alias("said"))
    tested = problems.select("problem_id", F.transform(cases, digest).alias("_digests")).where(F.size("_digests") > 0)
    copies = chunk_copies(tested, "problem_id", samples, "sample_idx", chunk_rows)
    none = F.struct(F.lit(NO_TEST).cast("bigint").alias("test"), F.lit(NOTHING).alias("said"))
    wanted = copies.select(
        "problem_id", "_chunk", F.size("_digests").alias("_size"), F.explode(F.concat(F.array(none), "_digests")).alias("_d")
    ).select(
        "problem_id",
        "_chunk",
        F.col("_d.test").alias("test_idx"),
        F.col("_d.said").alias("said"),
        F.when(F.col("_d.test") < 0, F.col("_size")).alias("n_tests"),
    )
    coded = with_known(
        samples.select("problem_id", "sample_idx", "output"),
        "_code",
        F.when(text.extract_code(F.col("output"), empty_is_none=True).isNotNull(), True),
    )
    own = (F.lit(NO_TEST).cast("bigint").alias("test_idx"), F.lit(NOTHING).alias("said"))
    runs = succeeded(executions).where("test_idx >= 0").unionByName(coded.select("problem_id", "sample_idx", *own))
    # A copy has a test once, so a run is joined once, where it said what was wanted.
    right = runs.withColumn("_chunk", chunk_number("sample_idx", chunk_rows)).join(
        wanted, ["problem_id", "_chunk", "test_idx", "said"]
    )
    word = F.when(F.col("test_idx") >= 0, F.expr("cast(test_idx as bigint) div 64"))
    bit = F.expr("if(test_idx >= 0, shiftleft(1L, cast(test_idx % 64 as int)), 0L)")
    words = right.groupBy("problem_id", "sample_idx", word.alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.max("n_tests").alias("n_tests")
    )
    some = F.when(F.col("word").isNotNull(), F.struct("word", "bits"))
    verdicts = words.groupBy("problem_id", "sample_idx").agg(
        F.max("n_tests").cast("bigint").alias("n_tests"),
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_passed"),
        F.array_sort(F.collect_list(some)).alias("passed"),
    )
    # Runs of samples without code count for nothing.
    return verdicts.where(F.col("n_tests").isNotNull())


def tests_of(verdicts: DataFrame) -> DataFrame:
    """A row (problem_id, sample_idx, test_idx, passed) per sample and test, read off the bits."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("n_tests") - 1)
    rows = verdicts.withColumn("test_idx", F.explode(numbers))
    masks = F.map_from_entries("passed")
    bits = F.coalesce(F.try_element_at(masks, F.expr("test_idx div 64")), F.lit(0).cast("bigint"))
    bit = F.expr("cast(test_idx % 64 as int)")
    passed = F.call_function("getbit", bits, bit) == 1
    return rows.select("problem_id", "sample_idx", "test_idx", passed.alias("passed"))


def verdict_rates(verdicts: DataFrame) -> DataFrame:
    """Share of passed tests per sample, from the counts in its row."""
    rate = F.col("n_passed").cast("double") / F.col("n_tests")
    return verdicts.select("problem_id", "sample_idx", rate.alias("pass_rate"))


def pass_rates(verified: DataFrame) -> DataFrame:
    """Share of passed tests per sample; averages are combined before the shuffle."""
    return verified.groupBy("problem_id", "sample_idx").agg(
        F.avg(F.col("passed").cast("double")).alias("pass_rate")
    )


def with_pass_rates(samples: DataFrame, rates: DataFrame) -> DataFrame:
    """All samples with their pass rate, null where nothing was run."""
    return samples.join(rates, ["problem_id", "sample_idx"], "left")


def verification_counts(samples: DataFrame) -> DataFrame:
    """One row: samples with a pass rate, and samples in all."""
    return samples.agg(
        F.count("pass_rate").alias("verified"), F.count("sample_idx").alias("samples")
    )
