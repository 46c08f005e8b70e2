"""The stages as jobs: each reads tables, returns or writes tables, and stays lazy between."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions import text
from ..operators import completions as C
from ..operators import grouping as G
from ..operators import problems as P
from ..operators import records as R
from ..operators import sweep as S
from ..operators import verification as V
from ..sources import results, tables


def verified_rates(
    asked: DataFrame,
    completions: DataFrame,
    executions: DataFrame,
    max_tests: int | None = None,
) -> DataFrame:
    """(problem_id, sample_idx, pass_rate) of the samples with code of problems with tests.

    asked: problems with `over_budget` and `test_suites` (see `problems.with_prompts`);
    completions and executions come from outside.
    """
    within = asked.where(~F.col("over_budget")).select("problem_id", "test_suites")
    stripped = completions.withColumn("output", text.strip(F.col("output")))
    return V.verdict_rates(V.sample_verdicts(stripped, within, executions, max_tests))


def generate_job(
    problems: DataFrame,
    completions: DataFrame,
    executions: DataFrame | None,
    folder: str,
    model: str,
    max_tokens: int = fx.MAX_TOKENS,
    max_tests: int | None = None,
    part: int = 0,
) -> str:
    """Write shard `train-NNN.parquet` from raw problems and what came back for their prompts.

    Batches of problems are shards of their own, by `part`; writing one again replaces it.
    problems: (problem_id, canonical_id, statement, starter_code, problem_type, test_suites).
    Without `executions` nothing is verified, and all pass rates are null.
    """

    def prompted(rows):
        return P.with_prompts(rows, model, max_tokens)

    rates = None
    if executions is not None:
        rates = verified_rates(prompted(problems), completions, executions, max_tests)
    # Prompts hold the problem's text again: they are made where its samples are, not shuffled.
    return tables.write_generated(C.generated_table(problems, completions, rates, prepare=prompted), folder, part)


def group_job(
    spark: SparkSession,
    folder: str,
    target: str,
    group_size: int = fx.GROUP_SIZE,
    max_pass_ratio: float = fx.MAX_PASS_RATIO,
) -> tuple[str, DataFrame, DataFrame]:
    """Read `train-*.parquet`, write the groups; returns their path, the statistics, and one
    row that tells how many of the rows read lack a column that grouping needs."""
    generated = tables.read_generated(spark, folder)
    groups, outcomes = G.candidate_groups_of_parts(generated, group_size, max_pass_ratio)
    path = tables.write_groups(
        groups.select("problem_id", "group_idx", "canonical_id", "prompt", "candidates", "candidates_code", "pass_rates"),
        target,
        group_size,
    )
    stats = G.grouping_stats(outcomes, tables.read_table(spark, path))
    return path, stats, tables.unusable_rows(generated)


def record_job(
    spark: SparkSession,
    path: str,
    target: str,
    val_ratio: float = fx.VAL_RATIO,
    seed: int = fx.SPLIT_SEED,
    by: str = "group",
) -> str:
    """Read the groups that `group_job` wrote, write their records by split side."""
    groups = tables.read_table(spark, path)
    # The split is a comparison on the stored keys; done first, it runs on the scan alone.
    labelled = R.train_val_split(R.read_groups_columns(groups), val_ratio, seed, by)
    # Rows are stored in an order of their own, or a problem's would be one task's.
    labelled = labelled.withColumn("shuffle_key", R.shuffle_key(("problem_id", "group_idx"), seed))
    needed = ("problem_id", "group_idx", "prompt", "candidates_code", "pass_rates", "split", "shuffle_key")
    records = R.training_records(R.dealt_with_index(labelled.select(*needed)), "shuffle_key", "split")
    return tables.write_split(records, target)


def sweep_job(
    spark: SparkSession, root: str, target: str, names: str = "*.json"
) -> DataFrame:
    """Summarise the result files below `root`; writes the summary and returns it as written."""
    runs = S.run_documents(results.read_result_files(spark, root, names))
    results.write_summary(S.sweep_summary(S.metric_values(runs)), target)
    return results.read_summary(spark, target)
