"""Registered queries: (spark, sf_dir) -> DataFrame, named as in the operator inventory."""

from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions import ranking, text
from ..operators import completions as C
from ..operators import grouping as G
from ..operators import problems as P
from ..operators import records as R
from ..operators import reward_files, scoring, sweep
from ..operators import verification as V
from ..operators.rows import each, with_known
from ..session import scratch_path
from ..sources import results, tables
from . import derived, jobs

SMALL_CONTEXT = 2000  # tokens, so that documents lie on both sides of the budget
SMALL_QUESTION = 260  # tokens, so that prompts of problems lie on both sides of its share
SMALL_PROMPT = 400  # tokens, so that records lie on both sides of the limit


def rounded(name):
    return F.round(name, 9).alias(name)


# --- sources


def scan_required_columns(spark, sf):
    """Whole files, files short of a column and files of other names, read in one scan."""
    folder = scratch_path(spark, "scan")
    made = derived.generated(spark, sf)
    third = F.col("problem_id") % 3
    tables.write_generated(made.where(third == 0), folder, 0)
    tables.write_generated(made.where(third == 1).drop("canonical_id", fx.OUTPUTS), folder, 1)
    tables.write_generated(
        made.where((third == 2) & (F.col("problem_id") % 2 == 0)).drop("canonical_id"), folder, 2
    )
    tables.write_generated(
        made.where((third == 2) & (F.col("problem_id") % 2 == 1)).drop("prompt"), folder, 3
    )
    made.write.parquet(f"{folder}/other-000.parquet")
    return G.valid_candidates(tables.read_generated(spark, folder)).select(
        "canonical_id", "prompt", F.size("valid").alias("n_valid")
    )


def json_array_column(spark, sf):
    """Groups stored with candidates as JSON text and rates as an array, and read alike."""
    groups = G.candidate_groups_nested(derived.generated(spark, sf), "problem_id")
    stored = groups.select(
        "problem_id",
        "group_idx",
        F.to_json("candidates_code").alias("candidates_code"),
        "pass_rates",
    )
    read = R.read_groups_columns(stored)
    pairs = F.arrays_zip("candidates_code", "pass_rates")
    return each(read, ["problem_id", "group_idx"], pairs, "place", "pair").select(
        "problem_id",
        "group_idx",
        "place",
        F.col("pair.candidates_code").alias("code"),
        F.col("pair.pass_rates").alias("pass_rate"),
    )


def columns_by_file(spark, sf):
    """Which shards lack which columns, by the footers of their files, and how many rows they hold."""
    folder = scratch_path(spark, "columns")
    made = derived.generated(spark, sf)
    third = F.col("problem_id") % 3
    tables.write_generated(made.where(third == 0).drop("canonical_id"), folder, 0)
    tables.write_generated(made.where(third == 1).drop(fx.OUTPUTS), folder, 1)
    tables.write_generated(made.where(third == 2).drop("prompt", fx.PASS_RATES), folder, 2)
    made.write.parquet(f"{folder}/other-000.parquet")
    shard = F.regexp_extract("file", r"/(train-\d+)\.parquet/", 1).alias("shard")
    missing = tables.missing_columns(spark, folder)
    return missing.groupBy(shard, "column").agg(F.sum("rows").alias("n_rows"))


def written_results(spark, sf):
    """Write the derived result documents, one file each, below step and repeat folders.

    Every second run's files have names that begin with `_`; every run has a draft as well,
    whose name begins with a dot.
    """
    folder = scratch_path(spark, "results")
    documents = derived.result_documents(spark, sf)
    # Small files, so the time goes into making them: share them among all cores.
    shared = documents.repartition(spark.sparkContext.defaultParallelism, "step", "repeat_idx", "file_idx")
    shared.mapInArrow(derived.result_file_batches(folder), "n int").write.format("noop").mode("overwrite").save()
    return folder


def result_json_scan(spark, sf):
    files = results.read_result_files(spark, written_results(spark, sf))
    return sweep.run_documents(files).select(
        "step", "repeat_idx", F.length("metrics").cast("bigint").alias("n_chars")
    )


def extract_metrics(spark, sf):
    files = results.read_result_files(spark, written_results(spark, sf))
    return sweep.metric_values(sweep.run_documents(files)).select(
        "step", "repeat_idx", "metric", rounded("value")
    )


# --- problems and text


def normalize_problem_type(spark, sf):
    return P.normalize_problem_type(derived.problems(spark, sf)).select(
        "problem_id", "problem_type"
    )


def entry_function_name(spark, sf):
    from ..functions.starter import entry_function_name as name

    return derived.problems(spark, sf).select(
        "problem_id", name(F.col("starter_code")).alias("function_name")
    )


def assemble_question(spark, sf):
    return derived.problems(spark, sf).select(
        "problem_id", text.question(F.col("statement"), F.col("starter_code")).alias("question")
    )


def generation_prompt(spark, sf):
    """Problems of odd customers go to a thinking model."""
    model = F.when(F.col("o_custkey") % 2 == 1, "m-Thinking-1").otherwise("m-instruct-1")
    typed = P.normalize_problem_type(derived.problems(spark, sf))
    asked = text.question(F.col("statement"), F.col("starter_code"))
    return typed.select(
        "problem_id",
        text.generation_prompt(asked, F.col("starter_code"), F.col("problem_type"), model).alias(
            "prompt"
        ),
    )


def prepared_problems(spark, sf):
    """Type, question, prompt, estimate, budget flag and model in one pass."""
    prepared = P.with_prompts(derived.problems(spark, sf), "m-instruct-1", SMALL_QUESTION)
    return prepared.select(
        "problem_id", "problem_type", "prompt", "token_estimate", "over_budget", "generated_with"
    )


def prompt_budget(spark, sf):
    documents = derived.load(spark, sf, "documents")
    over = text.over_budget(F.col("text"), SMALL_CONTEXT)
    sentences = F.when(over, F.array()).otherwise(F.split("text", "[.]"))
    return documents.select(
        "doc_id",
        text.token_estimate(F.col("text")).alias("token_estimate"),
        over.alias("over_budget"),
        F.size(sentences).cast("bigint").alias("n_outputs"),
    )


def extract_code_strict(spark, sf):
    return derived.fenced_documents(spark, sf).select(
        "problem_id", text.extract_code(F.col("completion")).alias("code")
    )


def extract_code_lenient(spark, sf):
    return derived.fenced_documents(spark, sf).select(
        "problem_id", text.extract_code_or_text(F.col("completion")).alias("code")
    )


def flatten_test_cases(spark, sf):
    return P.flatten_test_cases(derived.tested_problems(spark, sf))


def capped_test_cases(spark, sf):
    """Flattened tests with the runner's usual cap per problem, which is only kept on request."""
    return P.flatten_test_cases(derived.tested_problems(spark, sf), max_tests=fx.MAX_TESTS)


def limit_problems(spark, sf):
    return P.first_problems(derived.problems(spark, sf), 100).select("problem_id", "starter_code")


# --- completions and verification


def attach_completions(spark, sf):
    problems = derived.tested_problems(spark, sf)
    joined = C.attach_completions(problems, derived.completions(spark, sf))
    number = F.coalesce("sample_idx", F.lit(-1)).alias("sample_idx")
    return joined.select("problem_id", number, "output", "finish_reason", "over_budget")


def execution_worklist(spark, sf):
    return V.execution_worklist(
        derived.completions(spark, sf), derived.tested_problems(spark, sf)
    )


def execution_programs(spark, sf):
    """The work list as programs: function problems with the call and the input built in."""
    programs = V.with_programs(execution_worklist(spark, sf))
    return programs.select(*V.RUN, F.md5("program").alias("program_md5"), "stdin")


def verify_join(spark, sf):
    return V.verify(derived.worklist(spark, sf), derived.executions(spark, sf))


def _line_rates(spark, sf):
    return V.pass_rates(verify_join(spark, sf))


def pass_rate(spark, sf):
    rated = V.with_pass_rates(derived.run_samples(spark, sf), _line_rates(spark, sf))
    return rated.select("problem_id", "sample_idx", rounded("pass_rate"))


def verification_counts(spark, sf):
    return V.verification_counts(
        V.with_pass_rates(derived.run_samples(spark, sf), _line_rates(spark, sf))
    )


def verified_tests(spark, sf):
    """Every test of every sample with code, read off the bits of the sample's verdict."""
    verdicts = V.sample_verdicts(
        derived.completions(spark, sf), derived.tested_problems(spark, sf), derived.stage_runs(spark, sf)
    )
    return V.tests_of(verdicts)


def generate_and_verify(spark, sf):
    """The first stage end to end, with results derived from the work list itself."""
    problems = derived.tested_problems(spark, sf)
    completions = derived.completions(spark, sf)
    work = execution_worklist(spark, sf)
    turn = (F.col("problem_id") + F.col("sample_idx") + F.col("test_idx")) % 7
    ran = work.where(turn != 6).select(
        *V.RUN,
        F.when(turn == 5, 500).otherwise(200).alias("status"),
        F.when(turn < 3, F.concat(F.lit(" "), "expected_output", F.lit("\n")))
        .otherwise("?")
        .alias("stdout"),
        F.lit(0).alias("exit_code"),
        (turn == 0).alias("timed_out"),
    )
    nested = C.generated_table(problems, completions, jobs.verified_rates(problems, completions, ran))
    return nested.select(
        "problem_id",
        F.size(fx.OUTPUTS).cast("bigint").alias("n_outputs"),
        F.size(F.filter(fx.PASS_RATES, lambda r: r.isNotNull())).cast("bigint").alias("n_rated"),
        F.round(
            F.aggregate(
                fx.PASS_RATES, F.lit(0.0), lambda total, r: total + F.coalesce(r, F.lit(0.0))
            ),
            9,
        ).alias("sum_rates"),
    )


# --- groups


def _long_samples(spark, sf):
    return C.unnest_samples(derived.generated(spark, sf), "problem_id")


def _group_rows(groups):
    """A row per candidate, with its place in the group."""
    members = F.arrays_zip("candidates", "candidates_code", "pass_rates")
    return each(groups, ["problem_id", "group_idx"], members, "place", "member").select(
        "problem_id",
        "group_idx",
        "place",
        F.col("member.candidates").alias("candidate"),
        F.col("member.candidates_code").alias("code"),
        F.col("member.pass_rates").alias("pass_rate"),
    )


def valid_candidates(spark, sf):
    nested = G.valid_candidates(derived.generated(spark, sf))
    return each(nested, ["problem_id"], F.col("valid"), "place", "sample").select(
        "problem_id",
        "place",
        F.col("sample.output").alias("output"),
        F.col("sample.pass_rate").alias("pass_rate"),
    )


def candidate_groups(spark, sf):
    return _group_rows(G.candidate_groups(_long_samples(spark, sf)))


def candidate_groups_nested(spark, sf):
    return _group_rows(G.candidate_groups_nested(derived.generated(spark, sf), "problem_id"))


def candidate_groups_with_problems(spark, sf):
    """Groups of the long form with their problem's columns joined to them."""
    generated = derived.generated(spark, sf)
    samples = _long_samples(spark, sf)
    problems = generated.select("problem_id", "canonical_id", "prompt")
    return G.with_problems(G.candidate_groups(samples), problems, samples).select(
        "problem_id",
        "group_idx",
        "canonical_id",
        "prompt",
        text.json_array(F.col("pass_rates")).alias("ground_truth"),
    )


def max_pass_ratio(spark, sf):
    return _group_rows(G.candidate_groups(_long_samples(spark, sf), max_pass_ratio=0.35))


def grouping_stats(spark, sf):
    generated = derived.generated(spark, sf)
    stats = G.grouping_stats(G.nested_outcomes(generated, max_pass_ratio=0.35))
    shares = ("all_correct_pct", "all_wrong_pct", "remaining_pct", "groups_per_query")
    return stats.withColumns({name: F.round(name, 9) for name in shares})


# --- records


def _groups(spark, sf):
    return G.candidate_groups_nested(
        derived.generated(spark, sf), "problem_id", "canonical_id", "prompt"
    )


def _stored_groups(spark, sf):
    """The groups as the grouping stage leaves them: a written table."""
    folder = scratch_path(spark, "stored-groups")
    return tables.read_table(spark, tables.write_groups(_groups(spark, sf), folder))


def candidate_block(spark, sf):
    return _groups(spark, sf).select(
        "problem_id", "group_idx", text.candidate_block(F.col("candidates_code")).alias("block")
    )


def ranking_prompt(spark, sf):
    return _groups(spark, sf).select(
        "problem_id",
        "group_idx",
        text.ranking_prompt(F.col("prompt"), F.col("candidates_code")).alias("content"),
    )


def record_index(spark, sf):
    return R.record_index(_stored_groups(spark, sf).select("problem_id", "group_idx"))


def training_record(spark, sf):
    records = R.training_records(R.record_index(_stored_groups(spark, sf)), "problem_id", "group_idx")
    turn = F.col("prompt")[0]
    return records.select(
        "problem_id",
        "group_idx",
        "data_source",
        "ability",
        turn["role"].alias("role"),
        turn["content"].alias("content"),
        F.col("reward_model.style").alias("style"),
        F.col("reward_model.ground_truth").alias("ground_truth"),
        F.col("extra_info.index").alias("index"),
        F.col("extra_info.n_candidates").alias("n_candidates"),
    )


def overlong_filter(spark, sf):
    counted = with_known(
        ranking_prompt(spark, sf), "tokens", text.token_estimate(F.col("content"))
    )
    return R.within_prompt_limit(counted, F.col("tokens"), SMALL_PROMPT).select(
        "problem_id", "group_idx", "tokens"
    )


def length_check(spark, sf):
    """Rows of the nested table whose outputs and rates differ in number."""
    rows = derived.generated(spark, sf).select(
        "problem_id",
        F.col(fx.OUTPUTS).alias("candidates_code"),
        F.col(fx.PASS_RATES).alias("pass_rates"),
    )
    return R.length_violations(rows).agg(F.count("*").alias("violations"))


def train_val_split(spark, sf):
    return R.train_val_split(_stored_groups(spark, sf).select("problem_id", "group_idx"))


def train_val_split_by_problem(spark, sf):
    return R.train_val_split(_stored_groups(spark, sf).select("problem_id", "group_idx"), by="problem")


def split_counts(spark, sf):
    return R.split_counts(train_val_split(spark, sf))


def group_and_split(spark, sf):
    """The second stage end to end: write groups, write records, read those back."""
    folder = scratch_path(spark, "records")
    tables.write_generated(derived.generated(spark, sf), folder)
    path, _, _ = jobs.group_job(spark, folder, folder)
    path = jobs.record_job(spark, path, folder)
    return tables.read_table(spark, path).select(
        F.col("extra_info.index").alias("index"),
        "split",
        F.col("reward_model.ground_truth").alias("ground_truth"),
        F.length(F.col("prompt")[0]["content"]).cast("bigint").alias("n_chars"),
    )


def grouped_table(spark, sf):
    """Write the nested table, run the grouping job on it, and read its statistics."""
    folder = scratch_path(spark, "groups")
    tables.write_generated(derived.generated(spark, sf), folder)
    _, stats, _ = jobs.group_job(spark, folder, folder)
    return stats.select("total_queries", "all_correct", "all_wrong", "remaining", "total_groups")


def problems_to_records(spark, sf):
    """The three jobs in a row: raw problems to nested samples, groups of two, and records."""
    folder = scratch_path(spark, "stages")
    problems = derived.raw_problems(spark, sf)
    completions = derived.completions(spark, sf)
    jobs.generate_job(
        problems, completions, derived.stage_runs(spark, sf), folder, "m-instruct-1", SMALL_CONTEXT
    )
    path, _, _ = jobs.group_job(spark, folder, folder, group_size=2)
    records = tables.read_table(spark, jobs.record_job(spark, path, folder, val_ratio=0.3))
    rates = F.from_json("reward_model.ground_truth", "array<double>")
    return records.select(
        F.col("extra_info.index").alias("index"),
        "split",
        F.col("extra_info.n_candidates").alias("n_candidates"),
        F.round(F.aggregate(rates, F.lit(0.0), lambda total, r: total + r), 9).alias("sum_rates"),
    )


def generate_in_shards(spark, sf):
    """Two shards by themselves, one of them again after a run that stopped short, read together."""
    folder = scratch_path(spark, "shards")
    problems, completions = derived.raw_problems(spark, sf), derived.completions(spark, sf)
    odd = F.col("problem_id") % 2 == 1
    batches = ((0, ~odd), (1, odd & (F.col("problem_id") % 3 == 0)), (1, odd))
    for part, batch in batches:
        jobs.generate_job(problems.where(batch), completions, None, folder, "m-instruct-1", SMALL_CONTEXT, part=part)
    return tables.read_generated(spark, folder).select(
        "problem_id", "canonical_id", F.size(fx.OUTPUTS).cast("bigint").alias("n_outputs")
    )


def generate_unverified(spark, sf):
    """The first job without a runner: every sample is kept, no pass rate is known."""
    folder = scratch_path(spark, "unverified")
    problems = derived.raw_problems(spark, sf)
    completions = derived.completions(spark, sf)
    jobs.generate_job(problems, completions, None, folder, "m-instruct-1", SMALL_CONTEXT)
    known = F.filter(fx.PASS_RATES, lambda r: r.isNotNull())
    return tables.read_generated(spark, folder).select(
        "problem_id",
        "canonical_id",
        "n_parts",
        F.size(fx.OUTPUTS).cast("bigint").alias("n_outputs"),
        F.size(known).cast("bigint").alias("n_rated"),
    )


# --- scores


def parse_ranking(spark, sf):
    rollouts = derived.rollouts(spark, sf)
    ranked = ranking.parse_ranking(F.col("response"), F.col("n"))
    return rollouts.select(
        "problem_id", "rollout_idx", F.array_join(ranked.cast("array<string>"), " ").alias("ranking")
    )


def _ranked(spark, sf):
    rollouts = derived.rollouts(spark, sf)
    ranked = ranking.parse_ranking(F.col("response"), F.size("pass_rates"))
    return rollouts.withColumn("ranking", ranked)


def _metric(spark, sf, name, column):
    ranked = ranking.parse_ranking(F.col("response"), F.size("pass_rates"))
    known = with_known(derived.rollouts(spark, sf), "ranking", ranked)
    return known.select("problem_id", "rollout_idx", F.round(column, 9).alias(name))


def ndcg(spark, sf):
    return _metric(spark, sf, "ndcg", ranking.ndcg(F.col("ranking"), F.col("pass_rates")))


def ndcg_at_2(spark, sf):
    return _metric(spark, sf, "ndcg", ranking.ndcg(F.col("ranking"), F.col("pass_rates"), 2))


def pairacc(spark, sf):
    return _metric(spark, sf, "pairacc", ranking.pairacc(F.col("ranking"), F.col("pass_rates")))


def top1_acc(spark, sf):
    return _metric(spark, sf, "top1_acc", ranking.top1_acc(F.col("ranking"), F.col("pass_rates")))


def _scored(spark, sf):
    return scoring.score_rollouts(derived.rollouts(spark, sf))


def reward(spark, sf):
    return _scored(spark, sf).select(
        "problem_id", "rollout_idx", *[rounded(name) for name in ranking.SCORES]
    )


def reward_by_ndcg(spark, sf):
    """The same scoring with another reward plugged in."""
    scored = scoring.score_rollouts(
        derived.rollouts(spark, sf), lambda said, truth: ranking.reward(said, truth, mode="ndcg")
    )
    return scored.select("problem_id", "rollout_idx", rounded("score"))


def reward_from_file(spark, sf):
    """Scoring by a function that the user keeps in a file and that fails on some responses."""
    path = scratch_path(spark, "reward")
    spark.createDataFrame([(derived.REWARD_FILE,)], "value string").coalesce(1).write.text(path)
    rollouts = derived.rollouts(spark, sf).withColumn("extra_info", F.struct("step", "rollout_idx"))
    scored = reward_files.score_with_file(rollouts, path, "first_choice", ("score", "step", "known"))
    return scored.select(
        "problem_id", "rollout_idx", rounded("score"), "step", rounded("known"), "reward_error"
    )


def reward_summary(spark, sf):
    summary = scoring.reward_summary(_scored(spark, sf), "step")
    means = [rounded(c) for c in summary.columns if c not in ("step", "n")]
    return summary.select("step", "n", *means)


def group_advantage(spark, sf):
    scored = _scored(spark, sf).select("problem_id", "rollout_idx", "score")
    return scoring.group_advantage(scored, "problem_id", "rollout_idx").select(
        "problem_id", "rollout_idx", rounded("advantage")
    )


def selection_report(spark, sf):
    by = ("step", "generator", "ranker", "difficulty")
    ranked = _ranked(spark, sf).withColumn(
        "ranker", F.when(F.col("rollout_idx") % 2 == 0, "base").otherwise("ckpt")
    )
    report = scoring.selection_report(ranked, *by)
    return report.select(
        *by, "n", rounded("selected_pass"), rounded("pass_at_1"), rounded("upper_bound")
    )


# --- sweeps


def sweep_summary(spark, sf):
    summary = sweep.sweep_summary(derived.metrics(spark, sf))
    return summary.select("step", "metric", rounded("mean"), rounded("stderr"), "n")


def summary_order(spark, sf):
    shown = sweep.shown_summary(sweep.sweep_summary(derived.metrics(spark, sf)))
    return shown.select("step", "place", "metric", rounded("mean"), rounded("stderr"), "n")


def missing_runs(spark, sf):
    found = derived.metrics(spark, sf).select("step", "repeat_idx").distinct()
    return sweep.missing_runs(found, repeats=12, save_freq=5)


def sweep_report(spark, sf):
    """The third stage end to end: result files in, summary files out, read back nested."""
    root = written_results(spark, sf)
    target = scratch_path(spark, "sweep")
    jobs.sweep_job(spark, root, target)
    entry = "map<string,struct<mean:double,stderr:double,n:bigint>>"
    nested = spark.read.schema(f"step int, metrics {entry}").json(
        f"{target}/sweep_results_by_step.json"
    )
    return nested.select("step", F.explode("metrics").alias("metric", "entry")).select(
        "step",
        "metric",
        F.round("entry.mean", 9).alias("mean"),
        F.round("entry.stderr", 9).alias("stderr"),
        F.col("entry.n").alias("n"),
    )


ALL = (
    candidate_groups,
    candidate_groups_nested,
    candidate_groups_with_problems,
    valid_candidates,
    max_pass_ratio,
    grouping_stats,
    grouped_table,
    verify_join,
    pass_rate,
    verification_counts,
    verified_tests,
    flatten_test_cases,
    execution_worklist,
    execution_programs,
    attach_completions,
    generate_and_verify,
    parse_ranking,
    ndcg,
    ndcg_at_2,
    pairacc,
    top1_acc,
    reward,
    reward_by_ndcg,
    reward_from_file,
    reward_summary,
    group_advantage,
    selection_report,
    normalize_problem_type,
    entry_function_name,
    assemble_question,
    generation_prompt,
    prepared_problems,
    prompt_budget,
    extract_code_strict,
    extract_code_lenient,
    capped_test_cases,
    limit_problems,
    candidate_block,
    ranking_prompt,
    record_index,
    training_record,
    overlong_filter,
    length_check,
    train_val_split,
    train_val_split_by_problem,
    split_counts,
    group_and_split,
    problems_to_records,
    generate_unverified,
    generate_in_shards,
    columns_by_file,
    scan_required_columns,
    json_array_column,
    result_json_scan,
    extract_metrics,
    sweep_summary,
    summary_order,
    sweep_report,
    missing_runs,
)


def registry():
    return {query.__name__: query for query in ALL}
