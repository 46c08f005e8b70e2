import json
import math

import pytest
from pyspark.sql import functions as F

from gradeweave import fixed_values as fx
from gradeweave.operators import grouping as G
from gradeweave.operators import sweep
from gradeweave.plans import jobs
from gradeweave.sources import results, tables
from gradeweave.streaming.scores import score_arriving_rollouts


def test_required_and_optional_columns(spark, tmp_path):
    folder = str(tmp_path)
    row = {fx.OUTPUTS: ["a", "b"], fx.PASS_RATES: [1.0, 0.0], "prompt": "q", "canonical_id": "c", "x": 1}
    full = spark.createDataFrame(
        [row], f"{fx.OUTPUTS} array<string>, {fx.PASS_RATES} array<double>, prompt string, canonical_id string, x int"
    )
    for part, gone in enumerate(["x", "canonical_id", fx.OUTPUTS, fx.PASS_RATES, "prompt"]):
        tables.write_generated(full.drop(gone), folder, part)
    full.write.parquet(f"{folder}/test-000.parquet")
    read = tables.read_generated(spark, folder)
    assert read.columns == ["problem_id", "part", "n_parts", "first_sample", "canonical_id", "prompt", fx.OUTPUTS, fx.PASS_RATES]
    usable = G.valid_candidates(read).select("canonical_id").collect()
    assert sorted((r.canonical_id or "-") for r in usable) == ["-", "c"]
    assert tables.unusable_rows(read).first()[:] == (1, 1, 1)


def test_no_files_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_generated(spark, str(tmp_path))


def test_group_job(spark, tmp_path):
    rows = [(str(p), f"q{p}", [f"o{i}" for i in range(8)], [float(i % 2 or p == 0) for i in range(8)]) for p in range(5)]
    table = spark.createDataFrame(
        rows, f"canonical_id string, prompt string, {fx.OUTPUTS} array<string>, {fx.PASS_RATES} array<double>"
    )
    tables.write_generated(table, str(tmp_path))
    path, stats, unusable = jobs.group_job(spark, str(tmp_path), str(tmp_path), group_size=2)
    assert unusable.first()[:] == (0, 0, 0)
    assert path.endswith("processed_train_n2.parquet")
    assert stats.select("total_queries", "all_correct", "remaining", "total_groups").first()[:] == (5, 1, 4, 16)
    columns = ["problem_id", "group_idx", "canonical_id", "prompt", "candidates", "candidates_code", "pass_rates"]
    assert spark.read.parquet(path).columns == columns


def test_group_job_feeds_record_job(spark, tmp_path):
    rows = [(p, 0, str(p), f"q{p}", [f"o{i}" for i in range(8)], [float(i % 2) for i in range(8)]) for p in range(5)]
    table = spark.createDataFrame(
        rows,
        "problem_id bigint, part bigint, canonical_id string, prompt string, "
        f"{fx.OUTPUTS} array<string>, {fx.PASS_RATES} array<double>",
    )
    tables.write_generated(table, str(tmp_path))
    path, _, _ = jobs.group_job(spark, str(tmp_path), str(tmp_path))
    written = jobs.record_job(spark, path, str(tmp_path / "records"), by="group")
    assert spark.read.parquet(written).count() == 10


RESULTS = {
    "step_10/repeat_0/a/r.json": {"results": {"b": {"z": 1}, "x_LiveCodeBench": {"acc": 1, "_t": 5, "ok": True, "s": "1"}}},
    "step_10/repeat_0/b/r.json": {"accuracy": 9},
    "step_10/repeat_1/r.json": {"results": {"CodeForces": {"acc": 2.0, "ok": False}}},
    "step_20/repeat_0/a.json": "{broken",
    "step_20/repeat_0/b.json": {"results": {"other": {"accuracy": 1}}},
    "step_20/repeat_0/c.json": {"pass_at_1": 0.25, "n": None},
    "step_20/repeat_1/a.json": {"unknown": 1},
    "step_20/repeat_2/a.json": [1, 2],
    "step_30/repeat_0/a.json": {"results": {"BigCodeBench": {}}, "accuracy": 1},
    "step_30/repeat_1/a.json": '{"accuracy": 1} {"accuracy": 2',
    "step_30/repeat_1/skip.txt": '{"accuracy": 1}',
    "other/a.json": {"accuracy": 1},
    "old/step_10/repeat_0/a.json": {"accuracy": 5},
    "step_40/repeat_0/a.json": '{"accuracy": 1} {"b": 2}',
    "step_40/repeat_0/b.json": '{"accuracy": 1}, {"b": 2}',
    "step_40/repeat_1/a.json": '{"accuracy": 3, "accuracy": 2}',
}


def test_sweep_from_files(spark, tmp_path):
    for name, body in RESULTS.items():
        file = tmp_path / "in" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(body if isinstance(body, str) else json.dumps(body, indent=1) + "\n")
    summary = jobs.sweep_job(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {(r.step, r.metric): (r.mean, r.stderr, r.n) for r in summary.collect()}
    assert got == {
        (10, "acc"): (1.5, pytest.approx(0.5 / math.sqrt(2)), 2),
        (10, "ok"): (0.5, pytest.approx(0.5 / math.sqrt(2)), 2),
        (20, "pass_at_1"): (0.25, 0.0, 1),
        (40, "accuracy"): (2.0, 0.0, 1),
    }
    nested = spark.read.json(str(tmp_path / "out" / "sweep_results_by_step.json")).collect()
    by_step = {r.step: {k: v.asDict() for k, v in r.metrics.asDict().items() if v} for r in nested}
    assert by_step[20] == {"pass_at_1": {"mean": 0.25, "stderr": 0.0, "n": 1}}
    runs = sweep.run_documents(results.read_result_files(spark, str(tmp_path / "in")))
    found = sweep.metric_values(runs).select("step", "repeat_idx").distinct()
    missing = sweep.missing_runs(found, repeats=2, steps=[10, 20, 30])
    assert sorted(map(tuple, missing.collect())) == [(20, 1), (30, 0), (30, 1)]
    by_freq = sweep.missing_runs(found, repeats=1, save_freq=4)
    assert sorted(r.step for r in by_freq.collect()) == [4, 8, 12, 16, 24, 28, 32, 36, 40]
    assert sweep.missing_runs(found, repeats=0, steps=[10]).count() == 0


def test_files_of_any_name(spark, tmp_path):
    """Names that begin with `_` are read, dotted ones if asked for; deeper sweeps and other folders are not."""
    files = {
        "step_10/repeat_0/_late.json": b'{"accuracy": 1}',
        "step_10/repeat_0/_kept/_more/a.json": b'{"accuracy": 2}',
        "step_10/repeat_0/.draft.json": b'{"accuracy": 3}',
        "step_10/repeat_0/.cache/b.json": b'{"accuracy": 4}',
        "step=10/repeat=1/c d%20\u00e9.json": b"\xff{}",
        "step_10/repeat_x/d.json": b"{}",
        "step_10/e.json": b"{}",
        "step_7/repeat_2/f.txt": b"{}",
        "sub/step_10/repeat_5/g.json": b"{}",
    }
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    read = lambda **o: {(r.step, r.repeat_idx, r.path.rsplit("/", 1)[1]): r.value for r in results.read_result_files(spark, **o).collect()}
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        assert read(root=root) == {
            (10, 0, "_late.json"): '{"accuracy": 1}',
            (10, 0, "a.json"): '{"accuracy": 2}',
            (10, 1, "c d%20\u00e9.json"): None,
        }
        assert {k[2] for k in read(root=root, dotted=True)} >= {".draft.json", "b.json"}
        assert set(read(root=root, names="*.txt")) == {(7, 2, "f.txt")}
    assert read(root=str(tmp_path / "sub")) == {(10, 5, "g.json"): "{}"}
    assert read(root=str(tmp_path / "nowhere")) == {}


def test_shards_are_replaced_whole(spark, tmp_path):
    """A shard written again replaces itself alone; a write that fails leaves what was there."""
    folder = str(tmp_path)
    rows = lambda a, b: spark.range(a, b, 1, 3).selectExpr("id AS problem_id", "'q' AS prompt")
    ids = lambda: sorted(r.problem_id for r in tables.read_generated(spark, folder).collect())
    tables.write_generated(rows(0, 4), folder, 0)
    tables.write_generated(rows(10, 13), folder, 1)
    tables.write_generated(rows(20, 25), folder, 1)
    assert ids() == [0, 1, 2, 3, 20, 21, 22, 23, 24]
    broken = rows(0, 9).withColumn("prompt", F.when(F.col("problem_id") == 8, F.raise_error(F.lit("stop"))).otherwise("q"))
    with pytest.raises(Exception, match="stop"):
        tables.write_generated(broken, folder, 0)
    assert ids() == [0, 1, 2, 3, 20, 21, 22, 23, 24]
    tables.write_generated(rows(0, 0), folder, 1)
    assert ids() == [0, 1, 2, 3]
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.startswith("_")) == ["train-000.parquet", "train-001.parquet"]


def test_every_job_runs_again(spark, tmp_path):
    rows = [(p, 0, str(p), f"q{p}", [f"o{i}" for i in range(8)], [float(i % 2) for i in range(8)]) for p in range(5)]
    schema = f"problem_id bigint, part bigint, canonical_id string, prompt string, {fx.OUTPUTS} array<string>, {fx.PASS_RATES} array<double>"
    for last in (3, 5):
        tables.write_generated(spark.createDataFrame(rows[:last], schema), str(tmp_path))
        path, _, _ = jobs.group_job(spark, str(tmp_path), str(tmp_path))
        assert spark.read.parquet(jobs.record_job(spark, path, str(tmp_path))).count() == 2 * last
        summary = spark.createDataFrame([(last, "m", 1.0, 0.0, 1)], results.SUMMARY)
        results.write_summary(summary, str(tmp_path))
        assert [r.step for r in results.read_summary(spark, str(tmp_path)).collect()] == [last]


def test_missing_columns_of_each_file(spark, tmp_path):
    row = {fx.OUTPUTS: ["a"], fx.PASS_RATES: [1.0], "prompt": None, "x": 1}
    full = spark.createDataFrame([row] * 3, f"{fx.OUTPUTS} array<string>, {fx.PASS_RATES} array<double>, prompt string, x int").coalesce(1)
    tables.write_generated(full, str(tmp_path), 0)  # nulls are not a missing column
    tables.write_generated(full.drop("prompt", fx.OUTPUTS), str(tmp_path), 1)
    full.drop("prompt").write.parquet(str(tmp_path / "other-000.parquet"))
    got = tables.missing_columns(spark, str(tmp_path)).collect()
    assert sorted((r.file.split("/")[-2], r.column, r.rows) for r in got) == [
        ("train-001.parquet", "prompt", 3),
        ("train-001.parquet", fx.OUTPUTS, 3),
    ]


def test_scores_of_a_stream(spark, tmp_path):
    schema = "id long, response string, ground_truth string"
    rows = [(0, "2, 1", "[0.0, 1.0]"), (1, "?", "[0.0, 1.0]")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    query = score_arriving_rollouts(
        spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check")
    )
    query.awaitTermination(120)
    scores = {r.id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert scores == {0: 1.0, 1: -1.0}


def test_shown_summary(spark):
    """The first step decides what is shown: its preferred metrics, in their order."""
    rows = [(20, "pass_at_1", 1.0), (10, "z", 1.0), (10, "pass_at_1", 2.0), (10, "accuracy", 3.0), (20, "z", 1.0)]
    shown = sweep.shown_summary(spark.createDataFrame(rows, "step int, metric string, mean double"))
    assert [tuple(r) for r in shown.select("step", "metric", "place").collect()] == [
        (10, "accuracy", 0),
        (10, "pass_at_1", 1),
        (20, "pass_at_1", 1),
    ]
