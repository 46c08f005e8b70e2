"""Rewards of a user's file, called with all four arguments in the tasks."""

import pytest
from pyspark.sql import functions as F

from gradeweave.operators import reward_files
from gradeweave.streaming.scores import score_arriving_rollouts

FILE = '''
import dataclasses
import json

LOADS = 0


@dataclasses.dataclass
class Weight:
    each: float = 0.5


def reward_func(data_source, solution_str, ground_truth, extra_info=None):
    truth = json.loads(ground_truth)
    if solution_str is None:
        return None
    if solution_str == "text":
        return {"score": "no number"}
    return {"score": Weight().each * len(truth), "kind": data_source == "code_ranking", "index": (extra_info or {}).get("index"), "more": 7}


plain = lambda data_source, solution_str, ground_truth, extra_info: len(solution_str)
'''
ROWS = [(1, "a", "[1, 2]"), (2, "text", "[1]"), (3, "b", "{broken"), (4, None, "[]"), (5, "cc", "[]")]


@pytest.fixture
def rollouts(spark):
    return spark.createDataFrame(ROWS, "id long, response string, ground_truth string").repartition(2)


def written(tmp_path, text=FILE):
    path = tmp_path / "reward.py"
    path.write_text(text)
    return str(path)


def test_fields_and_errors_of_each_row(rollouts, tmp_path):
    path = written(tmp_path)
    given = rollouts.withColumn("extra_info", F.struct(F.col("id").alias("index"))).withColumn("data_source", F.lit("x"))
    got = {r.id: r for r in reward_files.score_with_file(given, path, fields=("score", "kind", "index")).collect()}
    assert (got[1].score, got[1].kind, got[1]['index'], got[1].reward_error) == (1.0, 0.0, 1.0, None)
    assert (got[5].score, got[5]['index']) == (0.0, 5.0)
    assert got[2].score is None and got[2].reward_error.startswith("ValueError")
    assert got[3].score is None and got[3].reward_error.startswith("JSONDecodeError")
    assert got[4].score is None and got[4].reward_error is None
    assert given.columns + ["score", "kind", "reward_error"] == [
        c for c in reward_files.score_with_file(given, path, fields=("score", "kind")).columns
    ]


def test_defaults_and_plain_numbers(rollouts, tmp_path):
    path = written(tmp_path)
    got = {r.id: r for r in reward_files.score_with_file(rollouts, path, fields=("score", "kind", "index")).collect()}
    assert (got[1].kind, got[1]['index']) == (1.0, None)
    got = {r.id: r for r in reward_files.score_with_file(rollouts, path, "plain").collect()}
    assert got[5].score == 2.0 and got[5].ndcg is None and got[4].reward_error.startswith("TypeError")


def test_unusable_files(spark, rollouts, tmp_path):
    with pytest.raises(ValueError, match="no function other"):
        reward_files.score_with_file(rollouts, written(tmp_path), "other")
    with pytest.raises(SyntaxError):
        reward_files.score_with_file(rollouts, written(tmp_path, "def reward_func("))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        reward_files.score_with_file(rollouts, str(tmp_path / "none.py"))
    # What fails as it is loaded fails the job, not row by row.
    with pytest.raises(Exception, match="not today"):
        reward_files.score_with_file(rollouts, written(tmp_path, "raise OSError('not today')\ndef reward_func(): ...")).collect()


def test_empty_table(rollouts, tmp_path):
    assert reward_files.score_with_file(rollouts.limit(0), written(tmp_path)).collect() == []


def test_rewards_of_a_stream(spark, rollouts, tmp_path):
    """The same UDF scores a stream."""
    path = written(tmp_path)
    rollouts.write.parquet(str(tmp_path / "in"))
    run = reward_files.reward_udf(reward_files.reward_text(spark, path), "reward_func", ("score", "kind"))
    reward = lambda said, truth: run(F.lit("code_ranking"), said, truth, F.lit(None).cast("string"))
    query = score_arriving_rollouts(
        spark, str(tmp_path / "in"), rollouts.schema, str(tmp_path / "out"), str(tmp_path / "check"), reward
    )
    query.awaitTermination(120)
    assert {r.id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}[1] == 1.0
