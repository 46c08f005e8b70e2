import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gradeweave.operators import records as R
from gradeweave.plans import jobs
from gradeweave.sources import tables

SCHEMA = (
    "problem_id long, group_idx long, prompt string, candidates_code array<string>, "
    "pass_rates array<double>"
)


def group_table(spark, n=257, hot=100):
    """One problem has many groups, the others few; group numbers have gaps."""
    keys = [(7, 2 * g) for g in range(hot)] + [(1000 + i // 3, i % 3) for i in range(n - hot)]
    rows = [(p, g, f"q{p}", [f"c{g}", "d"], [1.0, 1 / 3]) for p, g in keys]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_index_is_dense_and_ordered(spark):
    out = R.record_index(group_table(spark)).orderBy("problem_id", "group_idx").collect()
    assert [r["index"] for r in out] == list(range(257))


@pytest.mark.parametrize("ranges", [1, 2, 6, 64, 1000])
def test_index_over_many_ranges_and_chunks(spark, monkeypatch, ranges):
    from gradeweave.operators import chunks

    monkeypatch.setattr(chunks.chunk_number, "__defaults__", (8,))
    out = chunks.dense_index(group_table(spark), "problem_id", "group_idx", "index", ranges)
    rows = out.orderBy("problem_id", "group_idx").collect()
    assert [r["index"] for r in rows] == list(range(257))


def test_index_of_nothing(spark):
    assert R.record_index(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("ratio", [0.1, 0.5, 0.0, 1.0, 0.333])
@pytest.mark.parametrize("by", ["group", "problem"])
def test_split_is_exact(spark, ratio, by):
    table = group_table(spark)
    out = R.train_val_split(table, ratio, 42, by).collect()
    units = {(r.problem_id,) if by == "problem" else (r.problem_id, r.group_idx) for r in out}
    ordered = sorted(hashlib.md5("|".join(map(str, (42, *u))).encode()).hexdigest() for u in units)
    train = set(ordered[: int(len(ordered) * (1 - ratio))])
    assert len(out) == 257
    assert all((r.split == "train") == (r.shuffle_key in train) for r in out)


@pytest.mark.parametrize("most", [1, 3, 40])
def test_split_by_longer_prefixes(spark, monkeypatch, most):
    """Where a prefix holds too many hashes to rank, longer ones are counted."""
    monkeypatch.setattr(R, "DIGITS", 1)
    monkeypatch.setattr(R, "MOST_RANKED", most)
    table = group_table(spark)
    expected = sorted(map(str, map(tuple, R.train_val_split(table, 0.3).select("problem_id", "group_idx", "split").collect())))
    monkeypatch.undo()
    got = R.train_val_split(table, 0.3).select("problem_id", "group_idx", "split").collect()
    assert sorted(map(str, map(tuple, got))) == expected


def test_index_beside_the_texts(spark):
    """The index of whole rows is that of their keys, whether the keys travel or the rows do."""
    table = group_table(spark)
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            out = R.record_index(table)
            assert out.columns == [*table.columns, "index"]
            rows = out.orderBy("problem_id", "group_idx").collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert [r["index"] for r in rows] == list(range(257)) and all(r.prompt == f"q{r.problem_id}" for r in rows)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_dealt_rows_move_once(spark, parts):
    """Texts are in one exchange, partitions are ranges of the key in order, numbers are right."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        labelled = R.train_val_split(group_table(spark), 0.2)
        dealt = R.dealt_with_index(labelled)
        assert dealt.columns == [*labelled.columns, "index"]
        rows = dealt.withColumn("task", F.spark_partition_id()).collect()
        plan = dealt._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # All other exchanges are of numbers and keys: above the one of the texts there is none.
    assert parts == 1 or plan.count("hashpartitioning(_slot") == 1 and plan.index("Exchange") == plan.index("Exchange hashpartitioning(_slot")
    index = {(r.problem_id, r.group_idx): r["index"] for r in R.record_index(group_table(spark)).collect()}
    assert len(rows) == 257 and all(r["index"] == index[r.problem_id, r.group_idx] for r in rows)
    by_key = sorted(rows, key=lambda r: r.shuffle_key)
    assert [r.task for r in by_key] == sorted(r.task for r in rows)
    for task in {r.task for r in rows}:
        own = [(r.split, r.shuffle_key) for r in rows if r.task == task]
        assert own == sorted(own)


def test_split_of_repeated_keys_fails(spark):
    table = spark.createDataFrame([(1, 1)] * 10, "problem_id long, group_idx long")
    with pytest.raises(Exception, match="not unique"):
        R.train_val_split(table, 0.5).collect()


def test_record_fields(spark):
    table = group_table(spark, 12, 3).withColumn("index", F.lit(4).cast("bigint"))
    r = R.training_records(table.where("problem_id = 7 and group_idx = 2")).first()
    assert (r.data_source, r.ability) == ("code_ranking", "code_ranking")
    assert r.reward_model.asDict() == {"style": "rule", "ground_truth": json.dumps([1.0, 1 / 3])}
    assert r.extra_info.asDict() == {"index": 4, "n_candidates": 2}
    assert [t.role for t in r.prompt] == ["user"] and "```python\nc2\n```" in r.prompt[0].content


def test_length_mismatch(spark):
    rows = [(1, 0, "q", ["a"], [1.0, 0.0]), (1, 1, "q", ["a"], [1.0])]
    table = spark.createDataFrame(rows, SCHEMA)
    assert R.length_violations(table).count() == 1
    with pytest.raises(Exception, match="length mismatch"):
        R.checked(table).collect()
    assert R.checked(table.where("group_idx = 1")).first().pass_rates == [1.0]


def test_array_or_json(spark):
    json_rows = spark.createDataFrame([('["a", "b"]', "[1.0, 0.5]")], "candidates_code string, pass_rates string")
    lists = spark.createDataFrame([(["a", "b"], [1.0, 0.5])], "candidates_code array<string>, pass_rates array<double>")
    for df in (json_rows, lists):
        assert R.read_groups_columns(df).first()[:] == (["a", "b"], [1.0, 0.5])


def test_record_job_writes_shuffled_sides(spark, tmp_path):
    stored = tables.write_groups(group_table(spark), str(tmp_path))
    path = jobs.record_job(spark, stored, str(tmp_path), val_ratio=0.25)
    out = tables.read_table(spark, path)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 192, "test": 65}
    assert out.select("extra_info.index").distinct().count() == 257
    for side, n in counts.items():
        files = sorted((tmp_path / "records" / f"split={side}").glob("*.parquet"))
        order = [r[0] for f in files for r in spark.read.parquet(str(f)).select("extra_info.index").collect()]
        assert len(order) == n and order != sorted(order)
        # File after file, rows lie in the order of their hashes.
        table = R.train_val_split(R.record_index(group_table(spark)), 0.25)
        key = {r["index"]: r.shuffle_key for r in table.collect()}
        assert [key[i] for i in order] == sorted(key[i] for i in order)
