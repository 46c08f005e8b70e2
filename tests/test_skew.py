"""One key holds a third of the rows: its rows must not meet in one task."""

from pyspark.sql import functions as F

from gradeweave.operators import chunks
from gradeweave.operators import grouping as G

ROWS, HOT = 60_000, 20_000


def skewed(spark):
    """Key 0 has a third of the rows, numbered from 0; the others have four each."""
    n = F.col("id")
    return spark.range(ROWS).select(
        F.when(n < HOT, 0).otherwise(F.floor(n / 4) + 1).alias("problem_id"),
        F.when(n < HOT, n).otherwise(n % 4).alias("sample_idx"),
        F.concat(F.lit("s"), n.cast("string")).alias("output"),
        F.when(n % 3 == 0, 1.0).otherwise(0.5).alias("pass_rate"),
    )


def largest_task(rows):
    return (
        rows.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    )


def test_join_spreads_a_hot_key(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in {**conf, "spark.sql.shuffle.partitions": "16"}.items():
            spark.conf.set(key, value)
        rows = skewed(spark)
        per_key = rows.select("problem_id").distinct().withColumn("prompt", F.lit("q"))
        joined = chunks.join_by_key(rows, per_key, "problem_id", "sample_idx", chunk_rows=500)
        assert joined.count() == ROWS
        assert largest_task(joined) < HOT / 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for key, value in before.items():
            spark.conf.set(key, value)


def test_copies_of_a_hot_keys_row(spark):
    """A key with 20,000 chunks: its row's copies are complete, and made by many tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in {**conf, "spark.sql.shuffle.partitions": "16"}.items():
            spark.conf.set(key, value)
        rows = skewed(spark)
        per_key = rows.select("problem_id").distinct().withColumn("prompt", F.lit("q"))
        for how in ("inner", "left"):
            copies = chunks.chunk_copies(per_key, "problem_id", rows, "sample_idx", 1, how)
            assert copies.count() == ROWS and copies.distinct().count() == ROWS
            hot = copies.where("problem_id = 0")
            assert hot.agg(F.countDistinct("_chunk"), F.max("_chunk")).first()[:] == (HOT, HOT - 1)
            assert largest_task(hot) < HOT / 4
        lone = per_key.limit(1).withColumn("problem_id", F.lit(-5).cast("bigint"))
        kept = chunks.chunk_copies(lone, "problem_id", rows, "sample_idx", 1, "left")
        assert kept.select("problem_id", "_chunk").collect() == [(-5, None)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for key, value in before.items():
            spark.conf.set(key, value)


def test_groups_of_a_hot_problem_are_whole(spark):
    groups = G.candidate_groups(skewed(spark), chunk_rows=333)
    hot = groups.where("problem_id = 0")
    # 3 does not divide 4, so each group of the hot problem is mixed.
    assert hot.count() == HOT // 4
    starts = hot.select(F.expr("int(substring(candidates[0], 2))").alias("s"), "group_idx")
    assert starts.where("s <> group_idx * 4").count() == 0
    assert groups.where("size(candidates) <> 4").count() == 0


def test_index_of_a_hot_problem(spark):
    rows = skewed(spark).withColumnRenamed("sample_idx", "group_idx")
    out = chunks.dense_index(rows.select("problem_id", "group_idx"), "problem_id", "group_idx", "i")
    r = out.agg(F.min("i"), F.max("i"), F.countDistinct("i")).first()
    assert r[:] == (0, ROWS - 1, ROWS)
    assert out.where("problem_id = 0 and i <> group_idx").count() == 0
