"""Evaluation result files and the sweep's summary files."""

from pyspark.sql import DataFrame, SparkSession

from ..operators.sweep import nested_summary
from .files import RunFiles
from .tables import publish

SUMMARY = "step int, metric string, mean double, stderr double, n bigint"


def read_result_files(
    spark: SparkSession, root: str, names: str = "*.json", dotted: bool = False
) -> DataFrame:
    """All result files at any depth below `root/step_S/repeat_R`: (step, repeat_idx, path, value).

    Names may begin with `_`; names that begin with a dot are read if `dotted` says so. Run
    folders further down, of another sweep kept below this one, are not this one's. A file
    that is no UTF-8 text has a null value.
    """
    spark.dataSource.register(RunFiles)
    reader = spark.read.format("run_files").option("names", names).option("dotted", str(dotted).lower())
    return reader.option("tasks", 4 * spark.sparkContext.defaultParallelism).load(root)


def write_summary(summary: DataFrame, folder: str) -> str:
    """The long table (step, metric, mean, stderr, n), and one nested object per step."""
    base = folder.rstrip("/")
    spark = summary.sparkSession
    publish(spark, f"{base}/sweep_results.json", summary.write.json)
    nested = read_summary(spark, base).transform(nested_summary)
    publish(spark, f"{base}/sweep_results_by_step.json", nested.write.json)
    return base


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The long table that `write_summary` wrote."""
    return spark.read.schema(SUMMARY).json(f"{folder.rstrip('/')}/sweep_results.json")
