"""Evaluation runs over steps and repeats: metrics, summary, missing runs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.text import let, strip
from .rows import with_known

NUMERIC_TYPES = "^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"


def metric_object(document: Column) -> Column:
    """JSON text of the metrics in a result document, or null when it has none.

    From `results`: the first task, in document order, whose name holds a known
    benchmark's; without `results`: the document itself if it has a known metric.
    """
    names = "|".join(fx.TASK_NAME_PARTS)
    flat_keys = F.array(*[F.lit(key) for key in fx.FLAT_RESULT_KEYS])

    def first_known(tasks):
        known = F.filter(F.map_entries(tasks), lambda task: task["key"].rlike(names))
        return F.get(known, F.lit(0))["value"]

    def pick(body, top):
        of_task = first_known(F.from_json(top["results"], "map<string,string>"))
        return F.when(F.map_contains_key(top, F.lit("results")), of_task).when(
            F.arrays_overlap(F.map_keys(top), flat_keys), body
        )

    def one_object(body):
        # What follows the first value would be overlooked; in a list it is a second item, or no JSON.
        listed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")
        return F.when(body.startswith("{") & (F.size(listed) == 1), body)

    return let(
        strip(document),
        lambda body: let(
            F.from_json(one_object(body), "map<string,string>"), lambda top: pick(body, top)
        ),
    )


def run_documents(files: DataFrame) -> DataFrame:
    """The metrics text of each (step, repeat): its first file by path that has one."""
    found = with_known(files, "metrics", metric_object(F.col("value")))
    return found.groupBy("step", "repeat_idx").agg(F.min_by("metrics", "path").alias("metrics"))


def metric_values(runs: DataFrame) -> DataFrame:
    """One row (step, repeat_idx, metric, value) per numeric metric; names with a leading
    underscore are left out and booleans count as 0 or 1. Of a name that comes twice in a
    document, the last value counts."""
    kind = F.schema_of_variant("item")
    items = F.map_entries(F.from_json("metrics", "map<string,variant>"))

    def last_of_name(items):
        names = F.transform(items, lambda item: item["key"])
        later = lambda item, i: F.slice(names, i + 2, F.size(names))
        return F.filter(items, lambda item, i: ~F.array_contains(later(item, i), item["key"]))

    return (
        runs.select("step", "repeat_idx", F.explode(let(items, last_of_name)).alias("entry"))
        .select(
            "step", "repeat_idx", F.col("entry.key").alias("metric"), F.col("entry.value").alias("item")
        )
        .where(~F.col("metric").startswith("_") & kind.rlike(NUMERIC_TYPES))
        .select(
            "step",
            "repeat_idx",
            "metric",
            F.try_variant_get("item", "$", "double").alias("value"),
        )
    )


def sweep_summary(values: DataFrame) -> DataFrame:
    """Mean, standard error (population deviation / sqrt n) and n per step and metric."""
    n = F.count("value")
    return values.groupBy("step", "metric").agg(
        F.avg("value").alias("mean"),
        F.when(n > 1, F.stddev_pop("value") / F.sqrt(n)).otherwise(0.0).alias("stderr"),
        n.alias("n"),
    )


def shown_summary(summary: DataFrame) -> DataFrame:
    """The summary's shown metrics, in order of step and `place`.

    The first step decides: its preferred metrics, or else its first few by name. The windows
    see the metrics of one step only.
    """
    liked = F.array_position(F.array(*map(F.lit, fx.SHOWN_METRICS)), F.col("metric"))
    named = summary.join(summary.agg(F.min("step").alias("step")), "step").select("metric", liked.alias("_liked"))
    named = named.withColumn("_any", F.max("_liked").over(Window.partitionBy()) > 0)
    named = named.where((F.col("_liked") > 0) | ~F.col("_any"))
    named = named.withColumn("place", F.row_number().over(Window.orderBy("_liked", "metric")) - 1)
    named = named.where(F.col("_any") | (F.col("place") < fx.SHOWN_OTHERS)).select("metric", "place")
    return summary.join(named, "metric").orderBy("step", "place")


def missing_runs(
    found: DataFrame, repeats: int, steps: list[int] | None = None, save_freq: int | None = None
) -> DataFrame:
    """(step, repeat_idx) of the sweep that have no metrics.

    The steps are given, or every `save_freq`-th up to the last step found.
    """
    if steps is not None:
        grid = found.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(int(s)) for s in steps])).alias("step")
        )
    else:
        last = found.agg(F.max("step").alias("last")).where(F.col("last") >= save_freq)
        grid = last.select(
            F.explode(F.sequence(F.lit(save_freq), F.col("last"), F.lit(save_freq))).alias("step")
        )
    every = F.array(*[F.lit(r) for r in range(repeats)]).cast("array<int>")
    expected = grid.select(F.col("step").cast("int"), F.explode(every).alias("repeat_idx"))
    return expected.join(found, ["step", "repeat_idx"], "left_anti")


def nested_summary(summary: DataFrame) -> DataFrame:
    """One row per step with a map: metric -> {mean, stderr, n}."""
    entry = F.struct("metric", F.struct("mean", "stderr", "n"))
    return summary.groupBy("step").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics")
    )
