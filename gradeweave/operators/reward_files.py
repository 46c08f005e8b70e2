"""Rewards that a user keeps in a Python file, given by its path and a function's name.

The function is called with data_source, solution_str, ground_truth and extra_info, once per
row, in one Arrow UDF. Its text goes out with the tasks, so no executor needs the file.
"""

import ast
import hashlib
import math
import sys
import types

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions import ranking

# Send this module's functions with the job: workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def reward_text(spark: SparkSession, path: str) -> str:
    """The file's text, read by Spark, so from any store that Spark reads."""
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} is not one file")
    return found[0][0]


def defined_names(source: str) -> set[str]:
    """Names that the file's top level may define; the driver parses the text but does not run it."""
    names = set()
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            names.add(node.name)
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            names.add(node.id)
        elif isinstance(node, ast.alias):
            names.add(node.asname or node.name.split(".")[0])
    return names


def loaded(source: str, name: str):
    """The named function of the text; each process runs the text once."""
    module_name = "reward_file_" + hashlib.sha256(source.encode()).hexdigest()[:16]
    if module_name not in sys.modules:
        module = types.ModuleType(module_name)
        sys.modules[module_name] = module
        try:
            exec(compile(source, module_name, "exec"), module.__dict__)
        except BaseException:
            del sys.modules[module_name]
            raise
    return getattr(sys.modules[module_name], name)


def as_fields(result, fields) -> list:
    """The fields' values of what a reward returned: a number, or a dict of numbers."""
    if not isinstance(result, dict):
        result = {"score": result}
    values = [result.get(field) for field in fields]
    return [None if v is None or math.isnan(float(v)) else float(v) for v in values]


def reward_udf(source: str, name: str, fields):
    """An Arrow UDF of the four arguments; a struct of the fields and `error`."""
    kinds = pa.struct([*[(field, pa.float64()) for field in fields], ("error", pa.string())])
    shape = ",".join([*[f"`{field}`:double" for field in fields], "error:string"])

    def run(data_source: pa.Array, said: pa.Array, truth: pa.Array, extra: pa.Array) -> pa.Array:
        function, rows = loaded(source, name), []
        for kind, text, known, more in zip(*(c.to_pylist() for c in (data_source, said, truth, extra))):
            try:
                result = function(data_source=kind, solution_str=text, ground_truth=known, extra_info=more)
                rows.append((*as_fields(result, fields), None))
            except Exception as error:  # a row that the function cannot score is no reason to lose the others
                rows.append((*[None] * len(fields), f"{type(error).__name__}: {error}"))
        columns = list(zip(*rows)) or [()] * (len(fields) + 1)
        arrays = [pa.array(column, field.type) for column, field in zip(columns, kinds)]
        return pa.StructArray.from_arrays(arrays, fields=list(kinds))

    return F.arrow_udf(run, f"struct<{shape}>")


def score_with_file(
    rollouts: DataFrame,
    path: str,
    name: str = "reward_func",
    fields: tuple[str, ...] = ranking.SCORES,
) -> DataFrame:
    """Add the fields that the file's function returns, and `reward_error`.

    rollouts: (response, ground_truth), and data_source and extra_info where it has them;
    without them the function gets this library's record kind and None. It may return a
    number, which is the score, or a dict; fields it does not return are null. Where it
    raises, all fields are null and `reward_error` says what was raised. A text that is no
    Python, or has no such name, is an error before any task starts.
    """
    source = reward_text(rollouts.sparkSession, path)
    if name not in defined_names(source):
        raise ValueError(f"{path} has no function {name}")
    has = lambda column, other: F.col(column) if column in rollouts.columns else other
    reward = reward_udf(source, name, fields)
    result = reward(
        has("data_source", F.lit(fx.RECORD_KIND)),
        F.col("response"),
        F.col("ground_truth"),
        has("extra_info", F.lit(None).cast("string")),
    )
    scored = rollouts.withColumn("_reward", result)
    named = [F.col("_reward")[field].alias(field) for field in fields]
    kept = [c for c in rollouts.columns if c not in fields]
    return scored.select(*kept, *named, F.col("_reward.error").alias("reward_error"))
