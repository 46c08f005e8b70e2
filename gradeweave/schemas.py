"""Explicit table schemas; `read_generated` uses them, so no footer is read to infer types."""

from pyspark.sql import types as T

from . import fixed_values as fx

SAMPLE_CASE = T.StructType(
    [
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("explanation", T.StringType()),
    ]
)

STATEMENT = T.StructType(
    [
        T.StructField("raw_text", T.StringType()),
        T.StructField("input_format", T.StringType()),
        T.StructField("output_format", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("samples", T.ArrayType(SAMPLE_CASE)),
    ]
)

TEST_CASE = T.StructType(
    [T.StructField("input", T.StringType()), T.StructField("output", T.StringType())]
)

TEST_SUITES = T.ArrayType(T.StructType([T.StructField("cases", T.ArrayType(TEST_CASE))]))

PROBLEMS = T.StructType(
    [
        T.StructField("canonical_id", T.StringType()),
        T.StructField("statement", STATEMENT),
        T.StructField("starter_code", T.StringType()),
        T.StructField("problem_type", T.StringType()),
        T.StructField("test_suites", TEST_SUITES),
    ]
)

GENERATED = T.StructType(
    [
        T.StructField("problem_id", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("n_parts", T.LongType()),
        T.StructField("first_sample", T.LongType()),
    ]
    + PROBLEMS.fields
    + [
        T.StructField("question", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField(fx.OUTPUTS, T.ArrayType(T.StringType())),
        T.StructField(fx.FINISH_REASONS, T.ArrayType(T.StringType())),
        T.StructField(fx.PASS_RATES, T.ArrayType(T.DoubleType(), containsNull=True)),
        T.StructField("generated_with", T.StringType()),
    ]
)

EXECUTIONS = T.StructType(
    [
        T.StructField("problem_id", T.LongType()),
        T.StructField("sample_idx", T.LongType()),
        T.StructField("test_idx", T.LongType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("stdout", T.StringType()),
        T.StructField("stderr", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("timed_out", T.BooleanType()),
    ]
)


def columns(schema: T.StructType, *names: str) -> T.StructType:
    """The named fields of a schema, in the given order."""
    return T.StructType([schema[name] for name in names])
