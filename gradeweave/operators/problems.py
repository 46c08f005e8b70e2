"""Problem rows: type, question, prompt, budget, tests."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions import starter, text
from .rows import each


def normalize_problem_type(problems: DataFrame) -> DataFrame:
    """Make `problem_type` 'stdin' unless starter code names a function to call.

    Adds `function_name`, null for stdin problems.
    """
    asks_function = F.col("problem_type") == "function"
    # Null for other problems: their starter code need not go through Python.
    code = F.when(asks_function, F.col("starter_code"))
    named = problems.withColumn("function_name", starter.entry_function_name(code))
    callable_ = asks_function & F.col("function_name").isNotNull()
    return named.withColumn(
        "problem_type",
        F.when(callable_, F.lit("function"))
        .when(asks_function, F.lit("stdin"))
        .otherwise(F.coalesce("problem_type", F.lit("stdin"))),
    )


def with_prompts(
    problems: DataFrame, model: str, max_tokens: int = fx.MAX_TOKENS
) -> DataFrame:
    """Add question, prompt, token estimate, over-budget flag and the model's name."""
    typed = normalize_problem_type(problems)
    asked = typed.withColumn(
        "question", text.question(F.col("statement"), F.col("starter_code"))
    )
    prompted = asked.withColumn(
        "prompt",
        text.generation_prompt(
            F.col("question"), F.col("starter_code"), F.col("problem_type"), F.lit(model)
        ),
    )
    return prompted.withColumns(
        {
            "token_estimate": text.token_estimate(F.col("prompt")),
            "over_budget": text.over_budget(F.col("prompt"), max_tokens),
            "generated_with": F.lit(model),
        }
    )


def first_problems(problems: DataFrame, n: int, key: str = "problem_id") -> DataFrame:
    """The first n problems by key (the caller's row limit)."""
    return problems.orderBy(key).limit(n)


def test_cases(suites: Column, max_tests: int | None = None) -> Column:
    """All suites' cases in order, at most `max_tests` if that is given, as array of (input, output) text.

    Null suites and cases are passed over; a null text reads 'None'.
    """
    none = F.lit("None")
    cases = F.flatten(
        F.transform(
            F.filter(suites, lambda suite: suite.isNotNull()),
            lambda suite: F.filter(
                F.coalesce(suite["cases"], F.array().cast("array<struct<input:string,output:string>>")),
                lambda case: case.isNotNull(),
            ),
        )
    )
    if max_tests is not None:
        cases = F.slice(cases, 1, max_tests)
    return F.transform(
        cases,
        lambda case: F.struct(
            F.coalesce(case["input"], none).alias("input"),
            F.coalesce(case["output"], none).alias("output"),
        ),
    )


def flatten_test_cases(
    problems: DataFrame, key: str = "problem_id", max_tests: int | None = None
) -> DataFrame:
    """One row per problem and test: (key, test_idx, input, expected_output)."""
    cases = test_cases(F.col("test_suites"), max_tests)
    return each(problems, [key], cases, "test_idx", "case").select(
        key,
        F.col("test_idx").cast("bigint").alias("test_idx"),
        F.col("case.input").alias("input"),
        F.col("case.output").alias("expected_output"),
    )
