"""Text columns: questions, prompts, token estimates, code extraction, ranking prompts."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fx


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (one linear pass, no regex)."""
    return F.btrim(text, F.lit(fx.WHITESPACE))


def filled(text: Column) -> Column:
    """True for text that is neither null nor empty; never null."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def section(heading: str, body: Column, tail: str = "") -> Column:
    """`heading + body + tail`, or nothing when the body is null or empty."""
    return F.when(filled(body), F.concat(F.lit(heading), body, F.lit(tail))).otherwise("")


def question(statement: Column, starter_code: Column) -> Column:
    """Assemble the question text from a statement struct; a null statement gives ''."""

    def sample_text(sample, i):
        return F.concat(
            F.lit(fx.SAMPLE_HEAD),
            (i + 1).cast("string"),
            F.lit(":\n"),
            section(fx.SAMPLE_INPUT, sample["input"]),
            section(fx.SAMPLE_OUTPUT, sample["output"]),
            section(fx.SAMPLE_EXPLANATION, sample["explanation"]),
        )

    samples = F.array_join(F.transform(statement["samples"], sample_text), "")
    text = F.concat(
        section(fx.QUESTION_HEAD, statement["raw_text"]),
        section(fx.QUESTION_INPUT, statement["input_format"]),
        section(fx.QUESTION_OUTPUT, statement["output_format"]),
        section(fx.QUESTION_NOTES, statement["notes"]),
        section(fx.QUESTION_SAMPLES, samples),
        section(fx.STARTER_HEAD, starter_code, fx.STARTER_TAIL),
    )
    return F.when(statement.isNull(), F.lit("")).otherwise(text)


def is_thinking_model(name: Column) -> Column:
    """Does the model name mark a model that thinks before it answers?"""
    return F.lower(name).rlike("|".join(fx.THINKING_MODEL_PARTS))


def generation_prompt(
    question: Column, starter_code: Column, problem_type: Column, model: Column
) -> Column:
    """Prompt asking for a program, in the function or the stdin wording."""
    tail = F.when(
        problem_type == "function",
        F.concat(F.lit(fx.PROMPT_FUNCTION_TAIL), F.coalesce(starter_code, F.lit("None"))),
    ).otherwise(F.lit(fx.PROMPT_STDIN_TAIL))
    only_program = F.when(is_thinking_model(model), F.lit("")).otherwise(
        F.lit(fx.PROMPT_ONLY_PROGRAM)
    )
    return F.concat(
        F.lit(fx.PROMPT_TASK), only_program, F.lit(fx.PROMPT_QUESTION), question, tail
    )


def token_estimate(text: Column) -> Column:
    """Whole thirds of the length in characters; null counts 0."""
    length = F.coalesce(F.length(text), F.lit(0))
    return F.floor(length / fx.CHARS_PER_TOKEN).cast("bigint")


def over_budget(prompt: Column, max_tokens: int = fx.MAX_TOKENS) -> Column:
    """True when the estimate exceeds the prompt's share of the context window."""
    return token_estimate(prompt) > int(max_tokens * fx.PROMPT_SHARE)


def _longest_match(text: Column, pattern: str) -> Column:
    """Body of the longest fence, the first of equals, stripped; null without a match."""
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    ranked = F.transform(
        bodies,
        lambda body, i: F.struct(
            F.length(body).alias("size"), (-i).alias("earlier"), body.alias("body")
        ),
    )
    return strip(F.array_max(ranked)["body"])


def python_literal(text: Column) -> Column:
    """The text as a Python string literal: what JSON writes for it is one."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def call_program(code: Column, function_name: Column, given: Column) -> Column:
    """The code, followed by a call of its function with the lines of the input.

    The function may also read the input from stdin; what it returns, unless None, is printed.
    """
    return F.concat(
        code,
        F.lit("\n\nimport io, sys\n_given = "),
        python_literal(given),
        F.lit("\nsys.stdin = io.StringIO(_given)\n_returned = "),
        function_name,
        F.lit("(*_given.strip().split(chr(10)))\nif _returned is not None:\n    print(_returned)\n"),
    )


def extract_code(text: Column, empty_is_none: bool = False) -> Column:
    """Code in the text's fences: tagged ones first, else bare ones, else null.

    Fences with nothing in them give '', or null with `empty_is_none`.
    """
    code = F.coalesce(_longest_match(text, fx.TAGGED_FENCE), _longest_match(text, fx.BARE_FENCE))
    return let(code, lambda c: F.when(c != "", c)) if empty_is_none else code


def extract_code_or_text(text: Column) -> Column:
    """As `extract_code`, but text without a fence is returned as it is."""
    return F.coalesce(extract_code(text), text)


def candidate_block(codes: Column) -> Column:
    """The numbered candidates of a ranking prompt; a null candidate reads 'None'."""
    return F.array_join(
        F.transform(
            codes,
            lambda code, i: F.concat(
                F.lit(fx.CANDIDATE_HEAD),
                (i + 1).cast("string"),
                F.lit(fx.CANDIDATE_OPEN),
                F.coalesce(code, F.lit("None")),
                F.lit(fx.CANDIDATE_CLOSE),
            ),
        ),
        "\n",
    )


def ranking_prompt(problem: Column, codes: Column) -> Column:
    """Prompt asking for the candidates in order, best first."""
    return F.concat(
        F.lit(fx.RANKING_BEFORE_COUNT),
        F.size(codes).cast("string"),
        F.lit(fx.RANKING_AFTER_COUNT),
        F.coalesce(problem, F.lit("None")),
        F.lit("\n\n"),
        candidate_block(codes),
        F.lit(fx.RANKING_TAIL),
    )


def json_number(value: Column) -> Column:
    """A double as JSON text in Python's spelling (0.0001, 5e-05) instead of Java's."""
    plain = value.cast("string")
    small = F.regexp_replace(plain, r"^(-?\d)\.0E-4$", "$1E-4")
    small = F.regexp_replace(small, r"^(-?)(\d)(?:\.(\d+))?E-4$", "$10.000$2$3")
    small = F.regexp_replace(small, r"^(-?\d)\.0E-", "$1E-")
    small = F.regexp_replace(small, r"E-(\d)$", "e-0$1")
    small = F.regexp_replace(small, "E-", "e-")
    return F.when((F.abs(value) < 1e-3) & (value != 0), small).otherwise(plain)


def json_array(values: Column) -> Column:
    """An array of doubles as JSON text with ', ' between the values."""
    shown = F.transform(values, lambda v: F.coalesce(json_number(v), F.lit("null")))
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))
