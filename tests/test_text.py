import json

import pytest
from pyspark.sql import functions as F

from gradeweave.functions import starter, text
from gradeweave.schemas import STATEMENT


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strip_matches_python(spark):
    odd = ["\x1c a\u3000", "\u2003x y\x85\n", "\u200bz", "", " \t\n", None]
    assert column(spark, odd, text.strip) == [v if v is None else v.strip() for v in odd]


FENCES = [
    "```python\nx=1\n```\n```python\nlonger\nyy\n```",
    "```python\nnever closed",
    None,
    "```python\n\n```",
    "say\n```\nbare\n```",
    "```\nbare is longer than tagged\n```\n```python\nt\n```",
    "```python\nab\n```\n```python\ncd\n```",
    "```python \t\n  pad  \n```",
    "```js\nno\n```",
    "",
]


def test_extract_code(spark):
    strict = ["longer\nyy", None, None, "", "bare", "t", "ab", "pad", None, None]
    assert column(spark, FENCES, text.extract_code) == strict
    lenient = [s if s is not None else t for s, t in zip(strict, FENCES)]
    assert column(spark, FENCES, text.extract_code_or_text) == lenient
    as_none = column(spark, FENCES, lambda v: text.extract_code(v, empty_is_none=True))
    assert as_none == [s or None for s in strict]


def test_token_estimate_counts_characters(spark):
    values = ["abcdef", "ab", "\U0001f600" * 7, "", None]
    assert column(spark, values, text.token_estimate) == [2, 0, 2, 0, 0]
    limit = ["x" * (104857 * 3 + 2), "x" * (104858 * 3)]
    assert column(spark, limit, text.over_budget) == [False, True]


def test_question(spark):
    full = {
        "raw_text": "R",
        "input_format": "I",
        "output_format": "O",
        "notes": "N",
        "samples": [("1", "2", "why"), ("", "3", None)],
    }
    rows = [
        (0, full, "def f():"),
        (1, {"raw_text": "R", "samples": []}, None),
        (2, None, "def f():"),
        (3, {"notes": "N"}, ""),
    ]
    df = spark.createDataFrame(
        rows, "i int, s struct<%s>, c string" % STATEMENT.simpleString()[7:-1]
    )
    shown = [
        r.q for r in df.select("i", text.question(F.col("s"), F.col("c")).alias("q")).orderBy("i").collect()
    ]
    assert shown == [
        "Problem:\nR\nInput Format:\nI\nOutput Format:\nO\nNotes:\nN\nSample Test Cases:\n"
        "\nExample 1:\nInput:\n1Output:\n2Explanation:\nwhy\nExample 2:\nOutput:\n3"
        "\nStarter Code:\n```python\ndef f():\n```\n",
        "Problem:\nR",
        "",
        "\nNotes:\nN",
    ]


def test_generation_prompt(spark):
    df = spark.createDataFrame(
        [(0, "function", "org/QwQ-32B"), (1, "function", "m-Instruct"), (2, "stdin", "X-THINKING")],
        "i int, t string, m string",
    )
    made = text.generation_prompt(F.lit("Q"), F.lit("def f(a):"), F.col("t"), F.col("m"))
    a, b, c = [r.p for r in df.select("i", made.alias("p")).orderBy("i").collect()]
    assert "NOT return" not in a and "NOT return" in b and "NOT return" not in c
    assert a.endswith('delimiters."\n```python\ndef f(a):')
    assert "all tests.\nQuestion: Q\n\nYou will use" in a
    assert c.endswith("STDOUT.\n```python\n  # YOUR CODE HERE\n```")


def test_ranking_prompt(spark):
    df = spark.createDataFrame([("100% sure", ["a\nb", None])], "p string, c array<string>")
    shown = df.select(text.ranking_prompt(F.col("p"), F.col("c")).alias("x")).first().x
    assert "and 2 candidate solutions." in shown and "Question: 100% sure\n\n---" in shown
    assert "--- CANDIDATE 1 ---\n```python\na\nb\n```\n\n--- CANDIDATE 2 ---\n```python\nNone\n```\n" in shown
    assert shown.endswith("Ranking (best to worst): ")


def test_json_array_is_python_text(spark):
    rates = [sorted({k / m for m in range(1, 51) for k in range(m + 1)}) + [1e-4, 2.5e-4, 5e-05, 1.25e-7]]
    assert column(spark, rates, text.json_array, "array<double>") == [json.dumps(rates[0])]
    assert column(spark, [[0.5, None], []], text.json_array, "array<double>") == ["[0.5, null]", "[]"]


STARTERS = {
    "def noted(a):\n    # what it does:": "noted",
    "def noted(a):\n    return a\n    # that is all:": None,
    "class S:\n\tdef go(self):": None,
    "def solve(a):": "solve",
    "class S:\n    def go(self, a):": "go",
    "def broken(": None,
    "": None,
    None: None,
    "async def z(): pass": None,
    "def a():\n    def b(): pass\ndef c(): pass": "b",
    "x = 1": None,
    "def f(a):  \n\n": "f",
    "def f():\n    return '\x00'": None,
}


def test_entry_function_name(spark):
    assert column(spark, list(STARTERS), starter.entry_function_name) == list(STARTERS.values())


@pytest.mark.parametrize("code", [c for c in STARTERS if c])
def test_entry_name_plain(code):
    assert starter.entry_name(code) == STARTERS[code]
