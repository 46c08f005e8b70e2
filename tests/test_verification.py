import ast
import io
import subprocess
import sys

from pyspark.sql import functions as F

from gradeweave.operators import completions as C
from gradeweave.operators import problems as P
from gradeweave.operators import verification as V
from gradeweave.schemas import EXECUTIONS, TEST_SUITES

SUITES = [
    {"cases": [{"input": "1", "output": "a"}, None, {"input": None, "output": "b"}]},
    None,
    {"cases": None},
    {"cases": [{"input": "3", "output": None}]},
]


def problem_table(spark):
    rows = [(1, SUITES, None), (2, None, None), (3, [{"cases": [{"input": "9", "output": " x\n"}]}], "f")]
    return spark.createDataFrame(
        rows, f"problem_id long, test_suites {TEST_SUITES.simpleString()}, function_name string"
    )


def test_flatten_and_cap(spark):
    cases = P.flatten_test_cases(problem_table(spark)).orderBy("problem_id", "test_idx").collect()
    assert [tuple(r) for r in cases] == [
        (1, 0, "1", "a"),
        (1, 1, "None", "b"),
        (1, 2, "3", "None"),
        (3, 0, "9", " x\n"),
    ]
    many = spark.range(1).select(
        F.col("id").alias("problem_id"),
        F.expr("array(named_struct('cases', transform(sequence(1, 70), i -> named_struct("
               "'input', string(i), 'output', string(i)))))").alias("test_suites"),
    )
    whole = P.flatten_test_cases(many)
    capped = P.flatten_test_cases(many, max_tests=50)
    assert whole.agg(F.count("*"), F.max("test_idx")).first()[:] == (70, 69)
    assert capped.agg(F.count("*"), F.max("test_idx")).first()[:] == (50, 49)


def test_worklist_rules_and_chunks(spark):
    samples = spark.createDataFrame(
        [
            (1, 0, "```python\nc\n```"),
            (1, 1, "   "),
            (1, 2, "no fence"),
            (1, 3, "```python\n\n```"),
            (1, 4, None),
            (1, 5, "```\nd\n```"),
            (2, 0, "```python\nc\n```"),
            (3, 0, "```python\nc\n```"),
        ],
        "problem_id long, sample_idx long, output string",
    )
    want = [(1, 0, t, "c", None) for t in range(3)] + [(1, 5, t, "d", None) for t in range(3)]
    want.append((3, 0, 0, "c", "f"))
    for chunk_rows in (1, 2, 4096):
        work = V.execution_worklist(samples, problem_table(spark), chunk_rows=chunk_rows)
        got = work.select("problem_id", "sample_idx", "test_idx", "code", "function_name")
        assert sorted(map(tuple, got.collect()), key=lambda r: r[:3]) == want


def test_passed_and_rates(spark):
    work = spark.createDataFrame(
        [(1, 0, t, " ok\n") for t in range(9)] + [(1, 1, 0, "ok"), (1, 2, 0, "")],
        "problem_id long, sample_idx long, test_idx long, expected_output string",
    )
    runs = spark.createDataFrame(
        [
            (1, 0, 0, 200, "ok", "", 0, False),
            (1, 0, 1, 200, "\x1cok\u3000\n", "", 0, None),
            (1, 0, 2, 500, "ok", "", 0, False),
            (1, 0, 3, 200, "ok", "", 1, False),
            (1, 0, 4, 200, "ok", "", 0, True),
            (1, 0, 5, 200, "no", "", 0, False),
            (1, 0, 6, None, "ok", "", 0, False),
            (1, 0, 7, 200, "ok", "", None, False),
            (1, 1, 0, 200, "ok", "", 0, False),
            (1, 2, 0, 200, None, "", 0, False),
        ],
        EXECUTIONS,
    )
    verified = V.verify(work, runs)
    passed = {(r.sample_idx, r.test_idx): r.passed for r in verified.collect()}
    assert [passed[0, t] for t in range(9)] == [True, True] + [False] * 7
    samples = spark.createDataFrame(
        [(1, 0), (1, 1), (1, 2), (1, 3)], "problem_id long, sample_idx long"
    )
    rated = V.with_pass_rates(samples, V.pass_rates(verified))
    assert {r.sample_idx: r.pass_rate for r in rated.collect()} == {0: 2 / 9, 1: 1.0, 2: 1.0, 3: None}
    assert V.verification_counts(rated).first()[:] == (3, 4)


def test_verdicts_of_many_tests_and_retries(spark):
    """Bits over several words, retries that pass late, runs of no test, hot problems in small chunks."""
    cases = lambda n: [{"cases": [{"input": str(t), "output": f" {t} " if t % 5 else None} for t in range(n)]}]
    problems = [(1, cases(130), None), (2, cases(3), None), (3, None, None), (4, cases(64), "f")]
    samples = [(p, s, "```python\nc\n```" if s % 7 else "no code") for p in (1, 2, 3, 4, 9) for s in range(40 if p == 1 else 5)]
    right = lambda p, s, t: (p * 31 + s * 17 + t * 7) % 11 < 6
    runs = []
    for p, s, _ in samples:
        for t in [*range(140), -1]:
            if (p + s + t) % 13 == 0:
                continue  # never came back
            said = f"{t}\n" if t % 5 else "None"
            runs.append((p, s, t, 200, said if right(p, s, t) else "?", "", 0, False))
            if t % 3 == 0:  # tried again: a failure that counts, or one that does not undo the pass
                runs += [(p, s, t, 200, said, "", int(not right(p, s, t)), None), (p, s, t, 500, said, "", 0, False)]
    samples = spark.createDataFrame(samples, "problem_id long, sample_idx long, output string")
    problems = spark.createDataFrame(problems, f"problem_id long, test_suites {TEST_SUITES.simpleString()}, function_name string")
    runs = spark.createDataFrame(runs, EXECUTIONS)
    n_tests = {1: 130, 2: 3, 4: 64}
    expected = {
        (p, s, t): right(p, s, t) and (p + s + t) % 13 != 0
        for p, n in n_tests.items() for s in range(40 if p == 1 else 5) if s % 7 for t in range(n)
    }
    for chunk_rows in (1, 3, 4096):
        verdicts = V.sample_verdicts(samples, problems, runs, chunk_rows=chunk_rows)
        assert {tuple(r)[:3]: r.passed for r in V.tests_of(verdicts).collect()} == expected
        rates = {(r.problem_id, r.sample_idx): r.pass_rate for r in V.verdict_rates(verdicts).collect()}
        assert rates == {
            (p, s): sum(expected[p, s, t] for t in range(n)) / n
            for p, n in n_tests.items() for s in range(40 if p == 1 else 5) if s % 7
        }
    # A completion that comes twice, once without code, is one sample.
    twice = samples.union(samples.withColumn("output", F.lit("no code")))
    again = V.sample_verdicts(twice, problems, runs)
    assert sorted(map(str, map(tuple, again.collect()))) == sorted(map(str, map(tuple, verdicts.collect())))
    # The same as going through the work list.
    listed = V.verify(V.execution_worklist(samples, problems), runs)
    assert {tuple(r)[:3]: r.passed for r in listed.collect()} == expected


def test_verdicts_shuffle_no_texts(spark):
    """Neither expected texts nor outputs nor completions are in an exchange."""
    samples = spark.createDataFrame([], "problem_id long, sample_idx long, output string")
    problems = problem_table(spark)
    verdicts = V.sample_verdicts(samples, problems, spark.createDataFrame([], EXECUTIONS))
    plan = verdicts._jdf.queryExecution().optimizedPlan().toString()
    for join in (line for line in plan.split("\n") if "Join" in line):
        assert "output" not in join and "stdout" not in join and "test_suites" not in join
    assert verdicts.collect() == []


def test_generated_table(spark):
    """Parts, rates in place of their samples, over-budget problems, samples of unknown problems."""
    asked = spark.createDataFrame(
        [(1, False, "a"), (2, True, "b"), (3, False, "c")], "problem_id long, over_budget boolean, prompt string"
    )
    texts = [(1, i, f" t{i}\n", "stop") for i in range(7)] + [(2, 0, "x", "stop"), (2, 8, "x", "stop"), (9, 0, "y", "stop")]
    texts = spark.createDataFrame(texts, "problem_id long, sample_idx long, output string, finish_reason string")
    rates = spark.createDataFrame([(1, 0, 0.5), (1, 4, 1.0), (9, 0, 1.0)], "problem_id long, sample_idx long, pass_rate double")
    for given, rate in ((rates, {0: 0.5, 4: 1.0}), (None, {})):
        rows = C.generated_table(asked, texts, given, part_rows=3).orderBy("problem_id", "part").collect()
        assert [(r.problem_id, r.prompt, r.part, r.n_parts, r.first_sample) for r in rows] == [
            (1, "a", 0, 3, 0), (1, "a", 1, 3, 3), (1, "a", 2, 3, 6), (2, "b", 0, 1, 0), (3, "c", 0, 1, 0)
        ]
        assert [r.self_distillation_outputs for r in rows] == [["t0", "t1", "t2"], ["t3", "t4", "t5"], ["t6"], [], []]
        numbered = [r.first_sample + i for r in rows[:3] for i in range(len(r.self_distillation_outputs))]
        assert [x for r in rows for x in r.self_distillation_pass_rates] == [rate.get(i) for i in numbered]
    assert C.generated_table(asked, texts.limit(0), rates).count() == 3


def test_prompts_are_made_after_the_texts_meet(spark):
    """Prepared before or after the join, the table is the same; only raw columns are joined."""
    raw = spark.createDataFrame(
        [(1, "a"), (1, "a"), (2, "long"), (3, "c"), (4, "d"), (5, "long"), (None, "e")], "problem_id long, body string"
    )
    texts = [(p, i, f"t{i}", None) for p, i in [(1, 7), (1, 0), (1, 3), (2, 0), (2, 9), (4, 5), (5, 6), (None, 0), (3, None)]]
    texts = spark.createDataFrame(texts, "problem_id long, sample_idx long, output string, finish_reason string")
    rates = spark.createDataFrame([(1, 7, 0.5), (4, 5, 1.0), (1, 0, 0.0)], "problem_id long, sample_idx long, pass_rate double")

    def prepare(rows):
        made = rows.withColumn("prompt", F.concat(F.lit("p "), "body"))
        return made.withColumn("over_budget", F.length("prompt") > 4)

    for given in (rates, None):
        before = C.generated_table(prepare(raw), texts, given, part_rows=3)
        after = C.generated_table(raw, texts, given, part_rows=3, prepare=prepare)
        assert after.columns == before.columns
        assert sorted(map(str, after.collect())) == sorted(map(str, before.collect()))
        keys = sorted((r.problem_id or 0, r.part, r.n_parts, len(r.self_distillation_outputs)) for r in after.collect())
        assert keys == [
            (0, 0, 1, 0), (1, 0, 3, 1), (1, 0, 3, 1), (1, 1, 3, 1), (1, 1, 3, 1), (1, 2, 3, 1), (1, 2, 3, 1),
            (2, 0, 1, 0), (3, 0, 1, 1), (4, 1, 2, 1), (5, 0, 1, 0),
        ]
        plan = after._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("AS prompt") < plan.index("Join")


def test_attach_completions(spark):
    problems = spark.createDataFrame(
        [(1, False), (2, True), (3, False)], "problem_id long, over_budget boolean"
    )
    texts = spark.createDataFrame(
        [(1, i, f" t{i}\n", "stop") for i in range(5)] + [(2, 0, "x", "stop"), (9, 0, "y", "stop")],
        "problem_id long, sample_idx long, output string, finish_reason string",
    )
    want = [(1, i, f"t{i}") for i in range(5)] + [(2, None, None), (3, None, None)]
    for chunk_rows in (2, 4096):
        got = C.attach_completions(problems, texts, chunk_rows)
        assert sorted(map(tuple, got.select("problem_id", "sample_idx", "output").collect()),
                      key=lambda r: (r[0], r[1] or 0)) == want


def test_problem_type(spark):
    df = spark.createDataFrame(
        [
            (0, "function", "def f(a):"),
            (1, "function", ""),
            (2, "function", None),
            (3, "function", "def broken("),
            (4, "stdin", "def f(a):"),
            (5, None, "def f(a):"),
        ],
        "i int, problem_type string, starter_code string",
    )
    rows = P.normalize_problem_type(df).orderBy("i").collect()
    assert [r.problem_type for r in rows] == ["function"] + ["stdin"] * 5
    assert [r.function_name for r in rows] == ["f"] + [None] * 5


INPUTS = ["", "1\n2", "a'b\"c\\\\n", "\t\r\x00\x1f\x7f", "é\u2028\U0001f600 {x}\n\\u0041/", "  pad \n\n"]


def test_programs_get_the_input_as_it_is(spark):
    """Every program is run: a function gets the lines, may read stdin, and its value is printed."""
    code = "import sys\ndef f(*lines):\n    return repr((lines, sys.stdin.read()))"
    rows = [(i, code, "f", given) for i, given in enumerate(INPUTS)] + [(9, "print(1)", None, "x")]
    work = spark.createDataFrame(rows, "test_idx int, code string, function_name string, input string")
    got = {r.test_idx: r for r in V.with_programs(work).collect()}
    assert (got[9].program, got[9].stdin) == ("print(1)", "x")
    for i, given in enumerate(INPUTS):
        out = subprocess.run([sys.executable, "-"], input=got[i].program, capture_output=True, encoding="utf-8", check=True)
        assert ast.literal_eval(out.stdout) == (tuple(given.strip().split("\n")), io.StringIO(given).read())
        assert got[i].stdin == ""
