"""The library's tables, derived row by row from the given ones.

At scale no derivation needs a shuffle except `metrics`, which averages before it shuffles.
The given test tables are one row group, so one split, each: `spread` is for these alone.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions import text
from ..operators.verification import execution_worklist
from ..sources.files import opened


def spread(table: DataFrame, key: str) -> DataFrame:
    """The table over the session's shuffle partitions, as a table of several splits would be."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(parts, key)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents"), "doc_id")


def orders(spark, sf_dir):
    return spread(load(spark, sf_dir, "orders"), "o_orderkey")


def problems(spark, sf_dir):
    """Orders as problems: statements with and without each part, starter code, type."""
    sample = "struct<input:string,output:string,explanation:string>"
    return orders(spark, sf_dir).selectExpr(
        "o_orderkey AS problem_id",
        "o_custkey",
        f"""CASE WHEN o_orderkey % 11 <> 0 THEN named_struct(
            'raw_text', concat('Order ', o_orderkey, ' ', o_orderpriority),
            'input_format', CASE WHEN o_orderstatus = 'O' THEN 'one integer' END,
            'output_format', CASE WHEN o_orderstatus <> 'P' THEN 'one number' END,
            'notes', CASE o_custkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' END,
            'samples', CASE o_orderkey % 4
                WHEN 1 THEN CAST(array() AS array<{sample}>)
                WHEN 2 THEN array(named_struct(
                    'input', CAST(o_custkey AS string), 'output', o_orderstatus,
                    'explanation', CASE WHEN o_orderkey % 3 = 0 THEN 'as ordered' END))
                WHEN 3 THEN array(
                    named_struct('input', CAST(o_custkey AS string), 'output', o_orderstatus,
                                 'explanation', 'first'),
                    named_struct('input', '', 'output', o_orderpriority,
                                 'explanation', CAST(NULL AS string)))
                END) END AS statement""",
        r"""CASE o_orderkey % 5
            WHEN 0 THEN concat('def solve_', o_custkey % 7, '(a):')
            WHEN 1 THEN concat('class S:\n    def go_', o_custkey % 7, '(self, a):')
            WHEN 2 THEN 'def broken('
            WHEN 3 THEN '' END AS starter_code""",
        """CASE o_orderkey % 6 WHEN 0 THEN 'stdin' WHEN 1 THEN NULL ELSE 'function' END
            AS problem_type""",
    )


def fenced_documents(spark, sf_dir):
    """Whole documents inside fences of each kind, unclosed, blank, bare and null."""
    return documents(spark, sf_dir).selectExpr(
        "doc_id AS problem_id",
        r"""CASE doc_id % 7
            WHEN 0 THEN concat('```python\n', text, '\n```')
            WHEN 1 THEN concat('a\n```\n', text, '\n```')
            WHEN 2 THEN concat('```python\nx = 1\n```\nor\n```python\n', text, '\n```')
            WHEN 3 THEN concat('```python\n', text)
            WHEN 4 THEN '   '
            WHEN 5 THEN text END AS completion""",
    )


def generated(spark, sf_dir):
    """Documents as problems, their sentences as samples, in nested arrays.

    Some problems have no outputs, some one rate too few, some only right or only wrong
    samples.
    """
    pieces = documents(spark, sf_dir).select(
        "doc_id", "lang", "source", F.split("text", "[.]").alias("pieces")
    )
    output = r"""transform(pieces, (p, i) -> CASE i % 5
        WHEN 0 THEN concat('```python\n', p, '\n```')
        WHEN 1 THEN concat('so\n```\n', p, '\n```')
        WHEN 2 THEN concat('```python\nx = 1\n```\nor\n```python\n', p, '\n```')
        ELSE p END)"""
    rate = """transform(pieces, p -> CASE
        WHEN doc_id % 11 = 0 THEN 1.0D WHEN doc_id % 13 = 0 THEN 0.0D
        WHEN length(p) % 8 = 0 THEN NULL WHEN length(p) % 8 <= 3 THEN 1.0D
        WHEN length(p) % 8 <= 5 THEN 0.0D ELSE 0.5D END)"""
    return pieces.selectExpr(
        "doc_id AS problem_id",
        "concat(source, '-', doc_id) AS canonical_id",
        "concat('Write what text ', doc_id, ' says in ', lang) AS prompt",
        f"CASE WHEN doc_id % 17 <> 0 THEN {output} END AS {fx.OUTPUTS}",
        f"slice({rate}, 1, size(pieces) - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END)"
        f" AS {fx.PASS_RATES}",
    )


def completions(spark, sf_dir):
    """Conversation turns as completions of the problem with the conversation's number."""
    return load(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS problem_id",
        "turn AS sample_idx",
        r"""CASE turn % 4
            WHEN 0 THEN concat('  ```python\n', text, '\n```\n ')
            WHEN 1 THEN concat(text, '\n')
            WHEN 2 THEN concat('```\n', text, '\n```')
            ELSE '  \n ' END AS output""",
        "CASE role WHEN 'assistant' THEN 'stop' ELSE 'length' END AS finish_reason",
    )


def tested_problems(spark, sf_dir):
    """Documents as problems with tests: a suite of their lines, a suite of their sentences."""
    case = "array<struct<input:string,output:string>>"
    return documents(spark, sf_dir).selectExpr(
        "doc_id AS problem_id",
        "text AS prompt",
        "CASE WHEN doc_id % 3 = 0 THEN 'solve' END AS function_name",
        rf"""array(
            named_struct('cases', transform(split(text, '\n'), l -> named_struct(
                'input', l, 'output', CAST(length(l) AS string)))),
            CASE WHEN doc_id % 5 <> 0 THEN named_struct('cases',
                CASE WHEN doc_id % 9 <> 0 THEN transform(split(text, '[.]'), s -> named_struct(
                    'input', CASE WHEN length(s) % 2 = 1 THEN s END, 'output', s))
                ELSE CAST(NULL AS {case}) END) END) AS test_suites""",
        "floor(length(text) / 3) > int(2000 * 0.8) AS over_budget",
    )


def raw_problems(spark, sf_dir):
    """Documents as problems before any preparation, with the tests of `tested_problems`."""
    return tested_problems(spark, sf_dir).selectExpr(
        "problem_id",
        "concat('d-', problem_id) AS canonical_id",
        """named_struct('raw_text', prompt, 'input_format', '', 'output_format', '', 'notes', '',
            'samples', CAST(array() AS array<struct<input:string,output:string,explanation:string>>))
            AS statement""",
        "CASE WHEN problem_id % 3 = 0 THEN 'def solve(a):' END AS starter_code",
        "CASE WHEN problem_id % 3 = 0 THEN 'function' END AS problem_type",
        "test_suites",
    )


def stage_runs(spark, sf_dir):
    """What a runner returns for the work list: every second sample passes, the others in part."""
    work = execution_worklist(completions(spark, sf_dir), tested_problems(spark, sf_dir))
    right = "(problem_id + sample_idx) % 4 < 2 OR (problem_id + sample_idx + test_idx) % 7 < 3"
    return work.selectExpr(
        "problem_id",
        "sample_idx",
        "test_idx",
        "200 AS status",
        f"CASE WHEN {right} THEN concat(expected_output, '\\n') ELSE '?' END AS stdout",
        "0 AS exit_code",
        "false AS timed_out",
    )


def _runs(spark, sf_dir):
    # Price in cents after the order's number tells the tests of one sample apart.
    lines = spread(load(spark, sf_dir, "lineitem"), "l_orderkey")
    return lines.selectExpr(
        "l_partkey AS problem_id",
        "CAST(l_linenumber AS bigint) AS sample_idx",
        "l_orderkey * 100000000 + CAST(round(l_extendedprice * 100) AS bigint) AS test_idx",
        "CAST(CAST(l_quantity AS int) AS string) AS expected_output",
        r"""CASE WHEN l_tax < 0.05 THEN concat('  ', CAST(l_quantity AS int), '\n')
            ELSE 'x' END AS stdout""",
        "CASE WHEN l_discount > 0.085 THEN 1 ELSE 0 END AS exit_code",
        "l_discount < 0.005 AS timed_out",
        "CASE WHEN l_suppkey % 50 = 0 THEN 500 ELSE 200 END AS status",
        "l_returnflag",
        "l_linestatus",
    )


def worklist(spark, sf_dir):
    """Line items as tests of samples (part, line number); returned items had no code."""
    return _runs(spark, sf_dir).where("l_returnflag <> 'R'").select(
        "problem_id", "sample_idx", "test_idx", "expected_output"
    )


def executions(spark, sf_dir):
    """The runner's results; some for open items never came back."""
    return _runs(spark, sf_dir).where("l_linestatus = 'F' OR test_idx % 7 <> 0").select(
        "problem_id", "sample_idx", "test_idx", "status", "stdout", "exit_code", "timed_out"
    )


def run_samples(spark, sf_dir):
    """The samples that line items belong to, with or without code."""
    return _runs(spark, sf_dir).select("problem_id", "sample_idx").distinct()


def rollouts(spark, sf_dir):
    """Orders as ranking prompts of 3 to 5 candidates, with 8 responses each."""
    base = orders(spark, sf_dir).selectExpr(
        "o_orderkey AS problem_id",
        "o_orderstatus AS generator",
        "o_orderpriority AS difficulty",
        "CAST(month(o_orderdate) * 10 AS int) AS step",
        "CAST(3 + o_orderkey % 3 AS int) AS n",
        """slice(array((o_custkey % 4) / 3.0D, (o_custkey div 4 % 4) / 3.0D,
            (o_custkey div 16 % 4) / 3.0D, (o_orderkey % 4) / 3.0D,
            (o_orderkey div 4 % 4) / 3.0D), 1, CAST(3 + o_orderkey % 3 AS int)) AS pass_rates""",
        "o_custkey",
    )
    # What all responses to a prompt share is made once, before they are.
    known = base.withColumn("ground_truth", text.json_array(F.col("pass_rates")))
    each = ", ".join(
        f"""CAST((CASE WHEN o_custkey % 2 = 0 THEN problem_id + rollout_idx + {i}
            ELSE problem_id + rollout_idx + n - {i} END) % n + 1 AS string)"""
        for i in range(5)
    )
    ranked = known.selectExpr("*", "explode(sequence(0L, 7L)) AS rollout_idx").selectExpr(
        "*", f"slice(array({each}), 1, n) AS ids"
    )
    return ranked.select(
        "problem_id",
        "rollout_idx",
        "step",
        "generator",
        "difficulty",
        "n",
        "pass_rates",
        F.expr(
            """CASE rollout_idx
            WHEN 0 THEN array_join(ids, ', ')
            WHEN 1 THEN array_join(reverse(ids), ' > ')
            WHEN 2 THEN concat('<think>1, 2</think> ', array_join(ids, ','))
            WHEN 3 THEN array_join(slice(ids, 1, n - 1), ', ')
            WHEN 4 THEN 'no ranking'
            WHEN 5 THEN concat('Best: ', ids[0], ' ', array_join(ids, ' '), ' then 12345')
            WHEN 6 THEN concat(n + 1, ', 0, ', array_join(ids, ', '))
            ELSE concat('00002, ', array_join(filter(ids, d -> d <> '2'), ', ')) END"""
        ).alias("response"),
        "ground_truth",
    )


#: A reward as a user may write it: all four arguments, a dict, and an error where it has no answer.
REWARD_FILE = """
import json
import re


def first_choice(data_source, solution_str, ground_truth, extra_info=None):
    rates = json.loads(ground_truth)
    answer = solution_str.split("</think>")[-1]
    named = [int(d) for d in re.findall("[0-9]+", answer) if int(d) <= len(rates)]
    if not named:
        raise ValueError("no candidate named")
    score = rates[named[0] - 1] if named[0] else -1
    return {"score": score, "step": extra_info["step"], "known": data_source == "code_ranking"}
"""


def metrics(spark, sf_dir):
    """Event types as metrics; days as steps, users as repeats."""
    return (
        load(spark, sf_dir, "events")
        .groupBy(
            (F.dayofmonth("ts") * 10).alias("step"),
            (F.col("user_id") % 10).cast("int").alias("repeat_idx"),
            F.col("event_type").alias("metric"),
        )
        .agg(F.avg("value").alias("value"))
    )


def result_documents(spark, sf_dir):
    """Result files to be: up to three per run, some broken, some of other tasks."""
    run = metrics(spark, sf_dir).groupBy("step", "repeat_idx").agg(
        F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("m")
    )
    body = F.concat_ws(
        ",",
        F.transform("m", lambda e: F.concat(F.lit('"'), e["metric"], F.lit('":'), e["value"].cast("string"))),
        F.lit('"_seed":7'),
        F.lit('"passed":true'),
        F.lit('"note":"0.5"'),
    )
    kind = (F.col("step") / 10 + F.col("repeat_idx")).cast("int") % 4
    task = F.concat(F.lit('{"results":{"other":{"z":1},"LiveCodeBench_v6":{'), body, F.lit("}}}"))
    flat = F.concat(F.lit('{"accuracy":0.25,'), body, F.lit("}"))
    other = F.lit('{"results":{"other":{"accuracy":0.125}}}')
    broken = F.lit('{"accuracy":')
    # kind 0: matching task; 1: broken, then flat; 2: another task, then a match; 3: none.
    files = (
        F.when(kind == 0, F.array(task, other))
        .when(kind == 1, F.array(broken, flat, task))
        .when(kind == 2, F.array(other, task, flat))
        .otherwise(F.array(broken, other))
    )
    return run.select("step", "repeat_idx", F.posexplode(files).alias("file_idx", "value"))


def result_file_batches(folder):
    """Writes each row's document as a file of its run's folder, and a draft beside the first."""

    def run(batches):
        store, root = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                below = f"{root}/step_{row['step']}/repeat_{row['repeat_idx']}/files"
                store.create_dir(below, recursive=True)
                mark = "_" if (row["step"] // 10 + row["repeat_idx"]) % 2 else ""
                files = {f"{mark}{row['file_idx']}.json": row["value"]}
                if row["file_idx"] == 0:
                    files[".draft.json"] = '{"accuracy":0.75}'
                for name, text in files.items():
                    with store.open_output_stream(f"{below}/{name}") as file:
                        file.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32())], ["n"])

    return run
