import random

import pytest
from pyspark.sql import functions as F

from gradeweave import fixed_values as fx
from gradeweave.operators import completions as C
from gradeweave.operators import grouping as G

SCHEMA = (
    f"problem_id long, canonical_id string, prompt string, {fx.OUTPUTS} array<string>, "
    f"{fx.PASS_RATES} array<double>"
)


def make(seed=3, problems=60, longest=40):
    rng = random.Random(seed)
    rows = []
    for p in range(problems):
        n = rng.randint(0, longest)
        style = rng.choice(["mix", "mix", "mix", "right", "wrong", "half", "null"])
        value = {
            "mix": lambda: rng.choice([0.0, 0.5, 1.0, None]),
            "right": lambda: 1.0,
            "wrong": lambda: 0.0,
            "half": lambda: 0.5,
            "null": lambda: None,
        }[style]
        outputs = [f"```python\np{p} s{i}\n```" for i in range(n)]
        rates = [value() for _ in range(max(0, n - rng.choice([0, 0, 1])))]
        rows.append((p, f"c{p}", f"q{p}", outputs if p % 9 else None, rates))
    return rows


def wanted(rows, k, limit):
    """Groups by plain loops: {(problem, group): (outputs, rates)} and drop reasons."""
    groups, reasons = {}, {}
    for p, _, _, outputs, rates in rows:
        known = [pair for pair in zip(outputs or [], rates or []) if pair[1] is not None]
        if not known:
            continue
        values = {rate for _, rate in known}
        share = sum(rate == 1.0 for _, rate in known) / len(known)
        if values == {1.0}:
            reasons[p] = G.ALL_CORRECT
        elif values == {0.0}:
            reasons[p] = G.ALL_WRONG
        elif share > limit:
            reasons[p] = G.HIGH_RATIO
        else:
            reasons[p] = G.KEPT
            whole = len(known) - len(known) % k
            for g, at in enumerate(range(0, whole, k)):
                part = known[at : at + k]
                rates_of = [rate for _, rate in part]
                if 1.0 in rates_of and min(rates_of) < 1.0:
                    groups[p, g] = ([o for o, _ in part], rates_of)
    return groups, reasons


def found(df):
    return {(r.problem_id, r.group_idx): (r.candidates, r.pass_rates) for r in df.collect()}


@pytest.mark.parametrize("k,limit", [(4, 1.0), (2, 0.4), (3, 1.0)])
def test_groups_long_and_nested(spark, k, limit):
    rows = make()
    groups, reasons = wanted(rows, k, limit)
    assert groups and len(set(reasons.values())) >= 3
    nested = spark.createDataFrame(rows, SCHEMA)
    by_row = G.candidate_groups_nested(
        nested, "problem_id", "prompt", group_size=k, max_pass_ratio=limit
    )
    assert found(by_row) == groups
    assert by_row.where("candidates_code[0] = concat('p', problem_id, ' s0')").count() > 0
    long = C.unnest_samples(nested, "problem_id")
    # Chunks smaller than, equal to and larger than the groups and problems.
    for chunk_rows in (1, 3, 4, 7, 4096):
        assert found(G.candidate_groups(long, k, limit, chunk_rows)) == groups, chunk_rows
    got = {r.problem_id: r.drop_reason for r in G.problem_outcomes(long, limit).collect()}
    assert got == reasons
    stats = G.grouping_stats(G.nested_outcomes(nested, k, limit)).first()
    same = G.grouping_stats(G.problem_outcomes(long, limit), by_row).first()
    assert stats.asDict() == same.asDict()
    assert stats.total_groups == len(groups) and stats.total_queries == len(reasons)
    assert stats.remaining == sum(r == G.KEPT for r in reasons.values())


def test_problems_in_several_parts(spark):
    rows = make(seed=5, problems=30)
    groups, reasons = wanted(rows, 4, 1.0)
    nested = spark.createDataFrame(rows, SCHEMA)
    long = C.unnest_samples(nested, "problem_id").withColumn("finish_reason", F.lit("stop"))
    parted = C.nest_samples(long, part_rows=9).join(
        nested.select("problem_id", "canonical_id", "prompt"), "problem_id"
    )
    assert parted.agg(F.max("part")).first()[0] > 2
    assert parted.agg(F.max("n_parts")).first()[0] == parted.agg(F.max("part")).first()[0] + 1
    for chunk_rows in (3, 9, 4096):
        made, outcomes = G.candidate_groups_of_parts(parted, chunk_rows=chunk_rows)
        got = {
            (int(r.prompt[1:]), r.group_idx): (r.candidates, r.pass_rates) for r in made.collect()
        }
        assert got == groups
        assert sorted(r.drop_reason for r in outcomes.collect()) == sorted(reasons.values())
    # What works on whole problems only does not take parts for them.
    for refused in (G.candidate_groups_nested(parted, "problem_id"), G.nested_outcomes(parted)):
        with pytest.raises(Exception, match="several rows"):
            refused.collect()
    assert found(G.candidate_groups_nested(parted.where("n_parts = 1"), "problem_id"))


def test_small_example(spark):
    rows = [(0, None, "q", ["a", "b", "c", "d", "e"], [0.0, 1.0, None, 0.5, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(G.candidate_groups_nested(df, "problem_id", group_size=2)) == {
        (0, 0): (["a", "b"], [0.0, 1.0]),
        (0, 1): (["d", "e"], [0.5, 1.0]),
    }


def test_positions(spark):
    long = C.unnest_samples(spark.createDataFrame(make(), SCHEMA), "problem_id")
    for chunk_rows in (3, 4096):
        rows = G.with_positions(long, chunk_rows).orderBy("problem_id", "sample_idx").collect()
        last = {}
        for r in rows:
            assert r.position == last.get(r.problem_id, -1) + 1
            last[r.problem_id] = r.position
            assert r.pass_rate is not None


def test_null_prompt_rows_are_dropped(spark):
    rows = [(0, None, None, ["a"], [1.0]), (1, None, "q", ["a"], [1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.problem_id for r in G.valid_candidates(df).collect()] == [1]


def test_no_problem_kept_gives_empty_stats(spark):
    df = spark.createDataFrame([], SCHEMA)
    r = G.grouping_stats(G.problem_outcomes(C.unnest_samples(df, "problem_id")), df).first()
    assert r.total_queries == 0 and r.groups_per_query == 0 and r.all_correct_pct == 0


def test_nest_and_unnest(spark):
    rows = [(p, i, f"o{i}", "stop", 0.5 if i % 2 else None) for p in (1, 2) for i in range(7 * p)]
    rows.append((3, None, None, None, None))
    long = spark.createDataFrame(
        rows, "problem_id long, sample_idx long, output string, finish_reason string, pass_rate double"
    )
    nested = C.nest_samples(long, part_rows=5)
    shape = {(r.problem_id, r.part): len(r[fx.OUTPUTS]) for r in nested.collect()}
    assert shape == {(1, 0): 5, (1, 1): 2, (2, 0): 5, (2, 1): 5, (2, 2): 4, (3, 0): 0}
    back = C.unnest_samples(nested, "problem_id")
    key = ["problem_id", "sample_idx", "output", "pass_rate"]
    whole = long.where(F.col("sample_idx").isNotNull()).select(key)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
