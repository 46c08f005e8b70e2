import itertools
import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeweave.functions import ranking as R
from gradeweave.functions import short_lists
from gradeweave.operators import scoring

RATES = [1.0, 0.0, 0.5, 1.0]
CASES = [
    ("1, 2, 3, 4", [0, 1, 2, 3], 0.891050481, 0.4, 1.0),
    ("4, 3, 2, 1", [3, 2, 1, 0], 0.920556358, 0.6, 1.0),
    ("<think>1, 2</think> 2, 4, 1, 3", [1, 3, 0, 2], 0.712348095, 0.4, 0.0),
    ("2, 4, 1", None, -1, -1, -1),
    ("no ranking", None, -1, -1, -1),
    ("Best: 3 3 1 2 4 then 12345", [2, 0, 1, 3], 0.802932829, 0.4, 0.0),
    ("5, 0, 3, 1, 4, 2", [2, 0, 3, 1], 0.840648859, 0.6, 0.0),
    ("00002, 1, 3, 4", None, -1, -1, -1),
    ("", None, -1, -1, -1),
    (None, None, -1, -1, -1),
    ("1 2 3 4</think>", None, -1, -1, -1),
    ("0002 1 3 4", [1, 0, 2, 3], None, None, 0.0),
    ("٢, ١, ３, 𝟜", [1, 0, 2, 3], None, None, 0.0),
    ("² 1 3 4", None, -1, -1, -1),
]


def scored(spark, rows, reward=None):
    df = spark.createDataFrame(rows, "i int, response string, ground_truth string")
    return scoring.score_rollouts(df, reward).orderBy("i").collect()


def test_hand_worked_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, r string")
    parsed = df.select("i", R.parse_ranking(F.col("r"), F.lit(4)).alias("x")).orderBy("i").collect()
    assert [r.x for r in parsed] == [c[1] for c in CASES]
    rows = scored(spark, [(i, c[0], str(RATES)) for i, c in enumerate(CASES)])
    for row, (_, _, ndcg, pairs, top1) in zip(rows, CASES):
        if ndcg is not None:
            assert row.ndcg == pytest.approx(ndcg, abs=1e-9)
            assert row.pairacc == pytest.approx(pairs, abs=1e-12)
        assert row.score == row.pairacc
        assert row.top1_acc == top1
    by_struct = scored(spark, [(i, c[0], str(RATES)) for i, c in enumerate(CASES)], R.reward)
    assert by_struct == rows


def test_equal_rates_and_empty_truth(spark):
    rows = scored(
        spark,
        [(0, "2, 1", "[0.5, 0.5]"), (1, "2, 1", "[0.0, 0.0]"), (2, "1", "[]"), (3, "1", "[0.3]")],
    )
    assert [tuple(r)[3:] for r in rows] == [(1.0,) * 4, (1.0,) * 4, (-1.0,) * 4, (1.0,) * 4]


def test_mode_and_pandas_reward(spark):
    rows = [(0, "4, 3, 2, 1", str(RATES))]
    by_ndcg = scored(spark, rows, lambda said, truth: R.reward(said, truth, "ndcg"))
    assert by_ndcg[0].score == by_ndcg[0].ndcg != by_ndcg[0].pairacc

    @F.pandas_udf("struct<score double, length int>")
    def length_reward(said: pd.Series, truth: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"score": said.str.len() / 10.0, "length": said.str.len()})

    assert tuple(scored(spark, rows, length_reward)[0])[3:] == (1.0, 10)


def expected(order, rates, k=None):
    """Definitions worked out by sorting and counting pairs."""
    places = order if k is None else order[:k]
    ideal = sorted(rates, reverse=True)[: len(rates) if k is None else k]
    weight = [1 / math.log2(i + 2) for i in range(max(len(rates), len(order)))]
    got = sum(w * (2 ** rates[c] - 1) for w, c in zip(weight, places) if c < len(rates))
    best = sum(w * (2**r - 1) for w, r in zip(weight, ideal))
    where = {c: i for i, c in reversed(list(enumerate(order)))}
    pairs = [
        where.get(a, len(rates)) < where.get(b, len(rates))
        for a, b in itertools.permutations(range(len(rates)), 2)
        if rates[a] > rates[b]
    ]
    return (
        got / best if best else 1.0,
        sum(pairs) / len(pairs) if pairs else 1.0,
    )


@pytest.mark.parametrize("k", [None, 2])
def test_metrics_against_brute_force(spark, k):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        n = rng.randint(1, 7)
        rates = [rng.choice([0.0, 1 / 3, 0.5, 1.0]) for _ in range(n)]
        order = rng.sample(range(n), n if i % 3 else rng.randint(1, n))
        rows.append((i, order, rates))
    df = spark.createDataFrame(rows, "i int, o array<int>, r array<double>")
    out = df.select(
        "i",
        R.ndcg(F.col("o"), F.col("r"), k).alias("ndcg"),
        R.pairacc(F.col("o"), F.col("r")).alias("pairs"),
    ).orderBy("i")
    for row, (_, order, rates) in zip(out.collect(), rows):
        ndcg, pairs = expected(order, rates, k)
        assert row.ndcg == pytest.approx(ndcg, abs=1e-12)
        assert row.pairs == pytest.approx(pairs, abs=1e-12)


def test_metric_edges(spark):
    df = spark.createDataFrame(
        [(0, [], [1.0]), (1, [0], []), (2, None, [1.0]), (3, [9, 0], [1.0])],
        "i int, o array<int>, r array<double>",
    )
    out = df.select(
        "i",
        R.ndcg(F.col("o"), F.col("r")).alias("n"),
        R.pairacc(F.col("o"), F.col("r")).alias("p"),
        R.top1_acc(F.col("o"), F.col("r")).alias("t"),
    ).orderBy("i").collect()
    assert [tuple(r)[1:] for r in out[:3]] == [(0.0,) * 3, (0.0,) * 3, (None,) * 3]
    assert out[3].n == pytest.approx(1 / math.log2(3)) and out[3].p == 1.0


def test_advantage_and_summary(spark):
    scores = {0: [1.0, 0.0, 0.5], 1: [0.3, 0.3], 2: [-1.0], 3: [0.2 * i for i in range(30)]}
    rows = [(p, i, s) for p, values in scores.items() for i, s in enumerate(values)]
    df = spark.createDataFrame(rows, "p int, i int, score double")
    for chunk_rows in (4096, 4):
        out = scoring.group_advantage(df, "p", "i", chunk_rows=chunk_rows)
        got = {(r.p, r.i): r.advantage for r in out.collect()}
        for p, values in scores.items():
            s = pd.Series(values)
            want = (s - s.mean()) / s.std() if len(s) > 1 and s.nunique() > 1 else s * 0
            for i, w in enumerate(want):
                assert got[p, i] == pytest.approx(w, abs=1e-9)
    sparse = scoring.group_advantage(df.withColumn("i", F.col("i").cast("bigint") * 10**9 - 5), "p", "i")
    assert sparse.count() == len(rows)
    pop = scoring.group_advantage(df, "p", "i", sample_std=False, epsilon=0.5)
    s = pd.Series(scores[0])
    assert pop.where("p = 0 and i = 0").first().advantage == pytest.approx(
        (1.0 - s.mean()) / (s.std(ddof=0) + 0.5)
    )


def test_advantage_moves_rows_once_and_broadcasts_none(spark):
    """Rows made by an explode look few to the optimiser; they must not go through the driver, nor move twice."""
    prompts = spark.range(3000).repartition(4).select(F.col("id").alias("p"), F.expr("sequence(0L, 7L)").alias("all"))
    rows = prompts.select("p", F.explode("all").alias("i")).withColumn("score", F.expr("p * i % 5 / 4D"))
    out = scoring.group_advantage(rows, "p", "i")
    got = {(r.p, r.i): r.advantage for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastExchange" not in plan and "ReusedExchange" in plan
    assert len(got) == 24_000
    s = pd.Series([3 * i % 5 / 4 for i in range(8)])
    assert [got[3, i] for i in range(8)] == pytest.approx(list((s - s.mean()) / s.std()))


def test_advantage_across_chunks_with_odd_scores(spark):
    """Chunks of unlike means and sizes add up to the prompt's; scores and prompts may be null, rows come twice."""
    scores = [1e6 + i for i in range(10)] + [0.0, None, 0.25] + [None] * 4 + [-3.0] * 5
    rows = [(p, i, s) for p in (1, 2, None) for i, s in enumerate(scores)] + [(2, 0, 7.0)]
    rows += [(3, i, None) for i in range(6)] + [(4, 0, 0.5), (4, 5, None), (5, None, 1.0), (5, 9, 0.0)]
    df = spark.createDataFrame(rows, "p int, i int, score double")
    for chunk_rows in (4096, 4):
        out = scoring.group_advantage(df, "p", "i", chunk_rows=chunk_rows)
        assert out.columns == ["p", "i", "score", "advantage"]
        got = out.where("p is not null").collect()
        assert out.count() == len(got) == sum(p is not None for p, _, _ in rows)
        for p in (1, 2, 5):
            mine = [r for r in got if r.p == p and r.score is not None]
            s = pd.Series([r.score for r in mine])
            assert [r.advantage for r in mine] == pytest.approx(list((s - s.mean()) / s.std()), abs=1e-9)
        assert all(r.advantage is None for r in got if r.score is None and r.p != 4)
        assert [r.advantage for r in got if r.p == 4] == [0.0, 0.0]


def test_selection_report(spark):
    df = spark.createDataFrame(
        [("a", [1, 0], [0.0, 1.0]), ("a", None, [0.0, 1.0]), ("a", [0, 1], [0.0, 0.5])],
        "k string, ranking array<int>, pass_rates array<double>",
    )
    r = scoring.selection_report(df, "k").first()
    assert r.n == 3
    assert (r.selected_pass, r.pass_at_1, r.upper_bound) == pytest.approx((1 / 3, 1 / 3, 2 / 3))


def test_pairacc_of_long_lists(spark):
    """Merging counts what counting all pairs does, for ties, odd lengths and left-out candidates."""
    draw = random.Random(4)
    rows = []
    for n in (0, 1, 2, 31, 32, 33, 34, 63, 64, 65, 100, 301):
        for kinds in (1, 3, 50):
            rates = [draw.randrange(kinds) / kinds for _ in range(n)]
            order = draw.sample(range(n), n)
            rows += [(order, rates), (order[: n // 2], rates), (sorted(order, key=lambda i: -rates[i]), rates)]
    got = spark.createDataFrame(rows, "ranking array<int>, rates array<double>").select(
        "ranking", "rates", R.pairacc(F.col("ranking"), F.col("rates")).alias("v")
    )
    for r in got.collect():
        place = {c: i for i, c in enumerate(r.ranking)}
        n, right, total = len(r.rates), 0, 0
        for a in range(n):
            for b in range(n):
                if r.rates[a] > r.rates[b]:
                    total += 1
                    right += place.get(a, n) < place.get(b, n)
        expected = 0.0 if not r.ranking or not n else right / total if total else 1.0
        assert r.v == pytest.approx(expected)


def test_pairacc_of_five_thousand(spark):
    row = spark.range(1).selectExpr("transform(sequence(0, 4999), i -> i * 7 % 5000) r", "transform(sequence(0, 4999), i -> i * 11 % 5003 / 5003D) p")
    score = row.select(R.pairacc(F.col("r"), F.col("p")).alias("v"))
    score.collect()  # compiles
    start = time.perf_counter()
    assert 0 < score.first().v < 1
    assert time.perf_counter() - start < 4  # about one second; counting all pairs takes far more


def test_batches_score_as_columns_do(spark):
    """Usual rows are scored by the batch; long lists, null and odd rates are left to the columns."""
    draw = random.Random(9)
    rows = [(None, [1.0]), ([1], None), ([], []), ([1, 2], [1.0]), ([2, 1], [None, 0.5]), ([1, 2], [math.nan, 1.0])]
    for n in [*range(1, 8)] * 9 + [32, 33, 70]:
        rates = [draw.choice([0.0, 1 / 3, 0.5, 1.0]) for _ in range(n)]
        rows += [(draw.sample(range(1, n + 1), n), rates), (draw.sample(range(1, n + 1), n // 2), rates)]
    df = spark.createDataFrame(rows, "ids array<int>, rates array<double>").repartition(3)
    ids, rates = F.col("ids"), F.col("rates")
    ranked = R.complete(F.when(F.size(rates) > 0, ids), F.size(rates))
    by_columns = [f(ranked, rates) for f in (R.ndcg, R.pairacc, R.top1_acc)]
    out = df.select("ids", "rates", R.metrics(ids, rates).alias("m"), F.struct(*by_columns).alias("c"),
                    short_lists.short_metrics(ids, rates).alias("b")).collect()
    assert len(out) == len(rows)
    for row in out:
        for got, want in zip(row.m, row.c):
            assert got == pytest.approx(want, abs=1e-12, nan_ok=True)
        complete = row.rates and row.ids and len(row.ids) == len(row.rates)
        odd = complete and (len(row.rates) > 32 or any(r is None or r != r for r in row.rates))
        assert (row.b is None) == bool(odd)


def test_scores_of_odd_truths(spark):
    """The reward as a column goes through batches as well, and odd truths score as defined."""
    truths = ["[1.0, null]", "null", "x", "[]", None, str([i / 40 for i in range(40)])]
    said = ["2, 1"] * 5 + [", ".join(map(str, range(40, 0, -1)))]
    rows = [(i, s, t) for i, (s, t) in enumerate(zip(said, truths))]
    for reward in (None, R.reward):
        got = [tuple(r)[3:] for r in scored(spark, rows, reward)]
        assert got[0][1:] == pytest.approx((1 / math.log2(3), 1.0, 1.0))
        assert got[1:5] == [(-1.0,) * 4] * 4
        assert got[5] == pytest.approx((1.0,) * 4)
    wide = scoring.score_rollouts(spark.createDataFrame(rows, "i int, response string, ground_truth string"), R.reward)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
