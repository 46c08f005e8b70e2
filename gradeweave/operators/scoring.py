"""Scores of ranked responses, and their summaries."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking
from .chunks import CHUNK_ROWS, chunk_number

Reward = Callable[[Column, Column], Column]


def score_rollouts(rollouts: DataFrame, reward: Reward | None = None) -> DataFrame:
    """Add the reward's fields to rows with `response` and `ground_truth`.

    `reward` maps the two columns to a struct column; it may be built from columns or be a
    pandas UDF. Without one, the scores are those of `ranking.reward`, made in steps.
    """
    if reward is None:
        known = rollouts.withColumn("_rates", F.from_json("ground_truth", "array<double>"))
        known = known.withColumn("_ids", ranking.named_candidates(F.col("response"), F.size("_rates")))
        known = known.withColumn("_metrics", ranking.metrics(F.col("_ids"), F.col("_rates")))
        return known.select(*rollouts.columns, *ranking.with_failures(F.col("_metrics")))
    scored = rollouts.withColumn("_reward", reward(F.col("response"), F.col("ground_truth")))
    return scored.select(*rollouts.columns, "_reward.*")


def reward_summary(scored: DataFrame, *by: str) -> DataFrame:
    """Mean of each score and share of unreadable responses, per prompt set."""
    means = [F.avg(name).alias(f"mean_{name}") for name in ranking.SCORES]
    failed = F.avg((F.col("score") == ranking.FAILED).cast("double"))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), *means, failed.alias("parse_failure_share")
    )


def group_advantage(
    scored: DataFrame,
    prompt_id: str,
    rollout_idx: str,
    score: str = "score",
    sample_std: bool = True,
    epsilon: float = 0.0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add `advantage`: distance from the prompt's mean score in standard deviations.

    A prompt whose scores are all equal, or that has one rollout, gets 0.
    """
    # Rows move once: both sides read the same shuffle, by (prompt, chunk), so both need the same columns of it.
    rows = scored.where(F.col(prompt_id).isNotNull())
    dealt = rows.repartition(F.col(prompt_id), chunk_number(rollout_idx, chunk_rows))
    dealt = dealt.withColumn("_chunk", chunk_number(rollout_idx, chunk_rows))
    # A row per chunk is made where the chunk is; a prompt's chunks then add up to what the prompt knows.
    chunks = dealt.groupBy(prompt_id, "_chunk").agg(
        F.count(score).alias("_n"),
        F.avg(F.col(score).cast("double")).alias("_mean"),
        F.var_pop(score).alias("_var"),
        F.min(score).alias("_low"),
        F.max(score).alias("_high"),
    )
    whole = Window.partitionBy(prompt_id)
    known = chunks.withColumns({
        "_all": F.sum("_n").over(whole),
        "_at": F.try_divide(F.sum(F.col("_n") * F.col("_mean")).over(whole), F.sum("_n").over(whole)),
        "_flat": F.min("_low").over(whole) == F.max("_high").over(whole),
    })
    squares = F.sum(F.col("_n") * (F.col("_var") + F.pow(F.col("_mean") - F.col("_at"), 2))).over(whole)
    var = F.try_divide(squares, F.col("_all") - (1 if sample_std else 0))
    stats = known.select(
        prompt_id, "_chunk", F.col("_at").alias("_mean"), F.coalesce(F.sqrt(var), F.lit(0.0)).alias("_std"), "_flat"
    )
    # Sizes are guessed as if each array's items were one row: unhinted, the rows may be broadcast.
    joined = dealt.join(stats.hint("merge"), [prompt_id, "_chunk"]).drop("_chunk")
    advantage = F.when(F.col("_flat"), 0.0).otherwise(
        F.try_divide(F.col(score) - F.col("_mean"), F.col("_std") + F.lit(epsilon))
    )
    return joined.withColumn("advantage", advantage).drop("_mean", "_std", "_flat")


def selection_report(ranked: DataFrame, *by: str) -> DataFrame:
    """Per group of columns: how often the first choice passes, and what bounds it.

    ranked: (ranking, pass_rates). A null ranking chose nothing, so it did not pass.
    `pass_at_1` is the mean share of passing candidates, `upper_bound` the share of rows
    with any passing candidate.
    """
    rates = F.col("pass_rates")
    chosen = F.get(rates, F.get(F.col("ranking"), F.lit(0))) == 1.0
    passing = F.size(F.filter(rates, lambda r: r == 1.0))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce(chosen, F.lit(False)).cast("double")).alias("selected_pass"),
        F.avg(F.try_divide(passing.cast("double"), F.size(rates).cast("double"))).alias("pass_at_1"),
        F.avg(F.coalesce(F.array_max(rates) == 1.0, F.lit(False)).cast("double")).alias(
            "upper_bound"
        ),
    )
