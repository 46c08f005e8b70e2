"""Rewards are stateless columns, so a stream is scored by the batch operator itself."""

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.scoring import Reward, score_rollouts


def score_arriving_rollouts(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    target: str,
    checkpoint: str,
    reward: Reward | None = None,
) -> StreamingQuery:
    """Score the Parquet files that appear in `source`; stop when none are left."""
    arriving = spark.readStream.schema(schema).parquet(source)
    return (
        score_rollouts(arriving, reward)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
