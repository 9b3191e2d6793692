"""Scores of reasoning completions and the choice of problems by difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import thought_and_answer


def rewards(df: DataFrame, completion: str, truth: str) -> DataFrame:
    """Adds thought, final_answer, r_format, r_accuracy, r_concise, r_length and reward; a null completion counts as empty, a null truth never matches."""
    text = F.coalesce(F.col(completion), F.lit(""))
    thought, answer = thought_and_answer(text)
    df = df.withColumn("thought", thought).withColumn("final_answer", answer)
    answered = F.coalesce(F.col("final_answer") != "", F.lit(False))
    right = answered & F.coalesce(F.contains(F.lower("final_answer"), F.lower(F.col(truth))), F.lit(False))
    wordy = answered & F.coalesce(F.col("thought") != "", F.lit(False)) & (F.length("thought") / F.greatest(F.length("final_answer"), F.lit(1)) > 10.0)
    df = df.withColumns({
        "r_format": F.when(F.col("thought").isNull(), 0.0).when(answered, 1.0).otherwise(0.5),
        "r_accuracy": F.when(right, 2.0).otherwise(0.0),
        "r_concise": F.when(wordy, -0.5).otherwise(0.0),
        "r_length": F.length(text) * -0.0001,
    })
    return df.withColumn("reward", F.col("r_format") + F.col("r_accuracy") + F.col("r_concise") + F.col("r_length"))


def pass_rate(c: Column) -> Column:
    """Number from text; null for anything else, not-a-number included."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def in_band(df: DataFrame, rate: Column, low: float = 0.10, high: float = 0.90) -> DataFrame:
    return df.withColumn("rate", rate).where(F.col("rate").between(low, high))


def advantages(df: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """Rewards relative to their group: mean removed, divided by the sample deviation. Null for a group of one.

    Group statistics are aggregated first and joined back, so that no group has to fit a task.
    """
    stats = df.groupBy(group).agg(F.avg(reward).alias("group_mean"), F.stddev_samp(reward).alias("group_std"), F.count(F.lit(1)).alias("group_size"))
    return df.join(stats, group).withColumn("advantage", (F.col(reward) - F.col("group_mean")) / (F.col("group_std") + 1e-8))


def easiest_first(df: DataFrame, rate: str, order: str, size: int) -> DataFrame:
    """Rounds of ``size`` problems in stream order, each sorted from the highest pass rate down."""
    place = F.row_number().over(Window.partitionBy("round").orderBy(F.desc(rate), order))
    return df.withColumn("round", F.floor(F.col("nth") / size)).withColumn("place", place)


def clipped(ratio: Column, advantage: Column, width: float = 0.2) -> Column:
    return F.least(ratio * advantage, F.greatest(F.least(ratio, F.lit(1 + width)), F.lit(1 - width)) * advantage)
