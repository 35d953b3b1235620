"""Best-of-n, preference pairs, reward statistics and the processors that a name selects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_of_n(df: DataFrame, key: str, reward: str, pos: str) -> DataFrame:
    """The row of each key with the largest reward; ties go to the first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(reward), pos))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def chosen_rejected(df: DataFrame, key: str, output: str, reward: str, pos: str) -> DataFrame:
    """Best and worst output of each key, the first of ties; one sample is both. One aggregation, no sort."""
    best = F.max_by(F.struct(output, reward), F.struct(reward, (-F.col(pos)).alias("e")))
    worst = F.min_by(F.struct(output, reward), F.struct(reward, F.col(pos).alias("e")))
    out = df.groupBy(key).agg(best.alias("b"), worst.alias("w"))
    return out.select(
        F.col(key).alias("prompt"),
        F.col(f"b.{output}").alias("chosen"),
        F.col(f"b.{reward}").alias("chosen_reward"),
        F.col(f"w.{output}").alias("rejected"),
        F.col(f"w.{reward}").alias("rejected_reward"),
    )


def reward_stats(df: DataFrame, reward: str) -> DataFrame:
    return df.agg(F.avg(reward).alias("mean"), F.stddev_samp(reward).alias("std"))


def normalised(df: DataFrame, reward: str) -> DataFrame:
    """reward as a z-score over the whole table, by the sample's standard deviation. The statistics are one row."""
    return df.crossJoin(F.broadcast(reward_stats(df, reward))).withColumn(
        reward, F.try_divide(F.col(reward) - F.col("mean"), F.col("std"))
    ).drop("mean", "std")


def conditioned(df: DataFrame, text: str, reward: str, pattern: str) -> DataFrame:
    """pattern with {reward} (two decimals) and {input} filled in."""
    r = F.format_string("%.2f", F.round(F.col(reward).cast("decimal(20,6)"), 2).cast("double"))
    return df.withColumn(
        text, F.replace(F.replace(F.lit(pattern), F.lit("{reward}"), r), F.lit("{input}"), F.col(text))
    )


def rotated(df: DataFrame, batch: str, pos: str, output: str) -> DataFrame:
    """For each row the next row's output in its batch, the last row's being the first's: mismatched pairs."""
    w = Window.partitionBy(batch).orderBy(pos)
    return df.withColumn("mismatched", F.coalesce(F.lead(output).over(w), F.first(output).over(w)))


PROCESSORS = {"rs": best_of_n, "csft": conditioned, "iter_dpo": chosen_rejected}


def processor(name: str):
    if name not in PROCESSORS:
        raise ValueError(f"unknown processor {name}")
    return PROCESSORS[name]
