"""Accuracy, votes, pass rates and report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(graded: DataFrame, *by: str) -> DataFrame:
    out = graded.groupBy(*by).agg(F.sum(F.col("correct").cast("long")).alias("correct"), F.count("*").alias("total"))
    return out.select(
        *by,
        F.coalesce("correct", F.lit(0)).alias("correct"),
        "total",
        F.round(F.coalesce(F.try_divide(F.col("correct"), F.col("total")), F.lit(0.0)), 6).alias("accuracy"),
    )


def avg_at_n(graded: DataFrame, problem: str, *by: str) -> DataFrame:
    """Mean over problems of each problem's mean; any_correct counts problems with a right sample."""
    each = graded.groupBy(*by, problem).agg(
        F.avg(F.col("correct").cast("double")).alias("a"), F.max(F.col("correct").cast("long")).alias("any")
    )
    return each.groupBy(*by).agg(
        F.count("*").alias("total"), F.sum("any").alias("any_correct"), F.round(F.avg("a"), 6).alias("avg_accuracy")
    )


def majority_vote(votes: DataFrame, key: str, answer: str, pos: str) -> DataFrame:
    """Each key's most frequent answer; ties go to the one seen first."""
    counts = votes.groupBy(key, answer).agg(F.count("*").alias("votes"), F.min(pos).alias("seen"))
    return counts.groupBy(key).agg(
        F.max_by(F.struct(answer, "votes"), F.struct("votes", (-F.col("seen")).alias("early"))).alias("b")
    ).select(key, f"b.{answer}", "b.votes")


def pass_at_k(scored: DataFrame, prompt: str, source: str, reward: str) -> DataFrame:
    each = scored.groupBy(source, prompt).agg(F.max(reward).alias("best"), F.avg(reward).alias("mean"))
    return each.groupBy(source).agg(
        F.round(F.avg("best"), 6).alias("pass_n"), F.round(F.avg("mean"), 6).alias("pass_1")
    )


def accuracy_pivot(results: DataFrame, row: str, column: str, values: list[str], score: str) -> DataFrame:
    """Percent with one decimal by row and column; -- where there is none."""
    wide = results.groupBy(row).pivot(column, values).agg(F.avg(score))
    return wide.select(row, *[F.when(F.col(f"`{v}`").isNull(), F.lit("--")).otherwise(F.format_string("%.1f", F.round(F.col(f"`{v}`") * 100, 1))).alias(f"c{i}") for i, v in enumerate(values)])


def result_line(ok, idx, gt, pred):
    return F.concat(
        F.lit("["),
        F.when(ok, "O").otherwise("X"),
        F.lit("] #"),
        F.lpad(idx.cast("string"), 3, " "),
        F.lit("  gt="),
        gt,
        F.lit("  pred="),
        pred,
    )


def histogram(values: DataFrame, x: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """(by, bin, n, density); values outside [low, high] are dropped, the last bin is closed; densities are a class's own."""
    width = (high - low) / bins
    own = values.filter(F.col(x).between(low, high)).withColumn(
        "bin", F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)).cast("long")
    )
    counts = own.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.round(F.col("n") / (F.sum("n").over(Window.partitionBy(*by)) * width), 6))
