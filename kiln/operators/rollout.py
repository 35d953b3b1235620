"""Group baselines, advantages, reward shaping and filtering of rollouts. Groups are prompts: one shuffle each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_baselines(df: DataFrame, group: str, r: str) -> DataFrame:
    """Adds rloo, centred, normed (null std gives null) and group_std, all from one window."""
    w = Window.partitionBy(group)
    x, n, s = F.col(r), F.count(r).over(w), F.sum(r).over(w)
    sd = F.stddev_samp(r).over(w)
    return df.withColumn("rloo", x - F.try_divide(s - x, n - 1)).withColumn("centred", x - F.avg(r).over(w)).withColumn(
        "normed", (x - F.avg(r).over(w)) / (sd + 1e-9)
    ).withColumn("group_std", sd)


def dynamic_filter(df: DataFrame, group: str, score: str, low: float, high: float) -> DataFrame:
    """Rows of groups whose mean score lies strictly between low and high; a group with a null score stays out of the test and is kept."""
    w = Window.partitionBy(group)
    mean, nulls = F.avg(score).over(w), F.sum(F.col(score).isNull().cast("int")).over(w)
    return df.withColumn("_m", mean).withColumn("_n", nulls).filter(
        (F.col("_n") > 0) | ((F.col("_m") > low) & (F.col("_m") < high))
    ).drop("_m", "_n")


def first_accepted(df: DataFrame, group: str, n: int) -> DataFrame:
    """The first n groups, by key; none if there are fewer."""
    groups = df.select(group).distinct().orderBy(group).limit(n)  # n rows
    found = groups.agg(F.count("*").alias("_c"))
    enough = groups.join(F.broadcast(found)).filter(F.col("_c") == n).select(group)
    return df.join(enough, group, "left_semi")


def whitened(df: DataFrame, a: str, mask: str) -> DataFrame:
    """a less its masked mean, over its masked deviation (biased, at least 1e-8 squared)."""
    own = F.when(F.col(mask).cast("boolean"), F.col(a).cast("double"))
    stats = df.agg(F.avg(own).alias("_m"), F.var_pop(own).alias("_v"))
    return df.crossJoin(F.broadcast(stats)).withColumn(  # one row
        a, (F.col(a) - F.col("_m")) / F.sqrt(F.greatest(F.col("_v"), F.lit(1e-8)))
    ).drop("_m", "_v")


def overlong(reward: Column, length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    over = F.least(length - (most - buffer), F.lit(buffer))
    return F.when(over > 0, reward - over / buffer * factor).otherwise(reward)


def stop_properly(reward: Column, truncated: Column, coefficient: float) -> Column:
    return F.when(truncated, reward * coefficient).otherwise(reward)


def terminal_reward(mask: Column, reward: Column, kl: Column, beta: float) -> Column:
    """-beta kl at every place, and the reward at the last place whose mask is set."""
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m, i).otherwise(-1)))
    return F.transform(kl, lambda k, i: -max(beta, 0.0) * k + F.when(i == last, reward).otherwise(0.0))


def kl_coefficient(
    steps: DataFrame, run: str, order: str, kl: str, n: str, start: float, target: float, horizon: float
) -> DataFrame:
    """The adaptive coefficient after each step of a training run: a running product of 1 + clip(kl/target - 1, +-0.2) n / horizon."""
    error = F.least(F.greatest(F.col(kl) / target - 1, F.lit(-0.2)), F.lit(0.2))
    factor = F.ln(1 + error * F.col(n) / horizon)
    return steps.withColumn(
        "coefficient",
        start
        * F.exp(F.sum(factor).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))),
    )


def batch_means(df: DataFrame, batch: str, metrics: list[str]) -> DataFrame:
    """Unweighted means of the batches' means: what a step reports."""
    each = df.groupBy(batch).agg(*[F.avg(m).alias(m) for m in metrics])
    return each.agg(*[F.avg(m).alias(m) for m in metrics])


def length_weighted(df: DataFrame, value: str, length: str) -> DataFrame:
    return df.agg(F.try_divide(F.sum(F.col(value) * F.col(length)), F.sum(length)).alias(value))


def latest(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The last `limit` rows: a buffer that drops its oldest."""
    return df.orderBy(F.desc(order)).limit(limit)


def with_padding(df: DataFrame, i: str, total: int, multiple: int) -> DataFrame:
    """df and as many null rows as make its length a multiple; padding tells which they are."""
    missing = -total % multiple
    pad = df.sparkSession.range(missing).select((F.col("id") + total).alias(i), F.lit(True).alias("padding"))
    return df.withColumn("padding", F.lit(False)).unionByName(pad, allowMissingColumns=True)
