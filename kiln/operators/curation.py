"""Filters with a funnel, routed sinks, resume, capped seeds, translation round trips, blending."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.operators.lineage import running


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(stage, kept, removed) of filters applied in turn, in one pass over the data."""
    so_far, sums = F.lit(True), [F.count("*").alias("n0")]
    for i, keep in enumerate(stages.values()):
        so_far = so_far & F.coalesce(keep, F.lit(False))
        sums.append(F.coalesce(F.sum(so_far.cast("long")), F.lit(0)).alias(f"n{i + 1}"))
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(name).alias("stage"), F.col(f"n{i + 1}").alias("kept"), (F.col(f"n{i}") - F.col(f"n{i + 1}")).alias("removed")) for i, name in enumerate(stages)]))
    return df.agg(*sums).select(rows.alias("r")).select("r.*")


def capped(df: DataFrame, source: str, order: str, most: int) -> DataFrame:
    """The first rows of each source; -1 takes all."""
    if most < 0:
        return df
    return df.withColumn(
        "_r", F.row_number().over(Window.partitionBy(source).orderBy(order))
    ).filter(F.col("_r") <= most).drop("_r")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not processed yet: resume by key, so rows that were skipped do not shift the rest."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def write_routed(df: DataFrame, verdict: str, path: str) -> None:
    """One write, a folder for each verdict."""
    df.write.mode("overwrite").partitionBy(verdict).json(path, ignoreNullFields=False)


def translated(df: DataFrame, key: str, fields: list[str], needs, provider) -> DataFrame:
    """Cells that need it go through provider (Column -> Column) and back to their row and field; an empty result keeps the cell."""
    return df.withColumns(
        {
            f: F.when(
                needs(F.col(f)), F.coalesce(F.nullif(provider(F.col(f)), F.lit("")), F.col(f))
            ).otherwise(F.col(f))
            for f in fields
        }
    )


def source_draws(spark: SparkSession, shares: list[float], total: int, seed: int) -> DataFrame:
    """(n, source_idx) of the first `total` draws: hashes of the row number, so reruns and longer draws agree."""
    edges = list(accumulate(shares))
    u = F.pmod(F.xxhash64("n", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * edges[-1]
    pick = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        pick = F.when(u < edges[i], i).otherwise(pick)
    return spark.range(total).withColumnRenamed("id", "n").withColumn("source_idx", pick.cast("int"))


def ranked_draws(draws: DataFrame, sources: int) -> DataFrame:
    """Adds k: how often the row's source was drawn before it."""
    picks = {f"k{i}": (F.col("source_idx") == i).cast("long") for i in range(sources)}
    out = running(draws, ["n"], picks)
    return out.withColumn("k", F.get(F.array(*picks), F.col("source_idx")) - 1).drop("i", *picks)


def drawn_rows(draws: DataFrame, parts: list[DataFrame], sizes: list[int], key: str) -> DataFrame:
    """The rows that draws (n, source_idx, k) stand for: the k-th of a source, in order of key, starting again when used up."""
    rows = None
    for i, df in enumerate(parts):
        own = running(df, [key]).withColumnRenamed("i", "place").withColumn("source_idx", F.lit(i))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    of = F.get(F.array(*[F.lit(n).cast("long") for n in sizes]), F.col("source_idx"))
    return draws.withColumn("place", F.col("k") % of).drop("k").join(rows, ["source_idx", "place"]).drop("place")


def with_rows(parts: list[tuple[DataFrame, float]]) -> tuple[list[DataFrame], list[float], list[int]]:
    """Sources that have rows, their shares and sizes; empty ones take no part."""
    sized = [(df, p, df.count()) for df, p in parts]
    kept = [x for x in sized if x[2]]
    if not kept:
        return [sized[0][0]], [1.0], [0]
    return [x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept]


def interleave(
    parts: list[tuple[DataFrame, float]], key: str, total: int, seed: int = 0, oversample: bool = True
) -> DataFrame:
    """`total` rows drawn source by source with given probabilities; a source starts again when it is used up (oversample)
    or the draw ends with it. Draws are hashes of the row number, so reruns agree.
    """
    spark = parts[0][0].sparkSession
    sources, shares, sizes = with_rows(parts)
    draws = ranked_draws(source_draws(spark, shares, total if sum(sizes) else 0, seed), len(sources))
    if not oversample:
        draws = draws.where(F.col("n") < used_up(draws, sizes, min))
    return drawn_rows(draws, sources, sizes, key)


def used_up(draws: DataFrame, sizes: list[int], of) -> int:
    """Draws until sources are used up: with the first one (of=min) or with the last (of=max). One row a source is looked at."""
    size = F.get(F.array(*[F.lit(n).cast("long") for n in sizes]), F.col("source_idx"))
    ends = draws.where(F.col("k") == size - 1).groupBy("source_idx").agg(F.min("n").alias("n")).collect()
    return of((r.n for r in ends), default=(1 << 62) - 1) + 1


def interleave_until(parts: list[tuple[DataFrame, float]], key: str, mode: str = "first_exhausted", seed: int = 0) -> DataFrame:
    """Rows drawn source by source until the first source is used up ("first_exhausted"), or each has been, those that were
    starting again ("all_exhausted"). The row that uses it up is the last. Sources without rows take no part.

    The number of draws is not known before: as many are made as should do by the shares, and half as many again while they
    do not; draws are hashes of their number, so longer ones begin alike. Running counts on ranges give the last one.
    """
    if mode not in ("first_exhausted", "all_exhausted"):
        raise ValueError(mode)
    spark = parts[0][0].sparkSession
    sources, shares, sizes = with_rows(parts)
    of = min if mode == "first_exhausted" else max
    whole = sum(shares)
    total = int(of(n * whole / p for n, p in zip(sizes, shares)) * 1.05) + 64 if sum(sizes) else 0
    while True:
        draws = source_draws(spark, shares, total, seed)
        counts = {r.source_idx: r["count"] for r in draws.groupBy("source_idx").count().collect()}  # a row a source
        done = [counts.get(i, 0) >= n for i, n in enumerate(sizes)]
        if (any if of is min else all)(done):
            break
        total += total // 2
    draws = ranked_draws(draws, len(sources))
    stop = used_up(draws, sizes, of) if total else 0
    return drawn_rows(draws.where(F.col("n") < stop), sources, sizes, key)


def weighted_choice(
    df: DataFrame, key: str, options: dict[str, float], exclude: str | None = None, seed: int = 0
) -> DataFrame:
    """Adds `choice`: an option drawn by a hash of the key, weights renormalised without the excluded one."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    gone = F.col(exclude) if exclude else F.lit(None).cast("string")
    share = {name: F.when(gone == name, 0.0).otherwise(F.lit(w)) for name, w in options.items()}
    total, upto, choice, names = sum(share.values(), F.lit(0.0)), F.lit(0.0), None, list(options)
    for name in names:
        upto = upto + share[name]
        hit = u * total < upto
        choice = F.when(hit, name) if choice is None else choice.when(hit, name)
    return df.withColumn("choice", choice)


def slice_rows(numbered: DataFrame, i: str, start: int, stop: int) -> DataFrame:
    return numbered.filter((F.col(i) >= start) & (F.col(i) < stop))
