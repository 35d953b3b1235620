"""Exact order statistics of classes of any size, by refining histograms: no task holds a class's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.lineage import Tables

#: Bounds of a histogram, and values of a range that are sorted in one task.
CUTS, FEW = 200, 4096


def same(keys: list[str]) -> list:
    """Join conditions of x and y on keys that may be null."""
    return [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys] or [F.lit(True)]


def medians(df: DataFrame, by: list[str], value: str, few: int = FEW) -> DataFrame:
    """(by, median) as doubles; null for a class without values. Nulls of value do not count.

    Of an even number the two middle ones are selected and averaged. Each rank has a range of values that holds it. A range
    of more than `few` values is cut at two quantiles of a mergeable sketch, around the rank; counting what lies below, at,
    between and above them gives the next range, which is exact whatever the sketch's error. A range of one value is done.
    """
    own = df.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    tables = Tables(df.sparkSession)
    classes = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    state = tables.put(
        classes.select(*by, "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.explode(ranks).alias("rank"))
    )
    keys = [*by, "rank"]
    inside = lambda s: own.alias("x").join(s.alias("y"), same(by)).where("v >= lo AND v <= hi")
    while not (wide := state.where((F.col("inside") > few) & (F.col("lo") < F.col("hi")))).isEmpty():
        cuts = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
        sketch = inside(wide).groupBy(*[F.col(f"y.{k}").alias(k) for k in keys]).agg(F.percentile_approx("v", cuts, CUTS * 10).alias("cuts"))
        at = F.floor((F.col("x.rank") - F.col("below")) / F.col("inside") * CUTS).cast("int")
        pick = lambda i: F.get("cuts", F.least(F.greatest(i, F.lit(0)), F.lit(CUTS)))
        tried = wide.alias("x").join(sketch.alias("y"), same(keys)).select(
            *[F.col(f"x.{k}").alias(k) for k in keys], "lo", "hi", "below", "inside", pick(at - 1).alias("a"), pick(at + 2).alias("b")
        )
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        parts = [v < a, v == a, (v > a) & (v < b), (v == b) & (v > a), v > b]
        told = inside(tried).groupBy(*[F.col(f"y.{k}").alias(k) for k in [*keys, "below"]]).agg(
            *[F.count_if(p).alias(f"n{i}") for i, p in enumerate(parts)],
            *[F.min(F.when(p, v)).alias(f"lo{i}") for i, p in enumerate(parts)],
            *[F.max(F.when(p, v)).alias(f"hi{i}") for i, p in enumerate(parts)],
        )
        before = [sum((F.col(f"n{j}") for j in range(i)), F.lit(0)) for i in range(len(parts))]
        place = F.col("rank") - F.col("below")
        options = F.array(
            *[
                F.struct(
                    before[i].alias("before"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.col(f"n{i}").alias("inside")
                )
                for i in range(len(parts))
            ]
        )
        held = F.get(F.filter(options, lambda o: (place >= o.before) & (place < o.before + o.inside)), F.lit(0))
        nxt = told.withColumn("o", held).select(
            *keys, "o.lo", "o.hi", (F.col("below") + F.col("o.before")).cast("long").alias("below"), "o.inside"
        )
        done = state.where((F.col("inside") <= few) | (F.col("lo") >= F.col("hi")))
        state = tables.put(done.select(*keys, "lo", "hi", "below", "inside").unionByName(nxt.select(*keys, "lo", "hi", "below", "inside")))
    small = inside(state.where((F.col("lo") < F.col("hi")))).groupBy(*[F.col(f"y.{k}").alias(k) for k in [*keys, "below"]])
    found = small.agg(F.sort_array(F.collect_list("v")).alias("vs")).select(
        *by, F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v")
    )
    out = tables.put(found.unionByName(state.where(F.col("lo") >= F.col("hi")).select(*by, F.col("lo").alias("v"))))
    tables.drop(out)
    chosen = out.groupBy(*by).agg(F.avg("v").alias("median"))
    every = df.select(*by).distinct()
    return every.alias("x").join(chosen.alias("y"), same(by), "left").select(*[F.col(f"x.{k}").alias(k) for k in by], "median")
