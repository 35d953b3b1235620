"""Named queries, and how they read their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def with_pos(s, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return t(s, d, "lineitem").withColumn("pos", F.row_number().over(w))


def preference_rows(s, d) -> DataFrame:
    prices = [
        (-F.col("l_quantity") / 10).alias("pc"),
        (-F.col("l_discount") * 30).alias("pr"),
        (-F.col("l_tax") * 40).alias("rc"),
    ]
    return with_pos(s, d).select(
        "l_orderkey",
        "pos",
        *prices,
        (-F.col("l_linenumber") / 2.0).alias("rr"),
        (F.col("l_returnflag") == "R").alias("y"),
    )
