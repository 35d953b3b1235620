"""Checkpoints in the folder that a cluster shares, and running numbers over a whole table without one task that sees it all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a folder of our own takes its place where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = f"file://{tempfile.mkdtemp(prefix='kiln-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder; its partitions stay as they are."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class Tables:
    """Tables in the shared folder, for loops: a table's plan is its scan alone, while a checkpoint keeps what the optimizer
    has inferred on the way, which grows from turn to turn.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/kiln-table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[path] = out
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Deletes all tables but those."""
        for path in [p for p, df in self.held.items() if not any(df is k for k in kept)]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
            del self.held[path]


def running(df: DataFrame, order: list, sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds i, from 0 in the given order, and running sums up to and with each row.

    Rows are dealt to ranges of the whole order (so ties of the first column do not meet in one), numbered and added up
    within their range, and moved on by the totals of the ranges before, which are one row a range. Null keys count.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = {name: F.coalesce(c, F.lit(0)) for name, c in (sums or {}).items()}
    own = cut(df.repartitionByRange(parts, *order).withColumns(sums | {"_p": F.spark_partition_id()}))
    totals = own.groupBy("_p").agg(F.count("*").alias("_i"), *[F.sum(n).alias(f"_s_{n}") for n in sums])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select("_p", upto("_i").alias("_i"), *[upto(f"_s_{n}").alias(f"_s_{n}") for n in sums])
    within = Window.partitionBy("_p").orderBy(*order)
    here = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = own.withColumns({"_k": F.row_number().over(within) - 1} | {f"_t_{n}": F.sum(n).over(here) for n in sums})
    placed = placed.join(F.broadcast(offsets), "_p")  # `parts` rows
    columns = {"i": (F.col("_i") + F.col("_k")).cast("long")} | {n: F.col(f"_s_{n}") + F.col(f"_t_{n}") for n in sums}
    return placed.withColumns(columns).drop("_p", "_k", "_i", *[f"_{x}_{n}" for x in "st" for n in sums])
