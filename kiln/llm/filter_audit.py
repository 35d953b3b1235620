"""What filters do to each other in every order: counts on the edges of the lattice of applied subsets.

The state of a document before a filter depends only on which filters went before, not on their order. So 5 filters have
5 * 16 = 80 edges (already-applied subset, next filter) where 120 orders have 600 steps: documents are counted by the set
of filters that they fail, these classes contribute to the edges, and a step of an order looks up its edge.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D over a text that is not null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", F.lit("")))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failed(df: DataFrame, conditions: Mapping[str, Column], part: Column, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, part, digest, fails): fails has a bit for each condition. Texts are read here and nowhere else."""
    text = C.null_safe_text(F.col(text_col))
    bits = [F.when(condition, 1 << i).otherwise(0) for i, condition in enumerate(conditions.values())]
    return df.select(
        F.col(id_col).alias("doc_id"),
        part.alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        sum(bits, F.lit(0)).alias("fails"),
    )


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """(doc_id, part, fails, n): rows are counted, and fails has the bit where a smaller id has the same text.

    Equal rows are one before they travel. Least ids of repeated texts meet the rows by (digest, salt), so a text that a
    third of all rows has is in many tasks.
    """
    alike = rows.groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = least.where("least < most").select("digest", "least")
    met = C.spread_join(alike, least, "digest", "doc_id", how="left")
    copied = F.when(F.col("doc_id") > F.col("least"), 1 << bit).otherwise(0)
    return met.select("doc_id", "part", (F.col("fails") + copied).alias("fails"), "n")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): the classes of documents, of which there are parts * 2^filters * 4 at most."""
    rows = rows.groupBy("doc_id", "part", "fails").agg(F.sum("n").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    met = rows.join(known, "doc_id", "left").select("part", "fails", flag("good"), flag("toxic"), "n")
    return met.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(classes: DataFrame, names: Sequence[str]) -> DataFrame:
    """(part, applied, filter, the counts, shapley) for every edge of the lattice and every part, zeros included."""
    m = len(names)
    lattice = [(applied, f) for f in range(m) for applied in range(1 << m) if not applied >> f & 1]
    # an edge of k applied filters lies on k! * (m - 1 - k)! orders
    paths = [factorial(a.bit_count()) * factorial(m - 1 - a.bit_count()) for a, _ in lattice]
    edge = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("applied"), F.lit(f).alias("filter"), F.lit(p).alias("paths"))
                for (a, f), p in zip(lattice, paths)
            ]
        )
    )
    each = classes.select("*", edge.alias("edge")).select("part", "fails", "good", "toxic", "n", "edge.*")
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    there = F.col("fails").bitwiseAND(F.col("applied")) == 0
    fails = F.col("fails").bitwiseAND(bit) != 0
    total = lambda condition, name: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)
    counted = each.groupBy("part", "applied", "filter", "paths").agg(
        total(there & ~fails, "kept"),
        total(there & fails, "removed"),
        total(~there & fails, "redundant"),
        total(F.col("fails") == bit, "unique_fails"),
        total(there & fails & F.col("good"), "good_lost"),
        total(there & fails & F.col("toxic"), "toxic_lost"),
    )
    shares = counted.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    return counted.drop("paths").join(shares, ["part", "filter"])


def order_steps(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(filter_order, step, applied, filter): every order of the filters as a path through the lattice. m! * m rows."""
    rows = []
    for order in permutations(range(len(names))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit(
    df: DataFrame,
    labels: DataFrame,
    conditions: Mapping[str, Column] | None = None,
    copies: str | None = "E",
    part_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """part, filter_order, step and kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each
    part, order of the filters and step.

    conditions: failure conditions by one-letter name, Columns over df; by default A to D over the text. copies: name of
    the filter that fails copies of a smaller id's text, table-wide, or None. Up to six filters in all. labels: doc_id,
    quality, toxic; a document of which some label row says 1 is good or toxic, one without a row neither.

    Null text: empty. Null part: the empty string. Null id: without labels, neither a copy nor an original. Repeated rows
    count as often as they occur, and are no copies of each other. Very long texts are read whole, once. Empty table: no
    parts, so no rows. Other columns of df and labels may have any names.
    """
    if conditions is None:
        conditions = text_filters(C.null_safe_text(F.col(text_col)))
    names = [*conditions, *([copies] if copies else [])]
    if len(names) > 6 or any(len(name) != 1 for name in names) or len({*names}) < len(names):
        raise ValueError("up to six filters, named by one letter each")
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = C.materialise(failed(df, conditions, part, id_col, text_col), "failed")
    if copies:
        rows = with_copies(rows, len(conditions))
    else:
        rows = rows.groupBy("doc_id", "part", "fails").agg(F.count("*").alias("n"))
    found = edges(labelled(rows, labels.select("doc_id", "quality", "toxic")), names)
    # the steps are at most 6! * 6 rows of four small columns
    steps = F.broadcast(order_steps(df.sparkSession, names))
    return found.join(steps, ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
