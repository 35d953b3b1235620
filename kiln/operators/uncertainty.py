"""Semantic entropy of sampled answers, and how well it tells wrong from right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.selection import medians, same

from kiln.operators.lineage import running

LONGEST, MOST_NULLS = 200, 2


def valid(slp: bool = True) -> Column:
    own = F.col("boxed").isNotNull() & (F.length("boxed") <= LONGEST)
    return own & F.col("slp").isNotNull() if slp else own


def weighted_entropy(responses: DataFrame, places: int = 4) -> DataFrame:
    """(prompt, se, se_weight, se_raw, n_valid) from (prompt, boxed, slp, len): answers weighed by length-normalised likelihood.

    Equal answers are one cluster. A prompt with more than MOST_NULLS null answers or fewer than two valid ones keeps its
    row with nulls and 0. One shuffle by prompt serves the counts, the softmax and both sums.
    """
    by = Window.partitionBy("prompt")
    rows = responses.withColumn("ok", F.coalesce(valid(), F.lit(False))).withColumn(
        "x", F.when(F.col("ok"), F.col("slp") / F.greatest("len", F.lit(1)))
    )
    rows = rows.withColumn(
        "nulls", F.sum(F.col("boxed").isNull().cast("int")).over(by)
    ).withColumn("n", F.sum(F.col("ok").cast("int")).over(by)).withColumn("top", F.max("x").over(by))
    rows = rows.withColumn("used", F.col("ok") & (F.col("nulls") <= MOST_NULLS) & (F.col("n") >= 2)).withColumn(
        "w", F.when(F.col("used"), F.exp(F.col("x") - F.col("top"))).otherwise(0.0)
    )
    clusters = rows.groupBy("prompt", F.when(F.col("used"), F.col("boxed")).alias("cluster")).agg(
        F.sum("w").alias("w"), F.max(F.when(F.col("used"), F.col("n"))).alias("n")
    )
    total = F.sum("w").over(by)
    clusters = clusters.withColumn("p", F.when(F.col("cluster").isNotNull(), F.col("w") / F.nullif(total, F.lit(0.0))))
    raw = clusters.groupBy("prompt").agg(
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).when(F.col("p") == 0, 0.0))).alias("raw"),
        F.max("n").alias("n"),
    )
    se = F.round((F.col("raw") / F.ln("n")).cast("decimal(20,10)"), places).cast("double")
    return raw.select(
        "prompt",
        se.alias("se"),
        F.round((1 - se).cast("decimal(20,10)"), places).cast("double").alias("se_weight"),
        F.round(F.col("raw").cast("decimal(20,10)"), places).cast("double").alias("se_raw"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_valid"),
    )


def count_entropy(responses: DataFrame) -> DataFrame:
    """(prompt, se, n_valid): entropy of the clusters' shares by count, over ln of the valid answers; two or more needed."""
    shares = responses.filter(valid(False)).groupBy("prompt", "boxed").agg(F.count("*").alias("c"))
    shares = shares.withColumn(
        "n", F.sum("c").over(Window.partitionBy("prompt"))
    ).withColumn("p", F.col("c") / F.col("n"))
    out = shares.groupBy("prompt").agg(
        (-F.sum(F.col("p") * F.ln("p"))).alias("h"), F.max("n").alias("n_valid")
    ).filter("n_valid >= 2")
    return out.select("prompt", F.round(F.col("h") / F.ln("n_valid"), 6).alias("se"), "n_valid")


def pair_counts(answers: DataFrame, prompt: str, answer: str) -> DataFrame:
    """(prompt, pairs, equal): pairs of a prompt's answers, and those of equal answers, counted without making them.

    A prompt with one answer has no row; null answers equal nothing.
    """
    each = answers.groupBy(prompt, answer).agg(F.count("*").alias("c"))
    two = lambda c: F.floor(c * (c - 1) / 2)
    out = each.groupBy(prompt).agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(F.col(answer).isNotNull(), two(F.col("c")))), F.lit(0)).alias("equal"),
    )
    return out.filter("n > 1").select(prompt, two(F.col("n")).alias("pairs"), "equal")


def clusters_by_verdict(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(prompt, i, cluster): least index reachable by equal verdicts. pairs: prompt, i, j, equal; members: prompt, i.

    A prompt has a few responses, so its union-find is one small group.
    """
    edges = pairs.filter("equal").select("prompt", "i", "j")
    lists = members.groupBy("prompt").agg(F.sort_array(F.collect_set("i")).alias("all")).join(
        edges.groupBy("prompt").agg(F.collect_list(F.struct("i", "j")).alias("e")), "prompt", "left"
    )

    def reach(batches):
        import pyarrow as pa

        for batch in batches:
            prompts, out = [], []
            for prompt, nodes, links in zip(*(batch.column(c).to_pylist() for c in ("prompt", "all", "e"))):
                root = {n: n for n in nodes}

                def find(n):
                    while root[n] != n:
                        root[n] = root[root[n]]
                        n = root[n]
                    return n

                for link in links or []:
                    a, b = sorted((find(link["i"]), find(link["j"])))
                    root[b] = a
                prompts += [prompt] * len(nodes)
                out += [(n, find(n)) for n in nodes]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(prompts, batch.schema.field("prompt").type),
                    pa.array([o[0] for o in out], pa.int32()),
                    pa.array([o[1] for o in out], pa.int32()),
                ],
                names=["prompt", "i", "cluster"],
            )

    return lists.mapInArrow(reach, f"prompt {dict(members.dtypes)['prompt']}, i int, cluster int")


def se_distribution(se: DataFrame) -> DataFrame:
    x = F.col("se")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return se.filter("se is not null").agg(
        F.count("*").alias("n"),
        F.round(F.avg(x), 6).alias("avg_se"),
        n(x < 0.1).alias("low"),
        n((x >= 0.1) & (x < 0.5)).alias("mid"),
        n(x >= 0.5).alias("high"),
    )


def cumulated(scored: DataFrame) -> DataFrame:
    """(i, label, tp, fp): scores from high to low, ties by pos, with the positives and negatives so far."""
    return running(
        scored, [F.desc("score"), F.col("pos")], {"tp": F.col("label"), "fp": 1 - F.col("label")}
    ).select("i", "label", "tp", "fp")


def roc_points(scored: DataFrame) -> DataFrame:
    """(rank, tpr, fpr) from (pos, label, score): scores from high to low, ties in input order and not grouped."""
    of = scored.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    rows = cumulated(scored).join(F.broadcast(of))  # one row
    return rows.select(
        (F.col("i") + 1).cast("int").alias("rank"),
        F.try_divide("tp", "p").alias("tpr"),
        F.try_divide("fp", "n").alias("fpr"),
    )


def auroc(scored: DataFrame) -> DataFrame:
    """Trapezoids under roc_points; null with one class only.

    Rows are dealt to ranges of (score, pos), so neither distinct scores nor one frequent score meet in one task.
    """
    # a negative adds a column of width 1/n at the height of the positives so far
    total = cumulated(scored).agg(
        F.sum((1 - F.col("label")) * F.col("tp")).alias("area"),
        F.sum("label").alias("p"),
        F.sum(1 - F.col("label")).alias("n"),
    )
    return total.select(
        F.round(F.try_divide(F.col("area").cast("double"), (F.col("p") * F.col("n")).cast("double")), 6).alias("auroc")
    )


def class_summary(scored: DataFrame, *by: str) -> DataFrame:
    """(by, n, mean, median, least, most) of the scores. The median is exact and found without a class in one task."""
    told = scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most")
    )
    middle = medians(scored, list(by), "score")
    met = told.alias("x").join(middle.alias("y"), same(list(by)))
    return met.select(*[F.col(f"x.{k}").alias(k) for k in by], "n", "mean", "median", "least", "most")


def online_entropy(responses: Column) -> Column:
    """Normalised entropy of an array of cluster names: 1 for none, 0 for one, else over ln of their number."""
    n = F.size(responses)
    share = F.transform(F.array_distinct(responses), lambda c: F.size(F.filter(responses, lambda r: r == c)) / n)
    entropy = -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.ln(p))
    return F.when(n == 0, 1.0).when(n == 1, 0.0).otherwise(entropy / F.ln(n))


def binned_accuracy(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, accuracy, stderr) over equal bins of [0, 1], the last closed; empty bins are left out."""
    own = scored.withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long"))
    return own.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("a")).select(
        "bin",
        "n",
        F.round("a", 6).alias("accuracy"),
        F.round(F.sqrt(F.col("a") * (1 - F.col("a")) / F.col("n")), 6).alias("stderr"),
    )


def threshold_accuracy(scored: DataFrame, bounds: list[tuple[float, float]]) -> DataFrame:
    """(lo, hi, n, accuracy) for ranges closed at both ends, which may overlap."""
    spread = F.explode(
        F.filter(
            F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in bounds]),
            lambda b: F.col("score").between(b["lo"], b["hi"]),
        )
    )
    return scored.select("label", spread.alias("b")).groupBy("b.lo", "b.hi").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 6).alias("accuracy")
    )
