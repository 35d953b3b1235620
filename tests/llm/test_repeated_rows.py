"""Rows that repeat an id: how they come changes nothing, and they are not collected."""

import random

from pyspark.sql import functions as F

from kiln.llm import mixing, pu_quality


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    rnd = random.Random(1)
    rows = [(7, " ".join(f"w{rnd.randrange(9999)}" for _ in range(700)), "s", "en") for _ in range(12)]
    rows += [(8, rows[0][1], "s", lang) for lang in ("de", "fr", "en")]
    kind = "doc_id long, text string, source string, lang string"
    made = [
        sorted(tuple(r) for r in mixing.mixed_documents(spark.createDataFrame(own, kind).repartition(n)).collect())
        for n, own in ((1, rows), (3, rows[::-1]))
    ]
    assert made[0] == made[1] and made[0]


def test_one_trusted_id_with_many_rows(spark):
    good = [(i, f"The {i} quick brown foxes jump over lazy dogs, and then they rest by the river.") for i in range(40)]
    junk = [(100 + i, "$$$ ### " * 20 + str(i)) for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, quality int")
    once = spark.createDataFrame(good + junk, "doc_id long, text string")
    many = once.unionByName(spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(good[1][1]).alias("text")))
    table = pu_quality.featured(many, labels)
    assert table.where("trusted").count() > 3000
    scores = {r.doc_id: r.score for r in pu_quality.score(many, labels).collect()}
    assert min(scores[i] for i, _ in good) > max(scores[i] for i, _ in junk)
