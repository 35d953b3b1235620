"""Extra columns under the names that the operators use inside change nothing."""

import numpy as np
from pyspark.sql import functions as F

from kiln.llm import additive_ann, warc


def test_warc_with_clashing_columns(spark):
    big = "y" * 1500
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, "v", None), (None, "w", "z")], "page_id long, url string, html string")
    extra = {c: F.lit("x") for c in ("digest", "bundle", "content", "records", "shelf", "salt", "top", "n", "same", "payload", "refers_to")}
    key = lambda df: sorted(map(tuple, warc.read(warc.write(df)).drop("payload").collect()), key=str)
    assert key(pages.withColumns(extra)) == key(pages)


def test_nearest_with_clashing_columns(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=16).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    extra = {c: F.lit(1) for c in ("v", "q", "codes", "norm", "slack", "block", "score", "rank", "query_id", "own", "id")}
    key = lambda df: sorted(map(tuple, additive_ann.nearest(df).collect()))
    assert key(df.withColumns(extra)) == key(df)
