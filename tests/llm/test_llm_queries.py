"""The folder's queries against their SQL, and the pipeline's stages."""

from numbers import Real

import duckdb
import pandas as pd
import pytest

from kiln.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.execute(Q.oracle_sql()[name]).df(), Q.queries()[name](spark, sf).toPandas()
    assert set(want.columns) == set(got.columns)
    tidy = lambda df: sorted(
        (
            tuple("~" if pd.isna(v) else str(float(v)) if isinstance(v, Real) else str(v) for v in r)
            for r in df[sorted(df.columns)].itertuples(index=False)
        )
    )
    assert tidy(got) == tidy(want)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, names = docs, docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from kiln.llm.common import materialise

        now = materialise(stage(spark, now, sf), name)
        assert now.columns == names
        counts.append(now.count())
    assert counts[0] <= docs.count() and counts[1] <= counts[0] and counts[2] == counts[1]
    assert corpus_pipeline.run(spark, sf).count() == counts[3]
