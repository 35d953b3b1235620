"""Every query that SQL can express equals its SQL on the smallest tables; the others are held against plain Python."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from kiln.plans.oracle import SQL
from kiln.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    tidy = lambda v: "~" if v is None or v is pd.NA or (
        isinstance(v, float) and np.isnan(v)
    ) else round(float(v), 6) if isinstance(v, (float, np.floating)) else str(v)
    return sorted((tuple(tidy(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert set(got.columns) == set(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == {
        "first_fit",
        "karmarkar_karp",
        "interleave",
        "interleave_all",
        "interleave_first",
        "near_dup_removed",
        "shuffled_cap",
        "strategy_draw",
        "dynamic_micro_batches",
        "rollout_batches",
    }


def test_packing_queries(spark, sf):
    docs = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    room = {}
    for r in QUERIES["first_fit"](spark, sf).collect():
        room[r.batch, r.bin] = room.get((r.batch, r.bin), 0) + min(docs[r.doc_id], 8000)
    assert max(room.values()) <= 8000
    parts = QUERIES["karmarkar_karp"](spark, sf).toPandas()
    assert sorted(parts.doc_id) == sorted(docs)
    parts["n"] = parts.doc_id.map(docs)
    for _, own in parts.groupby("batch"):
        sums = own.groupby("part").n.sum()
        assert sums.max() - sums.min() <= own.n.max()


def test_interleave_and_shuffle(spark, sf):
    got = QUERIES["interleave"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(
        f"{sf}/documents.parquet"
    ).count() and 0.6 < (got.source == "src1").mean() < 0.8
    drawn = {r.choice: r.n for r in QUERIES["strategy_draw"](spark, sf).collect()}
    assert "apply" not in drawn and abs(drawn["harder"] / sum(drawn.values()) - 0.30 / 0.85) < 0.05
    first = QUERIES["shuffled_cap"](spark, sf).toPandas()
    assert len(set(first.doc_id)) == 100 and list(first.doc_id) == list(
        QUERIES["shuffled_cap"](spark, sf).toPandas().doc_id
    )


def test_near_dup_against_sequential_scan(spark, sf):
    import hashlib
    import re

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets, buckets = {}, {}
    for k in sorted(docs):
        x = re.sub(r"\s+", " ", docs[k].lower().strip())
        sets[k] = {x[i : i + 3] for i in range(len(x) - 2)}
        sig = [min(hashlib.md5(f"{i}_{g}".encode()).hexdigest() for g in sets[k]) for i in range(128)]
        for b in range(16):
            buckets.setdefault((b, tuple(sig[b * 8 : b * 8 + 8])), []).append(k)
    gone = set()
    for (b, _), own in sorted(buckets.items(), key=lambda e: (e[1][0], e[0][0])):
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                if x not in gone and y not in gone and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.7:
                    gone.add(y)
    assert {r.doc_id for r in QUERIES["near_dup_removed"](spark, sf).collect()} == set(docs) - gone and gone


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
