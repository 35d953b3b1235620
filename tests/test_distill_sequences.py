"""distill_loss equals its SQL where a sequence has no masked token, and where vectors are null or empty."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kiln.plans.queries import QUERIES
from kiln.plans.training import SQL


def vectors(ids, missing=()):
    made = np.random.default_rng(3).normal(size=(len(ids), 8)).astype(np.float32).tolist()
    made = [missing[i] if i in missing else v for i, v in zip(ids, made)]
    kinds = (("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()))
    return pa.table({name: pa.array(c, t) for (name, t), c in zip(kinds, (ids, made, [i % 8 for i in ids]))})


# the last sequence has two rows, both unmasked; one before has; no masked token at all; vectors that are none; no rows
CASES = {
    "tail": (vectors([*range(10)]), "nan"),
    "within": (vectors([*range(8), 8, *range(16, 24)]), "nan"),
    "none": (vectors([0, 1]), "nan"),
    "missing": (vectors([*range(24)], {4: None, 13: []}), "number"),
    "all": (vectors([*range(24)]), "number"),
    "empty": (vectors([]), "null"),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_distill_loss_equals_sql(spark, tmp_path, case):
    table, kind = CASES[case]
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got = QUERIES["distill_loss"](spark, str(tmp_path)).first().loss
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(SQL["distill_loss"]).fetchone()[0]
    assert kind == ("null" if want is None else "nan" if math.isnan(want) else "number")
    assert got == want if kind != "nan" else math.isnan(got)
