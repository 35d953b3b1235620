"""A worker that goes on to another operator's tasks lets the vocabulary of the last one go."""

import pyarrow as pa
import pytest

from kiln.llm import bpe, common
from kiln.llm.queries import tokenizer_path

TABLE = pa.table({"x": [1]})
OTHERS = {
    "group": lambda: common.lean_group(lambda key, t: t)((1,), TABLE),
    "pair": lambda: common.lean_pair(lambda key, a, b: a)((1,), TABLE, TABLE),
    "batches": lambda: list(common.lean_batches(lambda batches: batches)(iter(TABLE.to_batches()))),
}


@pytest.mark.parametrize("kind", sorted(OTHERS))
def test_next_operator_has_no_vocabulary(kind):
    path = tokenizer_path()
    own = common.lean_batches(lambda batches: [bpe.vocabulary(path)], holds=True)
    first = list(own(iter(())))[0]
    assert list(own(iter(())))[0] is first  # kept from task to task
    OTHERS[kind]()
    assert not common.HELD
    assert bpe.vocabulary(path).encode(["the end"]) == first.encode(["the end"])
    common.let_go()
