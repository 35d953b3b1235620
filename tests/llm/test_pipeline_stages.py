"""Each stage of the pipeline against a brute-force version, over nulls, empty and long texts, copies, repeats, odd columns."""

import collections
import hashlib
import random

import corpus_pipeline
import numpy as np
import pytest
from test_llm_operators import components_by_hand, repeats_by_hand, sentence
from tokenizers import Tokenizer

from kiln.llm import mixing, pu_quality
from kiln.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__id` long, `__key` string, `row` int, size string, label string, `a.b` int"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    base = sentence(rnd, 60)
    texts = [
        (1, None),
        (2, ""),
        (3, " \n "),
        (4, "one"),
        (7, base),
        (8, base),
        (9, base + " end"),
        (10, sentence(rnd, 20) + " " + base[:300]),
        (11, sentence(rnd, 6000)),
        (None, base),
        (None, None),
        (12, "again"),
        (12, sentence(rnd, 30)),
        (4, "one"),
    ]
    texts += [(20 + i, sentence(rnd, rnd.randrange(1, 90))) for i in range(30)]
    return [(i, t, "en", None if n % 5 == 0 else f"s{n % 3}", len(t or ""), 7, "k", 3, "x", "y", 1) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(
        [(i, int(i % 4 > 0), 0) for i in range(7, 50)] + [(None, 1, 0), (8, None, 0)],
        "doc_id long, quality int, toxic int",
    ).write.parquet(f"{path}/labels.parquet")
    return str(path)


def bag(found, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in found)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_of_nothing(spark, docs, folder, name):
    out = STAGES[name](spark, docs.limit(0), folder)
    assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns)


def test_quality(spark, docs, folder, rows):
    out = STAGES["quality"](spark, docs, folder)
    assert out.columns == docs.columns
    model = pu_quality.train(pu_quality.featured(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    scores = model.score(np.array([pu_quality.features(r[1]) for r in rows]))
    assert bag(out.collect(), "doc_id", "text") == collections.Counter(
        (r[0], r[1]) for r, s in zip(rows, scores) if s >= pu_quality.THRESHOLD
    )


def test_near_copies(spark, docs, folder, rows):
    out = STAGES["near_copies"](spark, docs, folder)
    assert out.columns == docs.columns
    texts = [(i, r[1]) for i, r in enumerate(rows)]  # rows by place: repeated and null ids apart
    group = {i: c for i, _, c in components_by_hand([(i + 1, t) for i, t in texts])}
    kept = collections.Counter()
    members = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if (r[1] or "").split():
            members[group[i + 1]].append((r[0] is None, r[0] or 0, r[1]))
        else:
            kept[r[0], r[1]] += 1
    for own in members.values():
        missing, i, text = min(own)
        kept[None if missing else i, text] += 1
    assert bag(out.collect(), "doc_id", "text") == kept


def test_repeats(spark, docs, folder, rows):
    out = STAGES["repeats"](spark, docs, folder)
    assert out.columns == docs.columns
    want = collections.Counter(
        (i, removed, sha) for i, _, removed, sha in repeats_by_hand([(r[0], r[1]) for r in rows])
    )
    got = collections.Counter()
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r[1])
    for r in out.collect():
        words = (r.text or "").split()
        before = min(len((t or "").split()) for t in by_id[r.doc_id] if len((t or "").split()) >= len(words))
        got[r.doc_id or -1, before - len(words), hashlib.sha256(" ".join(words).encode()).hexdigest()] += 1
        assert r.n_chars == (None if r.text is None else len(r.text)) and r["a.b"] == 1 and r.size == "x"
    assert got == want


def test_mixture(spark, docs, folder, rows):
    out = STAGES["mixture"](spark, docs, folder).collect()
    taken = {}
    for r in mixing.mix(docs).collect():
        taken.setdefault((r.doc_id, r.size), 0)
        taken[r.doc_id, r.size] += r.taken
    have = collections.Counter()
    sizes = {(r[0], tuple((r[1] or "").split())): len((r[1] or "").split()) for r in rows}
    whole = collections.defaultdict(list)
    for (i, words), n in sizes.items():
        whole[i].append((words, n))
    for r in out:
        words = tuple(r.text.split())
        assert words and r.n_chars == len(r.text)
        match = [n for w, n in whole[r.doc_id] if set(words) <= set(w)]
        assert match
        have[r.doc_id, min(match)] += len(words)
    assert sum(have.values()) == sum(taken.values())
    again = STAGES["mixture"](spark, docs.repartition(3), folder).collect()
    assert bag(again, "doc_id", "text") == bag(out, "doc_id", "text")


def test_tokens(spark, docs, folder, rows):
    out = STAGES["tokens"](spark, docs, folder)
    known = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for r in rows:
        ids = known.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    assert bag(out.collect(), "doc_id", "n_tokens", "ids_sha256") == want
