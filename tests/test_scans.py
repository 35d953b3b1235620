"""Range scans, selection, blends and packing against plain walks, with one key that holds most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from kiln.operators import chat, curation, packing, scans, selection
from kiln.plans import providers
from kiln.plans.queries import QUERIES


def trajectories(rnd, n):
    """(user, t, r, v): user 0 has most rows, and there are nulls of each kind."""
    users = [0] * (n // 2) + [rnd.choice([None, 1, 2, 3, 500]) for _ in range(n - n // 2)]
    rnd.shuffle(users)
    return [(u, i, None if i % 11 == 0 else rnd.uniform(-1, 1), None if i % 13 == 0 else rnd.uniform(-1, 1)) for i, u in enumerate(users)]


def test_advantages_equal_a_walk(spark):
    rows = trajectories(random.Random(1), 4000)
    df = spark.createDataFrame(rows, "user int, t long, r double, v double").repartition(5)
    out = scans.advantages(df, "user", ["t"], F.col("r"), F.col("v"), 0.9, 0.8)
    out = scans.positions(scans.returns(out, "user", ["t"], F.col("r"), 0.9), "user", ["t"])
    got = {r.t: (r.user, r.advantage, r.togo, r.p) for r in out.collect()}
    own = {}
    for u, i, r, v in rows:
        own.setdefault(u, []).append((i, r or 0.0, v or 0.0))
    assert len(got) == len(rows)
    for u, steps in own.items():
        a = g = after = 0.0
        for p, (i, r, v) in reversed(list(enumerate(steps))):
            a, g, after = r + 0.9 * after - v + 0.72 * a, r + 0.9 * g, v
            assert got[i][0] == u and got[i][3] == p
            assert abs(got[i][1] - a) < 1e-9 and abs(got[i][2] - g) < 1e-9
    assert scans.returns(df.limit(0), "user", ["t"], F.col("r"), 0.9).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def walk(lengths, budget):
    used = grp = 0
    for n in lengths:
        if used > 0 and used + n > budget:
            used, grp = 0, grp + 1
        used += n
        yield grp


@pytest.mark.parametrize("seed", range(4))
def test_budget_groups_equal_a_walk(spark, seed):
    """One document has most blocks and lies over many ranges; some are longer than the budget, or empty."""
    rnd = random.Random(seed)
    most = [3, 40, 200, 5000][seed]
    docs = {"big": [rnd.choice([0, 0, 1, rnd.randrange(most), 130]) for _ in range(3000)]}
    docs |= {f"d{i}": [rnd.randrange(most) for _ in range(rnd.randrange(1, 30))] for i in range(20)}
    docs |= {"none": [0] * 40, None: [60, 60, 1]}
    rows = [(d, i, n if n or i % 2 else None) for d, own in docs.items() for i, n in enumerate(own)]
    df = spark.createDataFrame(rows, "doc string, pos int, n int").repartition(6)
    got = {(r.doc, r.pos): r.grp for r in scans.budget_groups(df, "doc", "pos", "n", 100).collect()}
    want = {(d, i): g for d, own in docs.items() for i, g in enumerate(walk(own, 100))}
    assert got == want
    assert scans.budget_groups(df.limit(0), "doc", "pos", "n", 100).count() == 0


def test_medians_equal_sorting(spark):
    rnd = random.Random(2)
    classes = {
        "wide": [rnd.gauss(0, 1) * 10 ** rnd.randrange(-200, 200) for _ in range(5001)],
        "tied": [1.0] * 3000 + [2.0] * 3000,
        "three": [0.0] * 2000 + [5.0] * 3000 + [7.5] * 2001 + [float(i) / 1e6 for i in range(500)],
        "few": [3.0, 1.0],
        "one": [4.0],
        None: [float(i % 977) for i in range(4000)],
        "none": [None, None],
    }
    rows = [(c, v) for c, own in classes.items() for v in own]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "c string, v double").repartition(4)
    got = {r.c: r.median for r in selection.medians(df, ["c"], "v", few=50).collect()}
    assert got == {c: statistics.median(own) if own[0] is not None else None for c, own in classes.items()}
    whole = selection.medians(df, [], "v", few=50).collect()
    assert [r.median for r in whole] == [statistics.median([v for _, v in rows if v is not None])]
    assert selection.medians(df.limit(0), ["c"], "v").count() == 0


def drawn(spark, shares, n, seed):
    return [r.source_idx for r in curation.source_draws(spark, shares, n, seed).orderBy("n").collect()]


@pytest.mark.parametrize("mode", ["first_exhausted", "all_exhausted"])
@pytest.mark.parametrize("sizes", [(7, 40, 12), (1, 1, 1), (0, 30, 2), (0, 0, 0)])
def test_interleaving_equals_a_walk(spark, mode, sizes):
    parts = [(spark.range(n).select(F.lit(i).alias("s"), F.col("id").alias("k")), p) for i, (n, p) in enumerate(zip(sizes, (0.2, 0.5, 0.3)))]
    got = [(r.n, r.s, r.k) for r in curation.interleave_until(parts, "k", mode, 5).orderBy("n").collect()]
    some = [(i, n, p) for i, (n, p) in enumerate(zip(sizes, (0.2, 0.5, 0.3))) if n]
    want, at, used = [], [0] * len(some), [False] * len(some)
    for n, s in enumerate(drawn(spark, [p for _, _, p in some], 2000, 5) if some else []):
        if (any if mode == "first_exhausted" else all)(used):
            break
        want.append((n, some[s][0], at[s]))
        at[s] += 1
        if at[s] == some[s][1]:
            used[s], at[s] = True, 0
    assert got == want


def test_interleave_queries_equal_a_walk(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    own = [[r.doc_id for r in docs if r.source == "src1"], [r.doc_id for r in docs if r.source != "src1"]]
    for name, stop in (("interleave_first", any), ("interleave_all", all)):
        got = [(r.n, r.doc_id) for r in QUERIES[name](spark, sf).orderBy("n").collect()]
        want, at, used = [], [0, 0], [False, False]
        for n, s in enumerate(drawn(spark, [0.1, 0.9], 5000, 3)):
            if stop(used):
                break
            want.append((n, own[s][at[s]]))
            at[s] += 1
            if at[s] == len(own[s]):
                used[s], at[s] = True, 0
        assert got == want


def plain_first_fit(lengths, most):
    room, out = [], []
    for n in lengths:
        at = next((b for b, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(most)
        room[at] -= n
        out.append(at)
    return out


def test_first_fit_equals_a_scan(spark, sf):
    rnd = random.Random(3)
    for lengths in ([], [5], [rnd.randrange(1, 60) for _ in range(700)], sorted(range(1, 300)), sorted(range(1, 300), reverse=True), [50] * 100, [rnd.choice([0, 10, 120]) for _ in range(300)]):
        assert packing.first_fit(lengths, 100) == plain_first_fit(lengths, 100)
    got = {}
    for r in QUERIES["first_fit"](spark, sf).collect():
        got.setdefault(r.batch, {})[r.doc_id] = r.bin
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sum(map(len, got.values())) == len(docs)
    for own in got.values():
        ids = sorted(own)
        assert [own[i] for i in ids] == plain_first_fit([docs[i].n_chars for i in ids], 8000)


def test_providers_tell_what_failed(spark):
    def call(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [[p.upper()] for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1)
    got = {r.p: (r.texts, r.error) for r in providers.generate(df, "p", call).collect()}
    assert got == {"a": (["A"], None), "bad": ([], "ValueError: no"), "c": (["C"], None)}


def test_prompt_lengths_and_templates(spark):
    df = spark.createDataFrame([(97, "x/GSM8K"), (98, "b"), (10_000, None)], "n int, d string")
    out = df.select(
        chat.prompt_fits(F.col("n"), 100).alias("fits"), chat.template_for(F.col("d"), {"gsm8k": ["1", "2"]}, ["m"], 1).alias("shots")
    ).collect()
    assert [r.fits for r in out] == [True, False, False] and [r.shots for r in out] == [["1"], ["m"], ["m"]]


def plain_differencing(lengths, k):
    """States as lists of (sum, members); the two of largest spread are merged, the earliest made of equal ones first."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    states = [(n, sorted([(lengths[i], [i])] + [(0, [])] * (k - 1), key=lambda p: (-p[0], p[1]))) for n, i in enumerate(order)]
    n = len(states)
    spread = lambda s: s[1][0][0] - s[1][-1][0]
    while len(states) > 1:
        states.sort(key=lambda s: (-spread(s), s[0]))
        a, b, *rest = states
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[1], b[1][::-1])]
        states = [*rest, (n, sorted(merged, key=lambda p: (-p[0], p[1])))]
        n += 1
    return [sorted(p[1]) for p in states[0][1]]


def test_karmarkar_karp_equals_a_plain_version(spark, sf):
    rnd = random.Random(4)
    for k in (2, 3, 5):
        for n in (k, 12, 40):
            lengths = [rnd.randrange(1, 30) for _ in range(n)]
            assert packing.differencing(lengths, k) == plain_differencing(lengths, k)
    docs = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["karmarkar_karp"](spark, sf).collect():
        got.setdefault(r.batch, {})[r.doc_id] = r.part
    assert sum(map(len, got.values())) == len(docs)
    for own in got.values():
        ids, k = sorted(own), max(own.values()) + 1
        want = {i: p for p, members in enumerate(plain_differencing([docs[i] for i in ids], k)) for i in members}
        assert [own[i] for i in ids] == [want[i] for i in range(len(ids))]


def test_interleave_query_equals_a_walk(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    own = [[r.doc_id for r in docs if r.source == "src1"], [r.doc_id for r in docs if r.source != "src1"]]
    got = [(r.n, r.doc_id) for r in QUERIES["interleave"](spark, sf).orderBy("n").collect()]
    want, at = [], [0, 0]
    for n, s in enumerate(drawn(spark, [0.7, 0.3], len(docs), 0)):
        want.append((n, own[s][at[s] % len(own[s])]))
        at[s] += 1
    assert got == want
