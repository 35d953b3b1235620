import pytest
from pyspark.sql import functions as F

from kiln.functions import grading, losses, text
from kiln.operators import chat, curation, evaluation, packing, preference, rollout, uncertainty
from kiln.plans import providers
from kiln.sources import readers
from kiln.streaming import resume


def each(spark, f, *args):
    df = spark.createDataFrame(
        [(i, *(a if isinstance(a, tuple) else (a,))) for i, a in enumerate(args)],
        "i int, " + ", ".join(f"c{k} string" for k in range(len(args[0]) if isinstance(args[0], tuple) else 1)),
    )
    return [r.v for r in df.select("i", f(*[F.col(c) for c in df.columns[1:]]).alias("v")).orderBy("i").collect()]


def test_boxed(spark):
    assert each(
        spark, text.last_boxed, "no", "\\boxed{}", "\\boxed{1} \\boxed{ \\frac{a}{b} }", "\\boxed{1} \\boxed{2", None
    ) == [None, "", "\\frac{a}{b}", None, None]


def test_extract_answer(spark):
    got = each(
        spark,
        grading.extract_answer,
        "<think>9</think> so \\boxed{\\dfrac12}",
        "the answer is: $1,234.50 dollars",
        "the answer is (3, 5). However it",
        "it is 3 or 4.",
        "no number",
        "\\boxed{x=5",
        "<think>never",
        "The final answer is $7$. I hope",
        None,
    )
    assert got == ["\\frac{1}{2}", "1234.50", "(3,5)", "4", "", "5", "", "7", None]


def test_strip_string(spark):
    got = each(
        spark,
        grading.strip_string,
        "1/2",
        "\\sqrt2",
        "3.000",
        "50\\%",
        "k=7",
        "5\\text{ miles}",
        "\\frac1{x}",
        "2j",
        "01/2",
        ".5",
    )
    assert got == ["\\frac{1}{2}", "\\sqrt{2}", "3", "50", "7", "5", "\\frac{1}{x}", "2i", "01/2", "0.5"]


@pytest.mark.parametrize(
    "p,r,same",
    [
        ("1,000", "1000", True),
        ("50%", "0.5", True),
        ("0.33333", "1/3", True),  # constants as close as numbers need to be
        ("(1,2)", "[1,2]", True),
        ("1d", "1", False),
        ("1_000", "1000", False),
        ("X", "x", True),
        ("3", "4", False),
        ("", "", True),
        ("{a}", "a", True),
        ("(1, 2)", "(1,2)", True),
        ("(1,2)", "(1,3)", False),
    ],
)
def test_math_equal(spark, p, r, same):
    assert each(spark, grading.math_equal, (p, r)) == [same]


def test_null_grades_are_false(spark):
    assert each(spark, grading.math_equal, (None, "1"), ("1", None)) == [False, False]


def test_judges(spark):
    assert each(spark, text.parse_keep, "VERDICT: remove", "keep", "no REMOVE", "?") == [False, True, False, True]
    assert [
        r.accept for r in each(spark, text.parse_accept, "Accept\nx", "x\nREJECT: y", "so accept", "<think>ACCEPT", "")
    ] == [True, False, True, False, False]
    assert each(
        spark, text.extract_problem, "<think>a</think>New problem: " + "x" * 60 + "\nSolution: y", "**Problem:** q"
    ) == ["x" * 60, "q"]
    assert each(spark, text.wrap_latex, "\\pi", "$1$", "5", "") == ["$\\pi$", "$1$", "5", ""]


def test_json(spark):
    got = each(
        spark, lambda c: text.json_object(c, "a STRING, b STRING", ["a"]), 'x {"a": "1",} y', '{"b": "2"}', "none", None
    )
    assert [r and r.a for r in got] == ["1", None, None, None]


def test_shingles(spark):
    assert each(spark, text.shingles, "ab", "AB  c") == [[], ["ab ", "b c"]]


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 0.5, 0.0])], "a array<double>, v array<double>")
    got = df.select(
        losses.discounted(F.col("a"), 0.5).alias("d"),
        losses.gae(F.col("v"), F.col("a"), 1.0, 1.0).alias("g"),
        chat.padded(F.col("a"), F.lit(5), F.lit(0.0), left=True).alias("p"),
        losses.masked_mean(F.col("a"), F.array(F.lit(1), F.lit(0), F.lit(1))).alias("m"),
    ).first()
    assert got.d == [2.75, 3.5, 3.0] and got.g == [5.0, 4.5, 3.0] and got.p == [0, 0, 1, 2, 3] and got.m == 2.0
    ids = spark.createDataFrame([([5, 9, 5, 9, 5], [1, 0])], "i array<int>, l array<int>")
    assert ids.select(chat.placeholders(F.col("i"), F.col("l"), 5).alias("x")).first().x == [1, -100, 0, -100, -100]


def test_packing_examples():
    assert max(packing.first_fit([5, 3, 7, 2, 6], 10)) + 1 == 3
    assert sorted(sum(packing.differencing([4, 5, 6, 7, 8], 2), [])) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        packing.differencing([1], 2)
    assert packing.in_order([3, 1, 1, 1], 2) == [[0], [1, 2, 3]]
    with pytest.raises(ValueError):
        packing.chunk_shard(F.lit(1), 2, 3)
    with pytest.raises(ValueError):
        preference.processor("none")


def test_snake_example(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([8, 7, 6, 5, 4, 3, 2, 1])], "pos int, n int")
    got = packing.snake(df, "n", "pos", 2).orderBy("rank", "turn").collect()
    assert [[r.n for r in got if r.rank == k] for k in (0, 1)] == [[8, 1, 6, 3], [7, 2, 5, 4]]


def test_rank_shard_wraps(spark):
    df = spark.range(3).withColumnRenamed("id", "i")
    assert packing.rank_shard(df, "i", 3, 7).groupBy("rank").count().count() == 7
    assert packing.rank_shard(df, "i", 3, 2, drop_last=True).count() == 2


def test_empty_and_single_groups(spark):
    empty = spark.createDataFrame([], "pos long, label int, score double")
    assert uncertainty.auroc(empty).first().auroc is None
    one = spark.createDataFrame([(1, 0.5)], "g int, r double")
    row = rollout.group_baselines(one, "g", "r").first()
    assert row.rloo is None and row.group_std is None and row.centred == 0.0
    assert evaluation.accuracy(spark.createDataFrame([], "correct boolean")).first().accuracy == 0.0


def test_entropy_edges(spark):
    rows = [("a", "x", -1.0, 1)] * 4 + [
        ("b", str(i), -1.0, 1) for i in range(4)
    ] + [("c", None, -1.0, 1)] * 3 + [("c", "x", -1.0, 1)] * 2 + [("d", "x", -1.0, 0), ("d", "y" * 201, -1.0, 1)]
    got = {
        r.prompt: (r.se, r.n_valid)
        for r in uncertainty.weighted_entropy(
            spark.createDataFrame(rows, "prompt string, boxed string, slp double, len int")
        ).collect()
    }
    assert got == {"a": (0.0, 4), "b": (1.0, 4), "c": (None, 0), "d": (None, 0)}


def test_provider_halves_failed_batches(spark):
    def picky(prompts):
        if len(prompts) > 1 or prompts[0] == "bad":
            raise RuntimeError
        return [[p + "!"] for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1)
    assert {
        r.p: list(r.texts) for r in providers.generate(df, "p", picky).collect()
    } == {"a": ["a!"], "bad": [], "c": ["c!"]}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q" * 12, "1"), ("q2 is long enough", None)], "question string, answer string")
    readers.write_jsonl(df, str(tmp_path / "a.jsonl"))
    assert '"answer":null' in "".join(p.read_text() for p in (tmp_path / "a.jsonl").glob("part*"))
    readers.write_csv(df, str(tmp_path / "a.csv"))
    assert readers.entries(spark, str(tmp_path / "a.jsonl")).count() == 1
    assert readers.blended(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "a.csv")]).count() == 4
    with pytest.raises(ValueError):
        readers.read(spark, "x.bin")
    df.write.parquet(str(tmp_path / "train.parquet"))
    reg = [
        {
            "name": "n",
            "path": str(tmp_path) + "/{split}.parquet",
            "key": "problem",
            "split": "test",
            "difficulty": "easy",
            "max_seeds": -1,
            "evol_rounds": 2,
        }
    ]
    assert readers.seeds(spark, reg).count() == 2
    (tmp_path / "m.log").write_text("[2025-01-01 00:00:00] train step=3 | loss=0.5 | acc=1.0\n")
    row = readers.metric_log(spark, str(tmp_path / "m.log")).first()
    assert row.step == 3 and row.prefix == "train" and row["values"] == {"loss": 0.5, "acc": 1.0}
    curation.write_routed(df.withColumn("v", F.lit("keep")), "v", str(tmp_path / "r"))
    assert (tmp_path / "r" / "v=keep").exists()


def test_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    go = lambda: resume.process_new(
        spark, str(src), "a long", lambda x: x.filter("a > 1"), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    (src / "1.json").write_text('{"a":1}\n{"a":2}\n')
    go()
    (src / "2.json").write_text('{"a":3}\n')
    go()
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]


def test_llm_is_not_needed():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "kiln"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "kiln.llm" in p.read_text()]
