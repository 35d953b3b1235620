"""Answers through every tier of the graders and normal forms."""

import pytest
from pyspark.sql import functions as F

from kiln.functions import grading, losses, text
from kiln.operators import packing, records, training

PM = r"\begin{pmatrix}1&2\\3&4\end{pmatrix}"
CASES = {
    grading.math_equal: [
        (PM, r"\begin{pmatrix}1 & 2.0\\ 3&4\end{pmatrix}", True), (
            r"\begin{bmatrix}1\\2\end{bmatrix}", r"\begin{pmatrix}1\\2\end{pmatrix}", True
        ),
        (
            PM, r"\begin{pmatrix}1&2\\3&5\end{pmatrix}", False
        ), (PM, r"\begin{pmatrix}1&2\end{pmatrix}", False), (PM, "{1,2}", False),
        ("x=5", "5", True), ("5", "y = 5.0", True), ("abc=5", "5", False), (
            "a+b=c", "c=a+b", True
        ), ("a=b", "a=c", False),
        ("(1, 2)", "(1,2.0)", True), (
            "(1,2)", "(1,2,3)", False
        ), ("0.5", "50", True), ("7", "8", False), (None, "1", False), ("", "1", False), ("North", "north", True),
    ],
    grading.enhanced_equal: [
        ("(1, 2]", "1 < x ≤ 2", True), ("[1, 2]", "1 < x ≤ 2", False), ("c > a > b", "b < a < c", True), (
            r"\frac{1}{2}", "0.5000000001", True
        ),
        ("B. 3", "3", True), ("$x$", "x", True), ("x", "y", False), (None, "1", False), (
            r"\text{rac}{1}{2}", r"\frac12", True
        ),
    ],
    grading.grade_answer: [
        ("1/2", "0.5", True), ("2/4", "1/2", False), ("5", "5.0", True), ("5", "5.5", False), (
            "(1,2)", "(1, 2)", True
        ), ("x", "y", False), (None, "1", False),
        ("1,000", "1000", True), ("3 cm", "3", True), ("2 million", "2*10^6", True), (
            r"\text{East}", "east", True
        ), ("", "1", False),
    ],
    grading.verify_answer: [
        (r"so \boxed{\frac12}", r"\frac{1}{2}", True),
        ("the answer is 7", "8", False),
        ("<think>1</think> 9", "9", True),
    ],
}


@pytest.mark.parametrize("f", CASES, ids=lambda f: f.__name__)
def test_graders(spark, f):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES[f])], "i int, p string, r string, want boolean")
    got = df.select("i", "p", "r", "want", f(F.col("p"), F.col("r")).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []


FORMS = {
    grading.deep_normalised: [
        ("A. $x$", "x"),
        ("sqrt(2)", r"\sqrt{2}"),
        ("rac{1}{2}", r"\frac{1}{2}"),
        (r"\frac{x}{1}", "x"),
        ("∞", r"\infty"),
        ("$$3$$", "3"),
        (r"\text{e}", "e"),
    ],
    grading.competition_form: [
        ("0.5", r"\frac{1}{2}"), ("6/10", r"\frac{6}{10}"), (r"\text{abc}", "abc"), ("x=3", "3"), (
            r"\sqrt3", r"\sqrt{3}"
        ), (r"\frac12", r"\frac{1}{2}"), (r"5\text{ cm}", "5"),
        (r"a\text{ b}\text{ c}", r"a\text{ b}\text{ c}"), (
            r"1\sqrt", r"1\sqrt"
        ), (r"\frac", r"\frac"), (r"\frac1", r"\frac1"), (".25", "0.25"), ("", ""), (None, None),
    ],
    grading.grade_form: [
        ("1,000 cm", "1000"),
        ("3 million", "3*10^6"),
        (r"\frac{1}{2}", "1/2"),
        ("1 1/2", "1+1/2"),
        ("5.0", "5"),
        ("10 and 20", "10,20"),
        (None, None),
    ],
    grading.truth_normalised: [
        ("$5$", "5"), ("the answer is 7.", "7"), (r"\boxed{3}", "3"), (r"\frac12", r"\frac{1}{2}")
    ],
    grading.boxed_only: [
        (r"\boxed{1}", "1"), (r"\fbox{2}", None), (r"\boxed{1} \fbox{2}", "1"), (r"\boxed{1", None), ("none", None)
    ],
    grading.set_to_pmatrix: [("{1,2}", "\\begin{pmatrix}1\\2\\end{pmatrix}"), ("1", "")],
    text.first_line: [("<think>x</think>\n a \nb", "a"), ("", "")],
    text.extract_problem: [("New problem: Find x.", "Find x.")],
    text.thousands_removed: [("1,234,567", "1234567"), ("1,23", "1,23")],
    text.unicode_to_latex: [("√2", r"\sqrt{2}"), ("a≤b", r"a\leb")],
    text.label_cascade: [("so #### 5", "5"), (r"\boxed{6}", "6"), (" 7 ", "7")],
    grading.simple_answer: [(r"\boxed{1}", "1"), ("#### 2", "2"), ("Answer is: 3.", "3"), ("a\nb", "b")],
}


@pytest.mark.parametrize("f", FORMS, ids=lambda f: f.__name__)
def test_forms(spark, f):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(FORMS[f])], "i int, c string, want string")
    assert [r for r in df.select("i", "c", "want", f(F.col("c")).alias("got")).collect() if r.got != r.want] == []


def test_predicates_and_parts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.needs_conversion(F.lit(r"\{x \mid x < 2\}"))) and not one(text.needs_conversion(F.lit("x < 2")))
    assert one(text.is_multi_select(F.lit(" abd "))) and not one(text.is_multi_select(F.lit("A")))
    assert one(text.is_yes(F.lit(" yes, so"))) and one(text.template("a {} b", F.lit("x"))) == "a x b"
    assert one(text.split_tuple(F.lit("(1, 2)"))) == ["1", "2"]
    assert not one(grading.undecided(F.lit("x+1"), F.lit("1+x"))) and not one(grading.undecided(F.lit("1"), F.lit("2")))
    simple = one(grading.simple_normalised(F.lit("$1,000%")))
    assert (simple.number, simple.text) == (1000.0, None)
    floats = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(losses.log_sum_exp(floats("-inf", "-inf"))) == float("-inf") and one(
        losses.log_sum_exp(F.array().cast("array<double>"))
    ) == float("-inf")
    assert abs(one(losses.log_exp(F.lit(2.0), F.lit(1.0))) - 0.3132616875) < 1e-9


def test_micro_batches(spark):
    rows = [(0, r, i, n) for r, lengths in enumerate(([5, 5, 5, 5], [9, 9, 9, 1])) for i, n in enumerate(lengths)]
    got = packing.micro_batches(
        spark.createDataFrame(rows, "step int, rank int, pos int, n int"), "step", "rank", "pos", "n", 10
    ).toPandas()
    assert got.groupby("rank").micro.nunique().tolist() == [3, 3]  # the second rank needs three
    assert abs(got.drop_duplicates(["rank", "micro"]).groupby("rank").loss_scale.sum() - 1).max() < 1e-9
    assert (got[got.optimizer_step == 1].micro == 2).all()
    batches = packing.rollout_batches(
        spark.createDataFrame([(0, i, 5) for i in range(10)], "b int, pos int, n int"), "b", "pos", "n", 10, 2
    ).toPandas()
    assert batches.micro.nunique() == 4  # five by first fit, rounded down to a multiple of the actors


def test_numbering_keeps_null_keys(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (1,)], "k int")
    assert sorted((r.i, r.k) for r in packing.number_rows(df, "k").collect()) == [(0, None), (1, 1), (2, 1), (3, 3)]
    assert packing.number_rows(df.limit(0), "k").count() == 0


def test_least_loaded_is_the_heaps_order(spark):
    import heapq

    for pending, each in (([0, 0, 0], 4), ([8, 0, 4], 4), ([7, 0, 2, 2], 3), ([100, 0], 8)):
        heap, want = [(n, e) for e, n in enumerate(pending)], []
        heapq.heapify(heap)
        for _ in range(60):
            n, e = heapq.heappop(heap)
            want.append(e)
            heapq.heappush(heap, (n + each, e))
        assert [
            r[0] for r in spark.range(60).select(packing.least_loaded(F.col("id"), pending, each)).collect()
        ] == want


def test_reward_files(spark, tmp_path):
    path = tmp_path / "reward.py"
    path.write_text(
        "def reward_func(queries, prompts, labels, **kwargs):\n    r = [float(q.endswith(x)) for q, x in zip(queries, labels)]\n    return {'rewards': r, 'scores': r, 'extra_logs': {}}\n"
    )
    df = spark.createDataFrame([("a 4", "a", "4"), ("b 5", "b", "6")], "query string, prompt string, label string")
    assert [
        (r.reward, r.score) for r in records.rewarded(df, records.reward_function(str(path))).collect()
    ] == [(1.0, 1.0), (0.0, 0.0)]


def test_total_steps():
    assert training.total_steps(1000, 4, 1, 2, 8, 2, 64) == 1000 * 4 * 2 // 8 // 2 // 4


def test_checked_parts():
    assert packing.balanced_parts([5, 4, 3, 3, 1], 2) == [[1, 2, 4], [0, 3]] or sum(map(len, packing.balanced_parts([5, 4, 3, 3, 1], 2))) == 5
    for parts, items, k, equal in (([[0], []], 1, 2, False), ([[0], [0]], 2, 2, False), ([[0, 1], [2]], 3, 2, True)):
        with pytest.raises(ValueError):
            packing.checked(parts, items, k, equal)


def test_mapped_rows(spark):
    out = records.mapped(spark.range(6), lambda r: {"x": r["id"] * 2}, "x long", keep=lambda r: r["id"] % 2 == 1)
    assert sorted(r.x for r in out.collect()) == [2, 6, 10]
