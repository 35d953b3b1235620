"""Identity of expressions against exact expansion, and the graders' algebra and nested LaTeX."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kiln.functions import algebra, equality, grading

NAMES = ("x", "y", "a")


def tree(rnd, depth):
    """A random rational expression: (operator, operands) down to names and numbers."""
    if depth == 0 or rnd.random() < 0.15:
        return rnd.choice(NAMES) if rnd.random() < 0.6 else Fraction(rnd.randrange(1, 6))
    kind = rnd.choice("++--**^/")
    if kind == "^":
        return ("^", tree(rnd, depth - 1), rnd.randrange(0, 4))
    return (kind, tree(rnd, depth - 1), tree(rnd, depth - 1))


def plus(a, b, sign=1):
    out = dict(a)
    for k, v in b.items():
        out[k] = out.get(k, 0) + sign * v
    return {k: v for k, v in out.items() if v}


def times(a, b):
    out = {}
    for i, u in a.items():
        for j, v in b.items():
            k = tuple(x + y for x, y in zip(i, j))
            out[k] = out.get(k, 0) + u * v
    return {k: v for k, v in out.items() if v}


def expand(t):
    """Numerator and denominator, each as exponents to coefficients; no denominator where any part is undefined."""
    one = {(0, 0, 0): Fraction(1)}
    if isinstance(t, str):
        return {tuple(int(n == t) for n in NAMES): Fraction(1)}, one
    if isinstance(t, Fraction):
        return ({(0, 0, 0): t} if t else {}), one
    n, d = expand(t[1])
    if not d:
        return {}, {}
    if t[0] == "^":
        top, low = one, one
        for _ in range(t[2]):
            top, low = times(top, n), times(low, d)
        return top, low
    m, e = expand(t[2])
    if t[0] in "+-":
        return plus(times(n, e), times(m, d), 1 if t[0] == "+" else -1), times(d, e)
    if t[0] == "*":
        return times(n, m), times(d, e)
    return times(n, e), times(d, m)


def written(rnd, t, latex):
    if isinstance(t, str):
        return t
    if isinstance(t, Fraction):
        return str(t)
    l = written(rnd, t[1], latex)
    if t[0] == "^":
        return f"({l})^{{{t[2]}}}" if latex else f"({l})^{t[2]}"
    r = written(rnd, t[2], latex)
    if t[0] == "/" and latex:
        return rf"\frac{{{l}}}{{{r}}}"
    sign = rnd.choice([r"\cdot ", r"\times ", ""]) if latex and t[0] == "*" else t[0]
    return rf"\left({l}\right){sign}\left({r}\right)" if latex else f"({l}){t[0]}({r})"


def from_expansion(poly):
    terms = [f"{v}*" + "*".join(f"{n}^{e}" for n, e in zip(NAMES, k)) for k, v in poly.items()]
    return " + ".join(terms) or "0"


@pytest.mark.parametrize("seed", range(4))
def test_identity_equals_expansion(seed):
    rnd, told = random.Random(seed), []
    for _ in range(150):
        t = tree(rnd, rnd.randrange(1, 5))
        top, low = expand(t)
        if not low:
            assert not algebra.expressions_equal(written(rnd, t, True), written(rnd, t, False))
            continue
        plain = f"({from_expansion(top)})/({from_expansion(low)})"
        assert algebra.expressions_equal(written(rnd, t, True), plain) and algebra.expressions_equal(plain, written(rnd, t, False))
        other = plus(top, {(rnd.randrange(3), 0, rnd.randrange(2)): Fraction(1, rnd.randrange(1, 9))})
        changed = f"({from_expansion(other)})/({from_expansion(low)})"
        assert not algebra.expressions_equal(written(rnd, t, rnd.random() < 0.5), changed)
        u = tree(rnd, 2)
        (n, d), equal = expand(u), algebra.expressions_equal(written(rnd, t, True), written(rnd, u, False))
        told.append(equal)
        if d:
            assert equal == (times(top, d) == times(n, low))
    assert told


SAME = [
    (r"\sqrt{8}", r"2\sqrt{2}"),
    (r"\frac{1}{\sqrt 2}", r"\frac{\sqrt{2}}{2}"),
    (r"\sin^2 x+\cos^2 x", "1"),
    ("x^{1/2}", r"\sqrt{x}"),
    (r"\frac12", "0.5"),
    (r"\sqrt[3]{8}", "2"),
    (r"\log_2 8", "3"),
    (r"\log_{10} 100", r"\log 100"),
    ("5!", "120"),
    ("2^x 2^y", "2^{x+y}"),
    (r"\sqrt{4+2\sqrt3}", r"1+\sqrt3"),
    ("10^{10^{10}}", "10^{10000000000}"),
    (r"\tan\alpha", r"\frac{\sin\alpha}{\cos\alpha}"),
    ("x_{1}+x_2", "x_2+x_1"),
    (r"\sqrt{-4}", r"2\sqrt{-1}"),
    (r"\sqrt{2}^2-2", "0"),
    (r"\sin^{-1} 1", r"\frac{\pi}{2}"),
    ("|-3|", "3"),
]
DIFFERENT = [
    (r"\sqrt{8}", r"2\sqrt{3}"),
    (r"\sqrt{x^2}", "x"),
    ("1/3", "0.3333333"),
    (r"\pi", "3.1415926"),
    ("10^{-20}", "0"),
    (r"\ln x", r"\log x"),
    ("x", "y"),
    ("x/0", "x/0"),
    ("hello there", "hello there!?"),
    (r"x \in A", r"x \in A"),
    ("(" * 500, "(" * 500),
    ("", ""),
    ("2^", "2^"),
]


def test_roots_constants_and_functions():
    assert [p for p in SAME if not algebra.expressions_equal(*p)] == []
    assert [p for p in DIFFERENT if algebra.expressions_equal(*p)] == []
    assert algebra.expressions_equal("1/3", "0.33333", 1e-4) and not algebra.expressions_equal("1/3", "0.333", 1e-4)
    assert algebra.sides_equal(("y", "2x+1"), ("2x+1-y", "0")) and not algebra.sides_equal(("x", "1"), ("2x", "2"))


CASES = {
    grading.math_equal: [
        ("2(x+1)", "2x+2", True),
        (r"\frac{\sqrt{3}}{3}", r"\frac{1}{\sqrt{3}}", True),
        ("y=2(x+1)", "2x+2=y", True),
        ("y=2x+1", "2x+2=y", False),
        ("(x+x, 2)", "(2x,2)", True),
        (r"\sqrt{2}", "1.41421", True),
        (r"\begin{pmatrix}x+x\\1\end{pmatrix}", r"\begin{pmatrix}2x\\1\end{pmatrix}", True),
        ("[1,2]", "(1,2)", True),
        ("t=x+x", "2x", True),
        ("", "", True),
        ("x" * 5000, "x" * 5000 + "y", False),
    ],
    grading.enhanced_equal: [
        (r"(\frac{1}{2}, \infty)", r"x > 0.5", True),
        (r"$2\pi$", "π+π", True),
        ("a^2-b^2 < c", "c > (a-b)(a+b)", True),
        ("a < b < c", "a < b", False),
    ],
    grading.grade_answer: [
        (r"\frac{\frac{1}{2}}{3}", "1/6", True),
        (r"\sqrt{\frac{a}{b}}", "sqrt(a/b)", True),
        (r"2\frac{1}{2}", "5/2", True),
        (r"\frac{x^{2}-1}{x-1}", "x+1", False),  # the text is x^2-1/x-1
        (r"\frac{x^{2}-1}{x-1}", "x^2-1/x-1", True),
        ("x^12", "x^12+0", False),
        ("a+b+c", "c+b+a", False),
        (r"\frac{\sqrt{3}}{\frac{3}{2}}", r"\frac{\sqrt{3}}{6}", True),
        (r"2\alpha", r"\alpha+\alpha", True),
        ("(1, x+x)", "(1, 2x)", True),
        ("4", "2+2", False),
    ],
    grading.algebra_equal: [("x+x", "2x", True), ("x", None, False), (None, None, False), (r"\text{no}", "no", False)],
    grading.undecided: [("x+1", "1+x", False), (r"x \in A", r"A \ni x", True), ("1", "2", False), (None, "x", False)],
}


@pytest.mark.parametrize("f", CASES, ids=lambda f: f.__name__)
def test_graders_with_algebra(spark, f):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES[f])], "i int, p string, r string, want boolean")
    assert [tuple(r) for r in df.select("p", "r", "want", f(F.col("p"), F.col("r")).alias("got")).collect() if r.got != r.want] == []


def nested(rnd, depth):
    """LaTeX of nested fractions and roots, and its text."""
    if depth == 0:
        x = rnd.choice(["1", "23", "x", "b"])
        return x, x
    (a, u), (b, v) = nested(rnd, depth - 1), nested(rnd, rnd.randrange(depth))
    kind = rnd.randrange(5)
    if kind == 0:
        return rf"\frac{{{a}}}{{{b}}}", f"{u}/{v}"
    if kind == 1:
        return rf"\sqrt{{{a}}}", f"sqrt({u})"
    if kind == 2:
        return rf"\dfrac {{{a}}} {{{b}}}", f"{u}/{v}"
    if kind == 3:
        return rf"\sqrt[3]{{{a}}}", f"sqrt({u})"
    return rf"{a}+{{{b}}}", f"{u}+{v}"


def test_nested_latex_as_text(spark):
    rnd = random.Random(3)
    rows = [(i, *nested(rnd, i % 7)) for i in range(140)]
    rows += [(1000, r"\frac12", "1/2"), (1001, r"\sqrt2+\alpha\cdot\pi", "sqrt(2)+α*pi"), (1002, r"\text{a b}\foo", "a b"), (1003, None, None), (1004, r"\left(1\right)", "(1)")]
    df = spark.createDataFrame(rows, "i int, c string, want string")
    got = df.select("i", "c", "want", F.replace(grading.latex_text(F.col("c")), F.lit(" ")).alias("got")).collect()
    assert [tuple(r) for r in got if r.got != (r.want and r.want.replace(" ", ""))] == []


def test_simple_answer_keeps_decimals(spark):
    rows = [
        ("The answer is 3.5", "3.5"),
        ("answer is: 1.25.", "1.25"),
        ("The answer is:\n 7...\nmore", "7"),
        ("x\n#### 5.50 \nnext", "5.50"),
        ("a\nlast 2.5.", "last 2.5."),
    ]
    df = spark.createDataFrame(rows, "c string, want string")
    assert [tuple(r) for r in df.select("c", "want", grading.simple_answer(F.col("c")).alias("got")).collect() if r.got != r.want] == []


def test_numbers_as_the_grader_reads_them():
    assert [equality.number_of(x) for x in ("1,000", "50%", r"5\%", ".5", "1e3", "x", "", "٣", "5%%")] == [1000.0, 0.5, 0.05, 0.5, 1000.0, None, None, None, None]
