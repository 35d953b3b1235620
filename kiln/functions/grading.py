"""Answers: extraction, normal form, and grading. Forms are Columns; the graders decide in one pass over Arrow batches."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from kiln.functions import algebra, equality

from .text import last_boxed, let, put, response_part, split_tuple, strip, strip_think, thousands_removed, unicode_to_latex

# Replacements in the order in which they decide results.
RELATIONS = [
    ("tfrac", "frac"),
    ("dfrac", "frac"),
    ("\\neq", "\\ne"),
    ("\\leq", "\\le"),
    ("\\geq", "\\ge"),
    ("\\left", ""),
    ("\\right", ""),
    ("\\{", "{"),
    ("\\}", "}"),
]
DEGREES_AND_DOLLARS = ["^{\\circ}", "^\\circ", "\\$", "$", "\\(", "\\)"]
VARIABLES = ["x=", "y=", "z=", "x\\in", "y\\in", "z\\in", "x\\to", "y\\to", "z\\to"]
PERCENT = ["\\%", "%"]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def fold(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda out, p: put(out, *p), pairs, c)


def braced_fractions(c: Column) -> Column:
    """\\frac ab with braces around both; a \\frac with too little behind it leaves the whole text alone."""
    parts = F.split(c, r"\\frac")
    short = F.exists(F.slice(parts, 2, 1 << 20), lambda p: ~p.startswith("{") & (F.length(p) < 2))
    mended = F.transform(
        parts,
        lambda p, i: F.when((i == 0) | p.startswith("{"), p).otherwise(
            F.regexp_replace(F.regexp_replace(p, r"(?s)^(.)\{", r"{$1}{"), r"(?s)^([^{])([^{])", r"{$1}{$2}")
        ),
    )
    return F.when(short, c).otherwise(F.array_join(mended, "\\frac"))


def slash_fraction(c: Column) -> Column:
    """a/b as \\frac{a}{b} for plain integers or operands with a root."""
    whole = r"(-?[1-9]\d*|0)"
    side = rf"({whole}|[^/]*sqrt[^/]*)"
    return F.when(
        c.rlike(rf"^{side}/{side}$"), F.regexp_replace(c, r"^([^/]*)/([^/]*)$", r"\\frac{$1}{$2}")
    ).otherwise(c)


def strip_string(c: Column) -> Column:
    """Normal form of a LaTeX answer. The order of its steps is part of the result."""
    s = put(F.regexp_replace(put(strip(c), "\n"), r"\.+$", ""), "\\!")
    s = F.regexp_replace(s, r"\\begin\{array\}\{.*?\}", r"\\begin{pmatrix}")
    s = put(F.regexp_replace(s, r"\\end\{array\}", r"\\end{pmatrix}"), "bmatrix", "pmatrix")
    s = fold(s, RELATIONS)
    unit = lambda v: strip(F.regexp_replace(v, r"\\text\{.*?\}$", ""))
    s = let(s, lambda v: F.when(unit(v) != "", unit(v)).otherwise(v))
    s = fold(s, [(x, "") for x in DEGREES_AND_DOLLARS])
    s = F.regexp_replace(s, r"\\text\{(.*?)\}", "$1")
    s = fold(s, [(x, "") for x in VARIABLES] + [("\\emptyset", "{}"), ("(-\\infty,\\infty)", "\\mathbb{R}")])
    s = fold(s, [(x, "") for x in PERCENT] + [(" .", " 0."), ("{.", "{0."), ("infinity", "\\infty")])
    s = let(s, lambda v: F.when(F.contains(v, F.lit("\\infty")), v).otherwise(put(v, "inf", "\\infty")))
    s = fold(s, [("+\\inity", "\\infty"), ("and", ""), ("\\mathbf", "")])
    s = F.regexp_replace(s, r"\\mbox\{.*?\}", "")
    s = let(s, lambda v: F.when(F.contains(v, F.lit("i")), v).otherwise(put(v, "j", "i")))
    s = F.regexp_replace(F.regexp_replace(s, r"(\d+)\.0*([^\d])", "$1$2"), r"(\d+)\.0*$", "$1")
    s = F.regexp_replace(s, r"^\.", "0.")
    sides = lambda v: F.split(v, "=")
    s = let(
        s,
        lambda v: F.when(
            (F.size(sides(v)) == 2) & (F.length(F.get(sides(v), F.lit(0))) <= 2), F.get(sides(v), F.lit(1))
        ).otherwise(v),
    )
    s = put(F.regexp_replace(s, r"\\sqrt(\w+)", r"\\sqrt{$1}"), " ")
    return let(let(s, braced_fractions), slash_fraction)


def stated_value(c: Column) -> Column:
    """Behind "the answer is": a leading number without commas, else the text up to the next sentence."""
    number = F.replace(F.regexp_extract(c, r"^\$?(-?\d[\d,]*\.?\d*)", 1), F.lit(","), F.lit(""))
    return F.when(number != "", number).otherwise(
        strip(F.get(F.split(c, r"(?<=[^a-zA-Z])\s+(?=[A-Z][a-z])"), F.lit(0)))
    )


def boxed_or_partial(c: Column) -> Column:
    """Behind the last "boxed": the braces' contents, even if they never close; without braces up to a dollar sign."""
    tail = F.element_at(F.split(c, "boxed"), -1)
    step = lambda s, ch: F.when(s["depth"] == 0, s).otherwise(
        F.struct(
            (s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("depth"),
            F.when((ch == "}") & (s["depth"] == 1), s["text"]).otherwise(F.concat(s["text"], ch)).alias("text"),
        )
    )
    inner = F.aggregate(
        F.split(F.substring(tail, 2, 1 << 30), ""), F.struct(F.lit(1).alias("depth"), F.lit("").alias("text")), step
    )["text"]
    return F.when(tail == "", tail).when(tail.startswith("{"), inner).otherwise(
        strip(F.get(F.split(tail, r"\$"), F.lit(0)))
    )


def extract_answer(c: Column, use_last_number: bool = True) -> Column:
    """The answer in a response: boxed, else stated, else the last number; in normal form. Null: null."""
    return F.when(c.isNotNull(), strip_string(let(strip_think(c), lambda s: stated_or_last(s, use_last_number))))


def stated_or_last(s: Column, use_last_number: bool) -> Column:
    """The raw answer of a response without thinking."""
    after = lambda words: F.regexp_replace(
        strip(F.get(F.split(strip(F.element_at(F.split(s, words), -1)), "\n"), F.lit(0))), r"^[\s:]+", ""
    )
    number = F.coalesce(
        F.element_at(
            F.filter(F.regexp_extract_all(put(s, ","), F.lit(r"-?\d*\.?\d+"), F.lit(0)), lambda x: x != ""), -1
        ),
        F.lit(""),
    ) if use_last_number else F.lit("")
    hoped = F.regexp_extract(s, r"(?s)final answer is \$(.*?)\$\. I hope", 1)
    has = lambda words: F.contains(s, F.lit(words))
    number = F.when(
        F.size(F.regexp_extract_all(put(s, ","), F.lit(r"-?\d*\.?\d+"), F.lit(0))) > 0, number
    ).otherwise(F.lit(""))
    raw = F.when(has("boxed"), boxed_or_partial(s)).when(
        has("final answer is $") & has("$. I hope"), strip(hoped)
    ).when(has("the answer is"), stated_value(after("the answer is"))).when(
        has("final answer is"), stated_value(after("final answer is"))
    ).otherwise(number)
    raw = F.regexp_replace(raw, r"\n\s*", "")
    raw = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "^:", ""), r"\.$", ""), "/$", "")
    return raw


def simple_answer(c: Column) -> Column:
    """Shorter cascade: boxed, label, the line behind "answer is" without its full stop, last line."""
    label, said = r"(?d)####\s*(.+)", r"(?id)answer is[:\s]*(.+)"
    behind = lambda pattern: F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1)))
    last = strip(F.element_at(F.split(strip(c), "\n"), -1))
    return F.coalesce(last_boxed(c), behind(label), F.regexp_replace(behind(said), r"\.+$", ""), last)


def set_to_pmatrix(c: Column) -> Column:
    """Each {a,b,...} as a column vector; a backslash parts its entries."""
    sets = F.regexp_extract_all(strip(c), F.lit(r"\{.*,.*\}"), F.lit(0))
    vector = lambda m: F.concat(
        F.lit("\\begin{pmatrix}"), put(F.regexp_replace(m, r"^[{}]+|[{}]+$", ""), ",", "\\"), F.lit("\\end{pmatrix}")
    )
    return F.array_join(F.transform(sets, vector), ", ")


def to_interval(c: Column) -> Column:
    """struct(lo, lo_closed, hi, hi_closed) of interval notation or of a one-variable inequality; null if it is neither."""
    s = put(put(c, "\\infty", "oo"), "+oo", "oo")
    shape = r"^\s*([(\[])\s*(.+?)\s*,\s*(.+?)\s*([)\]])\s*$"
    part = lambda i: F.regexp_extract(s, shape, i)
    made = lambda lo, lc, hi, hc: F.struct(lo.alias("lo"), lc.alias("lo_closed"), hi.alias("hi"), hc.alias("hi_closed"))
    q = put(put(c, "\\le", "≤"), "\\ge", "≥")
    one = r"^[a-z]\s*([≤<≥>])\s*(.+)$"
    op, bound = F.regexp_extract(q, one, 1), strip(F.regexp_extract(q, one, 2))
    two = r"^(.+?)\s*([≤<])\s*[a-z]\s*([≤<])\s*(.+)$"
    t = lambda i: F.regexp_extract(q, two, i)
    yes = lambda x: F.lit(x)
    return (
        F.when(s.rlike(shape), made(strip(part(2)), part(1) == "[", strip(part(3)), part(4) == "]"))
        .when(q.rlike(one) & op.isin("≤", "<"), made(yes("-oo"), yes(False), bound, op == "≤"))
        .when(q.rlike(one), made(bound, op == "≥", yes("oo"), yes(False)))
        .when(q.rlike(two), made(strip(t(1)), t(2) == "≤", strip(t(4)), t(3) == "≤"))
    )


def inequality_chain(c: Column) -> Column:
    """struct(terms, ops) of a chain of inequalities, read so that its first operator points up; null if there is none."""
    s = put(put(put(put(c, "\\le", "≤"), "\\ge", "≥"), "\\lt", "<"), "\\gt", ">")
    terms = F.transform(F.split(strip(s), r"\s*[<>≤≥]\s*"), strip)
    ops = F.regexp_extract_all(s, F.lit("[<>≤≥]"), F.lit(0))
    down = F.get(ops, F.lit(0)).isin(">", "≥")
    turned = F.transform(F.reverse(ops), lambda o: F.translate(o, "<>≤≥", "><≥≤"))
    return F.when(
        F.size(ops) > 0,
        F.struct(
            F.when(down, F.reverse(terms)).otherwise(terms).alias("terms"),
            F.when(down, turned).otherwise(ops).alias("ops"),
        ),
    )


def may_evaluate(c: Column, forbidden: tuple[str, ...] = ("^{", "^(")) -> Column:
    """Whether an expression is plain enough for algebra: two unknown letters at most, and no forbidden exponent."""
    bare = F.regexp_replace(F.regexp_replace(c, "sqrt|frac", ""), r"[^a-zA-Z]", "")
    letters = F.size(F.array_distinct(F.filter(F.split(bare, ""), lambda x: x != "")))
    return (letters <= 2) & ~reduce(
        lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in forbidden]
    ) & ~c.rlike(r"\^[0-9]+\^|\^[0-9][0-9]+")


# Units that the grade normaliser drops, and words for powers of ten, in order.
UNITS = [
    "degree",
    "cm",
    "centimeter",
    "meter",
    "mile",
    "second",
    "minute",
    "hour",
    "day",
    "week",
    "month",
    "year",
    "foot",
    "feet",
    "inch",
    "yard",
]
POWERS = [("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]


def boxed_only(c: Column) -> Column:
    """Contents of the last boxed answer; null without one, where it never closes, or where the last is an fbox."""
    return F.when(F.contains(c, F.lit("\\boxed")), last_boxed(c, trim=False))


def simple_normalised(c: Column) -> Column:
    """struct(number, text): lower case without $ , %, as a number where it is one."""
    text = strip(F.regexp_replace(F.lower(strip(c)), r"[$,%]", ""))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.struct(number.alias("number"), F.when(number.isNull(), text).alias("text"))


def undollared(c: Column, mark: str = "$") -> Column:
    n = len(mark)
    return F.when(
        c.startswith(mark) & c.endswith(mark) & (F.length(c) >= 2 * n),
        strip(F.substr(c, F.lit(n + 1), F.length(c) - 2 * n)),
    ).otherwise(c)


def truth_normalised(c: Column) -> Column:
    """A reference answer in the form that answers of a model get."""
    bare = undollared(strip(c))
    return let(
        bare,
        lambda x: let(
            extract_answer(x, use_last_number=False),
            lambda e: F.when(F.coalesce(e, F.lit("")) == "", strip_string(x)).otherwise(strip_string(e)),
        ),
    )


def deep_normalised(c: Column) -> Column:
    """Without option labels, dollar signs and broken commands, before the normal form."""
    s = undollared(undollared(strip(c)), "$$")
    s = unicode_to_latex(F.regexp_replace(s, r"^[A-D]\.\s*", ""))
    s = F.regexp_replace(s, r"sqrt\(([^)]+)\)", r"\\sqrt{$1}")
    s = put(put(s, "\\text{rac}", "\\frac"), "\x0crac", "\\frac")
    s = F.regexp_replace(s, r"(?<!\\f)(?<![a-z])rac\{", r"\\frac{")
    s = put(s, "\\wedgeq", "\\wedge q")
    s = F.regexp_replace(s, r"\\(mathrm|text)\{e\}", "e")
    s = F.regexp_replace(s, r"\\frac\{([^}]+)\}\{1\}", "$1")
    s = fold(s, [("\\[", "["), ("\\]", "]"), ("\\left", ""), ("\\right", "")])
    return let(strip(F.regexp_replace(s, r"\s+", " ")), strip_string)


def competition_form(c: Column) -> Column:
    """The competition normal form; the trimmed answer itself where its commands break off."""
    answer = strip(c)
    inner = F.regexp_extract(answer, r"^\\text\{(.+?)\}$", 1)
    return let(F.when(inner != "", strip(inner)).otherwise(answer), lambda a: F.coalesce(competition_steps(a), a))


def competition_steps(a: Column) -> Column:
    """Null where the answer breaks off."""
    s = fold(
        a,
        [
            ("\n", ""),
            ("\\!", ""),
            ("\\\\", "\\"),
            ("tfrac", "frac"),
            ("dfrac", "frac"),
            ("\\left", ""),
            ("\\right", ""),
            ("^{\\circ}", ""),
            ("^\\circ", ""),
            ("\\$", ""),
        ],
    )
    units = lambda v: F.split(v, r"\\text\{ ")
    s = let(s, lambda v: F.when(F.size(units(v)) <= 2, F.get(units(v), F.lit(0))))
    s = fold(s, [("\\%", ""), (" .", " 0."), ("{.", "{0.")])
    s = F.regexp_replace(s, r"^\.", "0.")
    sides = lambda v: F.split(v, "=")
    s = let(
        s,
        lambda v: F.when(
            (F.size(sides(v)) == 2) & (F.length(F.get(sides(v), F.lit(0))) <= 2), F.get(sides(v), F.lit(1))
        ).otherwise(v),
    )
    roots = lambda v: F.slice(F.split(v, r"\\sqrt"), 2, 1 << 20)
    s = let(
        s,
        lambda v: F.when(
            ~F.exists(roots(v), lambda x: x == ""), F.regexp_replace(v, r"(?s)\\sqrt([^{])", r"\\sqrt{$1}")
        ),
    )
    short = lambda v: F.get(
        F.filter(F.slice(F.split(v, r"\\frac"), 2, 1 << 20), lambda x: ~x.startswith("{") & (F.length(x) < 2)), F.lit(0)
    )
    s = let(put(s, " "), lambda v: F.when(F.coalesce(short(v), F.lit("x")) != "", braced_fractions(v)))
    whole = r"(-?[1-9]\d*|0)"
    return let(
        s,
        lambda v: F.when(v == "0.5", F.lit("\\frac{1}{2}")).otherwise(
            F.regexp_replace(v, rf"^{whole}/{whole}$", r"\\frac{$1}{$2}")
        ),
    )


#: Commands as text.
SYMBOLS = {"pi": "pi", "infty": "inf", "cup": "U", "cap": "∩", "cdot": "*", "times": "*", "div": "÷", "pm": "±", "leq": "≤"}
SYMBOLS |= {"le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "in": "∈", "ldots": "…"}


def latex_text(c: Column) -> Column:
    """LaTeX as plain text: fractions a/b behind a space, roots sqrt(a) without their index, Greek letters, no commands.

    Each turn takes the innermost braces away, so there are as many turns as braces are nested. Fractions get no
    parentheses, since answers are compared as the text has them.
    """
    s = fold(c, [("\\tfrac", "\\frac"), ("\\dfrac", "\\frac"), ("\\frac", " \\frac")])
    s = F.regexp_replace(s, r"\\(left|right|displaystyle)(?![a-zA-Z])|\\[,;:! ]", "")
    step = lambda d, ch: F.struct(
        (d["now"] + F.when(ch == "{", 1).otherwise(-1)).alias("now"),
        F.greatest(d["most"], d["now"] + F.when(ch == "{", 1).otherwise(-1)).alias("most"),
    )
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    turns = F.aggregate(F.regexp_extract_all(s, F.lit("[{}]"), F.lit(0)), zero, step)["most"] + 1

    def turn(v: Column) -> Column:
        v = F.regexp_replace(v, r"\\frac\s*([^\s{\\])", r"\\frac{$1}")
        v = F.regexp_replace(v, r"(\\frac\s*\{[^{}]*\})\s*([^\s{\\])", "$1{$2}")
        v = F.regexp_replace(v, r"\\sqrt\s*([^\s{\\\[])", r"\\sqrt{$1}")
        v = F.regexp_replace(v, r"\\(?:text|mathrm|mathbf|textbf|mbox|operatorname)\s*\{([^{}]*)\}", "$1")
        v = F.regexp_replace(v, r"(?<!\\frac)(?<!\\sqrt)(?<![\]}\s])\{([^{}]*)\}", "$1")
        v = F.regexp_replace(v, r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", "$1/$2")
        return F.regexp_replace(v, r"\\sqrt\s*(?:\[[^\]]*\])?\s*\{([^{}]*)\}", "sqrt($1)")

    s = F.aggregate(F.sequence(F.lit(1), turns), s, lambda v, _: turn(v))
    names = algebra.GREEK | SYMBOLS
    known = F.map_from_arrays(*[F.array(*[F.lit(x) for x in column]) for column in (list(names), list(names.values()))])
    parts = F.regexp_extract_all(s, F.lit(r"\\[a-zA-Z]+|\\.?|[^\\]+"), F.lit(0))
    named = lambda x: F.when(x.startswith("\\"), F.coalesce(F.try_element_at(known, F.substring(x, 2, 99)), F.lit(""))).otherwise(x)
    return strip(F.array_join(F.transform(parts, named), ""))


def grade_form(c: Column) -> Column:
    """The grade normal form: no units, signs of money and percent, spaces or braces; whole numbers without decimals."""
    inner = F.regexp_extract(c, r"^\\text\{(.+?)\}$", 1)
    s = F.when(inner != "", inner).otherwise(c)
    s = fold(s, [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), *POWERS])
    for unit in UNITS:
        s = F.regexp_replace(s, rf"{unit}(es)?(s)? *(\^[0-9]+)?", "")
    s = F.regexp_replace(s, r"\^ *\\circ", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)^\{(.*)\}$", "$1"), r",\\! *", "")
    s = let(
        s,
        lambda v: F.when(
            strip(v).rlike(NUMBER) & (F.abs(strip(v).try_cast("double") % 1) < 1e-7),
            F.format_string("%.0f", strip(v).try_cast("double")),
        ).otherwise(v),
    )
    s = let(s, lambda v: F.when(F.contains(v, F.lit("\\")), latex_text(v)).otherwise(v))
    s = F.regexp_replace(F.regexp_replace(strip(s), "- *", "-"), "([0-9]) +([0-9])", "$1+$2")
    s = F.lower(fold(s, [(" ", ""), ("{", ""), ("}", "")]))
    both = let(s, lambda v: F.struct(v.alias("text"), thousands_removed(v).alias("bare")))
    number = lambda x: x["bare"].try_cast("double")
    return let(
        both,
        lambda x: F.when(
            x["bare"].rlike(NUMBER) & (F.abs(number(x) % 1) < 1e-7), F.format_string("%.0f", number(x))
        ).otherwise(x["text"]),
    )


def math_reward(query: Column, prompt: Column, label: Column) -> Column:
    """1.0 where the boxed answer of the response is graded equal to the label, else 0.0."""
    return let(response_part(query, prompt), lambda r: grade_answer(boxed_only(r), label).cast("double"))


def math_equal(p: Column, r: Column) -> Column:
    """Whether two answers are equal by letters, numbers (final when both are), brackets, tuples, matrices by cell,
    equations, or as expressions. Null on either side: false."""
    return _math_equal(p, r)


def algebra_equal(p: Column, r: Column) -> Column:
    """Whether two expressions in LaTeX or infix notation are identical. Null, or one that cannot be read: false."""
    return _algebra_equal(p, r)


def undecided(p: Column, r: Column) -> Column:
    """Whether two answers count as different and one of them cannot be read as an expression, though both hold letters."""
    return _undecided(p, r)


def enhanced_equal(p: Column, r: Column) -> Column:
    """math_equal, or that of deep normal forms, equal intervals, equal chains of inequalities, or equal values."""

    def side(c: Column) -> Column:
        interval, chain = to_interval(c), inequality_chain(c)
        closed = F.when(interval.isNotNull(), F.concat(interval["lo_closed"].cast("string"), interval["hi_closed"].cast("string")))
        signs = F.array_join(chain["ops"], "")
        ends = F.transform(F.array(interval["lo"], interval["hi"]), strip_string)
        terms = F.transform(chain["terms"], strip_string)
        return F.array(F.array(deep_normalised(c)), ends, F.array(closed), terms, F.array(signs))

    return _forms_equal(p, r, F.transform(F.array(p, r), side))


def grade_answer(given: Column, truth: Column) -> Column:
    """Equal competition forms, or equal grade forms, or equal elements: fractions literally, whole numbers only with
    whole numbers, others by algebra. Null: false."""
    two = F.array(given, truth)
    plain = F.transform(two, competition_form)
    graded = F.transform(two, lambda c: let(grade_form(c), lambda g: F.array(F.array(g), split_tuple(thousands_removed(g)))))
    return _grades_equal(given, truth, plain, graded)


def math_reward(query: Column, prompt: Column, label: Column) -> Column:
    """1.0 where the boxed answer of the response is graded equal to the label, else 0.0."""
    return grade_answer(let(response_part(query, prompt), boxed_only), label).cast("double")


def verify_answer(response: Column, label: Column) -> Column:
    """Whether a response's extracted answer equals the label, both in normal form."""
    return math_equal(extract_answer(response), strip_string(label))


def in_batches(decide):
    """A decision on a row's values over Arrow batches; a null value makes it false."""

    @F.arrow_udf(BooleanType())
    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns))
        return pa.array([None not in row and decide(*row) for row in rows], pa.bool_())

    return run


_math_equal = in_batches(equality.answers_equal)
_algebra_equal = in_batches(algebra.expressions_equal)
_undecided = in_batches(equality.undecided)
_forms_equal = in_batches(lambda p, r, sides: equality.forms_equal(p, r, *sides))
_grades_equal = in_batches(
    lambda given, truth, plain, graded: plain[0] == plain[1]
    or equality.elements_equal(graded[1][0][0], graded[0][0][0], graded[1][1], graded[0][1])
)
