"""String predicates, parsers and cleaners as Column functions: all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide results.
SOLUTION_MARKERS = [
    "therefore, the answer is",
    "the final answer is",
    "\\boxed{",
    "hence, the answer",
    "so the answer is",
    "the solution is",
    "we get the answer",
    "step 1:",
    "step 2:",
]
PROBLEM_MARKERS = [
    "find",
    "compute",
    "calculate",
    "determine",
    "prove",
    "how many",
    "what is",
    "evaluate",
    "solve",
    "show that",
    "if ",
    "given ",
    "let ",
    "suppose",
    "?",
]
CHOICE_MARKERS = ["(A)", "(B)", "(C)", "(a)", "(b)", "(c)"]
PREAMBLES = [
    "Here is the new problem:",
    "Here is the rewritten problem:",
    "Here is the evolved problem:",
    "Here is the transformed problem:",
    "Here's the new problem:",
    "Here's the transformed problem:",
    "New problem:",
    "**Problem:**",
    "**New Problem:**",
    "**Problem Statement:**",
]
SOLUTION_STARTS = ["\n**Solution", "\nSolution:", "\n**Answer", "\nAnswer:", "\n**Hint", "\nHint:", "\n---\n"]
LATEX_COMMANDS = r"\\(frac|sqrt|left|right|text|cdot|pi|infty|cup|cap|complement|mathbb|leqslant|geqslant|neq|le|ge|lt|gt|pm|mp|times|div|circ|boxed|overline|underline|hat|bar|vec|sum|prod|int|lim|log|ln|sin|cos|tan|cot|sec|csc|arcsin|arccos|arctan)"
UNICODE_MATH = {
    "√": "\\sqrt",
    "×": "\\times",
    "÷": "\\div",
    "±": "\\pm",
    "∓": "\\mp",
    "π": "\\pi",
    "∞": "\\infty",
    "≤": "\\le",
    "≥": "\\ge",
    "≠": "\\ne",
    "∪": "\\cup",
    "∩": "\\cap",
    "∈": "\\in",
    "⊂": "\\subset",
    "⊆": "\\subseteq",
}


def strip(c: Column) -> Column:
    """Without white space (any Unicode) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(c: Column, f) -> Column:
    """f(c) with c computed once, however often f names it: nested conditions would else double the expression each time."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def put(c: Column, old: str, new: str = "") -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def count_of(c: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(m)).cast("int") for m in markers])


def is_likely_solution(c: Column) -> Column:
    return count_of(F.lower(c), SOLUTION_MARKERS) >= 2


def is_likely_problem(c: Column) -> Column:
    return count_of(F.lower(c), PROBLEM_MARKERS) >= 1


def is_multiple_choice(c: Column) -> Column:
    return count_of(c, CHOICE_MARKERS) >= 1


def has_image(c: Column) -> Column:
    return c.rlike(r"!\[.*?\]\(.*?\)")


def is_multi_select(c: Column) -> Column:
    return F.upper(strip(c)).rlike(r"^[A-D]{2,4}$")


def answer_too_complex(c: Column) -> Column:
    return (F.length(c) > 150) | F.contains(c, F.lit("\n"))


def has_chinese(c: Column) -> Column:
    return c.rlike("[\\x{4e00}-\\x{9fff}]")


def needs_conversion(c: Column) -> Column:
    """Set-builder notation with a relation in it."""
    return c.rlike(r"\\mid|\\vert") & c.rlike(r"[<>]|leqslant|geqslant|\\le[^f]|\\ge[^n]")


def strip_think(c: Column, unclosed: bool = True) -> Column:
    """Without closed think blocks, and (unclosed) without one that never ends."""
    c = strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    return strip(F.regexp_replace(c, r"(?s)<think>.*", "")) if unclosed else c


def gsm8k_label(c: Column) -> Column:
    """What stands behind ####, to the line's end; null if nothing does."""
    return F.nullif(strip(F.regexp_extract(c, r"####\s*(.+?)(\n|$)", 1)), F.lit(""))


def gsm8k_clean(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"<<.*?>>", ""), r"(?s)####.*", ""))


def last_boxed(c: Column, trim: bool = True) -> Column:
    """Contents of the last \\boxed{...} with balanced braces; null if there is none or it never closes."""
    tail = F.element_at(F.split(c, r"\\boxed\{"), -1)
    step = lambda s, ch: F.when(s["depth"] == 0, s).otherwise(
        F.struct(
            (s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("depth"),
            F.when((ch == "}") & (s["depth"] == 1), s["text"]).otherwise(F.concat(s["text"], ch)).alias("text"),
        )
    )
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("text"))
    found = F.aggregate(F.split(tail, ""), start, step)
    text = F.when(F.contains(c, F.lit("\\boxed{")) & (found["depth"] == 0), found["text"])
    return strip(text) if trim else text


def label_cascade(c: Column) -> Column:
    """#### label, else the last boxed answer, else the text itself."""
    return F.coalesce(gsm8k_label(c), last_boxed(c), strip(c))


def parse_keep(c: Column) -> Column:
    """Whether a judge says keep: its verdict line, else the words in it, else yes."""
    stated = F.upper(F.regexp_extract(c, r"(?i)VERDICT:\s*(KEEP|REMOVE)", 1))
    upper = F.upper(c)
    return F.when(stated != "", stated == "KEEP").when(
        F.contains(upper, F.lit("REMOVE")), F.lit(False)
    ).otherwise(F.lit(True))


def parse_accept(c: Column) -> Column:
    """struct(accept, reason) of a strict judge: the first line that begins with a verdict, else any mention, else no."""
    text = strip_think(c)
    lines = F.transform(F.split(text, "\n"), strip)
    verdict = F.get(
        F.filter(lines, lambda x: F.upper(x).startswith("ACCEPT") | F.upper(x).startswith("REJECT")), F.lit(0)
    )
    yes = F.upper(verdict).startswith("ACCEPT")
    upper = F.upper(text)
    said = F.contains(upper, F.lit("ACCEPT"))
    accept = F.when(verdict.isNotNull(), yes).otherwise(said)
    reason = F.when(accept, F.lit("ACCEPT")).when(verdict.isNotNull(), verdict).when(
        F.contains(upper, F.lit("REJECT")), F.regexp_extract(text, r"(?i)REJECT[:\s]*(.*)", 0)
    ).otherwise(F.lit("REJECT: no clear judgment"))
    return F.struct(accept.alias("accept"), reason.alias("reason"))


def is_yes(c: Column) -> Column:
    return F.upper(strip(c)).startswith("YES")


def without_preamble(p: str):
    return lambda v: F.when(F.lower(v).startswith(p.lower()), strip(F.substring(v, len(p) + 1, 1 << 30))).otherwise(v)


def without_solution(m: str):
    return lambda v: F.when(F.instr(v, m) > 51, strip(F.substring_index(v, m, 1))).otherwise(v)


def extract_problem(c: Column) -> Column:
    """A generated problem without thinking, preambles (each removed in turn) and whatever solution follows."""
    text = strip_think(c, unclosed=False)
    for p in PREAMBLES:
        text = let(text, without_preamble(p))
    for m in SOLUTION_STARTS:
        text = let(text, without_solution(m))
    return text


def wrap_latex(c: Column) -> Column:
    c = strip(c)
    done = (c == "") | (c.startswith("$") & c.endswith("$"))
    return F.when(
        ~done & (c.rlike(LATEX_COMMANDS) | F.contains(c, F.lit("\\{")) | F.contains(c, F.lit("\\}"))),
        F.concat(F.lit("$"), c, F.lit("$")),
    ).otherwise(c)


def unicode_to_latex(c: Column) -> Column:
    for symbol, command in UNICODE_MATH.items():
        c = put(c, symbol, command)
    return F.regexp_replace(c, r"\\sqrt(\d+)", r"\\sqrt{$1}")


def collapsed(c: Column) -> Column:
    """The text in lower case with white space collapsed."""
    return F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " ")


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the collapsed text; none if it is shorter than n."""
    text = collapsed(c)
    # an array of characters: substr() would walk a long text from its start for every n-gram
    own = lambda v: F.array_distinct(
        F.transform(F.sequence(F.lit(0), F.size(v) - n), lambda i: F.concat(*[F.get(v, i + k) for k in range(n)]))
    )
    return let(F.split(text, ""), lambda v: F.when(F.size(v) < n, F.array().cast("array<string>")).otherwise(own(v)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    sizes = F.struct(F.size(a).alias("a"), F.size(b).alias("b"), F.size(F.array_intersect(a, b)).alias("both"))
    return let(
        sizes,
        lambda n: F.when((n["a"] == 0) | (n["b"] == 0), F.lit(0.0)).otherwise(n["both"] / (n["a"] + n["b"] - n["both"])),
    )


def json_object(c: Column, schema: str, required: list[str]) -> Column:
    """The outermost JSON object in free text, trailing commas mended; null without it or a required key."""
    raw = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    whole = lambda v: F.when(reduce(lambda a, b: a & b, [v[k].isNotNull() for k in required]), v)
    return F.coalesce(
        whole(F.from_json(raw, schema)), whole(F.from_json(F.regexp_replace(raw, r",\s*([}\]])", "$1"), schema))
    )


def template(pattern: str, c: Column) -> Column:
    return F.replace(F.lit(pattern), F.lit("{}"), c)


def thousands_removed(c: Column) -> Column:
    """Without commas between groups of three digits."""
    return F.regexp_replace(c, r"(?<=\d),(?=\d{3}($|\D|,\d{3}))", "")


def split_tuple(c: Column) -> Column:
    """Parts of a bracketed tuple, trimmed; a text without brackets is one part."""
    inner = F.regexp_extract(c, r"^[(\[](.*)[)\]]$", 1)
    return F.when(inner != "", F.transform(F.split(inner, ","), strip)).otherwise(F.array(c))


def first_line(c: Column) -> Column:
    return strip(F.get(F.split(strip_think(c, unclosed=False), "\n"), F.lit(0)))


def question_blocks(c: Column) -> Column:
    """array<struct<num, raw>>: the text cut before each "N.【" at a line's start, with a full-width or half-width dot."""
    head = r"(?:^|\n)\s*-?\s*\d{1,4}\s*[.．。·]\s*【"
    marked = F.regexp_replace(c, rf"({head})", "\u0001$1")
    blocks = F.transform(F.slice(F.split(marked, "\u0001"), 2, 1 << 20), strip)
    return F.transform(
        blocks, lambda b: F.struct(F.regexp_extract(b, r"^-?\s*(\d{1,4})", 1).cast("int").alias("num"), b.alias("raw"))
    )


def response_part(query: Column, prompt: Column) -> Column:
    """The query behind the prompt's length, if the prompt occurs in it."""
    return F.when(
        F.coalesce(F.contains(query, prompt), F.lit(False)), F.substr(query, F.length(prompt) + 1)
    ).otherwise(query)


def json_array(c: Column, schema: str) -> Column:
    """The objects of the outermost JSON array in free text; where it cannot be read, each flat object that has a
    question and an answer."""
    whole = F.from_json(F.regexp_extract(c, r"(?s)\[.*\]", 0), f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    parts = F.transform(
        F.regexp_extract_all(c, F.lit(r"\{[^{}]+\}"), F.lit(0)), lambda x: F.from_json(x, f"struct<{schema}>")
    )
    single = F.filter(parts, lambda x: x["question"].isNotNull() & x["answer"].isNotNull())
    return F.when(F.size(whole) > 0, whole).otherwise(single)


def log_line(ts: Column, prefix: Column, step: Column, values: Column) -> Column:
    """"[time] prefix step=N | k=v | ...": the map's keys in order, values with six decimals."""
    entries = F.array_sort(F.map_entries(values))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"])))
    head = F.concat(
        F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), prefix, F.lit(" step="), step.cast("string")
    )
    return F.concat_ws(" | ", F.array(head), shown)


def file_number(name: Column, missing: int = 999) -> Column:
    """The lecture number in a file's name, by which files are ordered."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"第(\d+)讲", 1), F.lit("")).cast("int"), F.lit(missing))
