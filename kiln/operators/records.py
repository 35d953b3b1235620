"""Row-wise choices and look-ups: fields, defaults, filters, joins by key, place and registry, and what they count."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.lineage import running


def without(df: DataFrame, *columns: str) -> DataFrame:
    """df without columns that are heavy or already mapped; names that it lacks do no harm."""
    return df.drop(*columns)


def selected(df: DataFrame, *fields: str) -> DataFrame:
    return df.select(*[F.col(f"`{f}`") for f in fields])


def chosen_answer(correct: Column, corrected: Column, answer: Column) -> Column:
    """The corrected answer unless the answer is right; null counts as not right."""
    return F.when(F.coalesce(correct, F.lit(False)), answer).otherwise(corrected)


def with_fallback(parsed: Column, field: str, original: Column) -> Column:
    """A field of a parsed object, or the original where nothing was parsed."""
    return F.coalesce(parsed[field], original)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls and columns that are absent become their defaults."""
    have = set(df.columns)
    return df.withColumns(
        {c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()}
    )


def teacher_prompt(template: str, label: Column, reference: Column) -> Column:
    """template with {label}, and with {reference_section} where there is a reference solution."""
    some = F.coalesce(reference, F.lit("")) != ""
    section = F.when(some, F.concat(F.lit("Reference solution:\n"), reference, F.lit("\n\n"))).otherwise("")
    return F.replace(F.replace(F.lit(template), F.lit("{reference_section}"), section), F.lit("{label}"), label)


def long_problem(text: Column, least: int = 20) -> Column:
    return F.length(text) >= least


def certain(se: Column, most: float | None) -> Column:
    """se <= most; without a bound all rows, null entropies too."""
    return F.lit(True) if most is None else F.coalesce(se <= most, F.lit(False))


def rounds(seeds: DataFrame, limit: int, evolve: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """What evolve makes of the seeds that still have rounds (evol_rounds >= r), round by round, until none are left."""
    out, now = None, seeds
    for r in range(1, limit + 1):
        now = now.filter(F.col("evol_rounds") >= r)
        if now.isEmpty():
            break
        now = evolve(now, r)
        out = now if out is None else out.unionByName(now)
    return seeds.limit(0) if out is None else out


def by_label(df: DataFrame, label: str, value: str, *by: str) -> DataFrame:
    """(by, good, bad): means of the rows labelled 1 and of those labelled 0."""
    mean = lambda v: F.avg(F.when(F.col(label) == v, F.col(value)))
    return df.groupBy(*by).agg(mean(1).alias("good"), mean(0).alias("bad"))


def with_verdicts(pairs: DataFrame, verdicts: DataFrame, *key: str) -> DataFrame:
    """pairs with `equal` of verdicts (one row a key); a pair without a verdict is not equal."""
    return pairs.join(
        verdicts.select(*key, "equal"), list(key), "left"
    ).withColumn("equal", F.coalesce("equal", F.lit(False)))


def last_written(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): of rows with one key the last in order."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def registered(names: DataFrame, registry: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key the registry has, with its columns; and the names it does not know, each once."""
    return names.join(registry, key), names.select(key).distinct().join(registry, key, "left_anti")


def zipped(left: DataFrame, right: DataFrame, row: str) -> DataFrame:
    """Entries with their outputs by a row id that both carry: never by the order in which they happen to come."""
    return left.join(right, row)


def scattered(results: DataFrame, places: DataFrame, i: str, target: str) -> DataFrame:
    """results in their original order: places gives the place that result i came from; `place` numbers the output."""
    return results.join(places.select(i, F.col(target).alias("place")), i).drop(i)


def to_samples(prompts: DataFrame, responses: str, sample: str = "response") -> DataFrame:
    """A row for each response of a prompt, with the prompt's other columns and the response's number."""
    others = [c for c in prompts.columns if c != responses]
    return prompts.select(*others, F.posexplode(responses).alias("n", sample))


def success_counts(df: DataFrame, parsed: Column, fallback: Column) -> DataFrame:
    """(success, fallback, failed): rows parsed, rows that kept their original, rows with neither."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    ok, kept = parsed.isNotNull(), parsed.isNull() & fallback.isNotNull()
    return df.agg(n(ok).alias("success"), n(kept).alias("fallback"), n(~ok & ~kept).alias("failed"))


def verified_share(df: DataFrame, verified: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.col(verified).cast("long")), F.lit(0)).alias("verified"),
        F.avg(F.coalesce(F.col(verified), F.lit(False)).cast("double")).alias("share"),
    )


def in_blocks(df: DataFrame, doc: str, start: str, length: str) -> DataFrame:
    """Adds `stop`: where the next block of the document starts, or the document's end."""
    return df.withColumn("stop", F.coalesce(F.lead(start).over(Window.partitionBy(doc).orderBy(start)), F.col(length)))


def shards_joined(parts: list[DataFrame]) -> DataFrame:
    """What ranks wrote, one after another: `rank` and the place in it give `i`, the place in all."""
    rows = None
    for rank, df in enumerate(parts):
        own = df.withColumn("rank", F.lit(rank))
        rows = own if rows is None else rows.unionByName(own)
    return running(rows, ["rank", *[c for c in rows.columns if c != "rank"]])


def mapped(df: DataFrame, change: Callable[[dict], dict], schema: str, keep: Callable[[dict], bool] | None = None) -> DataFrame:
    """Rows through a plain function, and those that keep() takes: for functions that no column expression can say.

    Rows travel in Arrow batches; schema names what change() returns.
    """

    def run(batches):
        for pdf in batches:
            out = [change(r) for r in pdf.to_dict("records") if keep is None or keep(r)]
            yield pd.DataFrame(out, columns=names)

    names = df.sparkSession.createDataFrame([], schema).columns
    return df.mapInPandas(run, schema)


def reward_function(path: str) -> Callable:
    """reward_func of a Python file."""
    spec = importlib.util.spec_from_file_location("reward_file", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.reward_func


def rewarded(
    df: DataFrame, func: Callable, query: str = "query", prompt: str = "prompt", label: str = "label"
) -> DataFrame:
    """Adds reward and score: what func(queries, prompts, labels) -> {"rewards", "scores"} gives for each batch of rows."""

    def run(batches):
        for pdf in batches:
            out = func(pdf[query].tolist(), pdf[prompt].tolist(), pdf[label].tolist())
            yield pdf.assign(
                reward=pd.Series([float(x) for x in out["rewards"]], dtype=float),
                score=pd.Series([float(x) for x in out["scores"]], dtype=float),
            )

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", reward double, score double")


# Weights of the evolution strategies by difficulty, and the strategies that later rounds draw from.
TIERS = {
    "easy": {"harder": 0.30, "rewrite": 0.20, "algebraize": 0.15, "apply": 0.15, "compose": 0.10, "competition": 0.10},
    "medium": {
        "harder": 0.25, "rewrite": 0.15, "algebraize": 0.15, "apply": 0.15, "compose": 0.15, "competition": 0.15
    },
    "hard": {"harder": 0.20, "rewrite": 0.15, "algebraize": 0.15, "apply": 0.10, "compose": 0.20, "competition": 0.20},
    "competition": {
        "harder": 0.15, "rewrite": 0.20, "algebraize": 0.15, "apply": 0.10, "compose": 0.20, "competition": 0.20
    },
}
FOLLOWUPS = ["harder", "competition", "compose"]


def strategies(spark) -> DataFrame:
    """(tier, strategy, weight)."""
    return spark.createDataFrame(
        [(t, s, w) for t, own in TIERS.items() for s, w in own.items()], "tier string, strategy string, weight double"
    )


#: What a model is asked for under each strategy; {problem} is the seed problem. A caller may give its own.
PROMPTS = {
    "harder": "Write a harder problem about the same idea as this one:\n\n{problem}",
    "rewrite": "Write this problem anew, in another setting and with other numbers:\n\n{problem}",
    "algebraize": "Put letters in place of the numbers of this problem, and ask for a formula:\n\n{problem}",
    "apply": "Write a problem from everyday life that needs the same steps as this one:\n\n{problem}",
    "compose": "Write one problem that needs this one and another topic to be solved together:\n\n{problem}",
    "competition": "Write this problem as one of a mathematics competition:\n\n{problem}",
}


def evolution_prompts(df: DataFrame, problem: str, strategy: str, prompts: dict[str, str] | None = None) -> DataFrame:
    """Adds prompt: the strategy's template with the problem in it; null for an unknown strategy or a null problem."""
    own = prompts or PROMPTS
    text = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    found = F.try_element_at(text, F.col(strategy)) if own else F.lit(None).cast("string")
    return df.withColumn("prompt", F.replace(found, F.lit("{problem}"), F.col(problem)))


def tier_weights(difficulty: str) -> dict[str, float]:
    """Weights of a difficulty; an unknown one draws as a medium one."""
    return TIERS.get(difficulty, TIERS["medium"])
