"""Chat messages, prompts, token ranges and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def messages(system: Column, user: Column, shots: Column | None = None) -> Column:
    """[system, shots..., user] as array<struct<role, content>>; a null system prompt is left out."""
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    parts = [
        F.when(system.isNotNull(), F.array(said("system", system))).otherwise(
            F.array().cast("array<struct<role:string,content:string>>")
        ),
        *([shots] if shots is not None else []),
        F.array(said("user", user)),
    ]
    return F.concat(*parts)


def with_think(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("<think>")), c).otherwise(F.concat(c, F.lit("<think>\n")))


def prefixes(turns: DataFrame, conv: str, turn: str, tokens: str) -> DataFrame:
    """For each assistant turn the tokens before it and its closed token range in the conversation."""
    w = Window.partitionBy(conv).orderBy(turn)
    before = F.coalesce(F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.withColumn("start", before).withColumn("stop", before + F.col(tokens) - 1).withColumn(
        "turns_before", F.row_number().over(w) - 1
    ).filter("role = 'assistant'")


def long_enough(prompt_len: Column, response_len: Column, most: int) -> Column:
    return (prompt_len > 0) & (response_len > 0) & (prompt_len < most - 2)


def prompt_fits(prompt_len: Column, most: int) -> Column:
    """Whether a prompt, cut to `most` tokens, leaves two for an answer: for pairs of direct preference and for unpaired
    rows. Rows of a reward model are not filtered."""
    return F.least(prompt_len, F.lit(most)) < most - 2


def template_for(dataset: Column, templates: dict[str, list[str]], default: list[str], shots: int) -> Column:
    """The first `shots` examples of the template that a data set's short name asks for, else of the default."""
    name = F.lower(F.element_at(F.split(dataset, "/"), -1))
    some = lambda own: F.array(*[F.lit(x) for x in own[:shots]]).cast("array<string>")
    out = some(default)
    for short, own in templates.items():
        out = F.when(name == short, some(own)).otherwise(out)
    return out


def range_mask(n: Column, ranges: Column) -> Column:
    """Booleans of length n, true inside any closed range."""
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.exists(ranges, lambda r: i.between(r["start"], r["stop"]))),
    ).otherwise(F.array().cast("array<boolean>"))


def padded(arr: Column, n: Column, value, left: bool = False) -> Column:
    fill = F.array_repeat(value, n - F.size(arr))
    return F.concat(fill, arr) if left else F.concat(arr, fill)


def unpadded(arr: Column, mask: Column) -> Column:
    return F.filter(arr, lambda x, i: F.get(mask, i) == 1)


def placeholders(ids: Column, labels: Column, mark: int, ignore: int = -100) -> Column:
    """labels at the places of the mark, in turn; ignore elsewhere and where labels run out."""
    at = lambda i: F.size(F.filter(F.slice(ids, 1, i), lambda x: x == mark))
    return F.transform(
        ids, lambda x, i: F.when(x == mark, F.coalesce(F.get(labels, at(i)), F.lit(ignore))).otherwise(ignore)
    )


def with_eos(ids: Column, eos: int) -> Column:
    return F.when(F.element_at(ids, -1) == eos, ids).otherwise(F.concat(ids, F.array(F.lit(eos))))
