"""Where a model would be called: prompts in, texts out. The stub is deterministic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Generate = Callable[[list[str]], list[list[str]]]


def generate(df: DataFrame, prompt: str, call: Generate, attempts: int = 3) -> DataFrame:
    """Adds `texts`: what call gives for each batch of prompts, and `error`: null, or why a prompt has no texts. A failed batch
    is halved, attempts times, and what fails then has no texts."""

    def ask(prompts: list[str], left: int) -> list[tuple[list[str], str | None]]:
        try:
            return [(texts, None) for texts in call(prompts)]
        except Exception as e:  # noqa: BLE001  providers fail in their own ways
            if left <= 0 or len(prompts) == 1:
                return [([], f"{type(e).__name__}: {e}") for _ in prompts]
            half = len(prompts) // 2
            return ask(prompts[:half], left - 1) + ask(prompts[half:], left - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = ask(pdf[prompt].tolist(), attempts)
            yield pdf.assign(texts=[t for t, _ in found], error=[e for _, e in found])

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", texts array<string>, error string")


def stub(prompts: list[str]) -> list[list[str]]:
    return [[p.upper()] for p in prompts]
