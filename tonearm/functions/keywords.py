"""Many keywords looked for at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F


def held_keywords(keywords: list[str]):
    """A function of a text column: the distinct keywords that a text holds, found in one pass over it."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k in keywords:
            machine.add_word(k, k)
        if keywords:
            machine.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({k for _, k in machine.iter(x)}) if keywords and x is not None else [] for x in texts], dtype=object)

    return F.pandas_udf(find, "array<string>")
