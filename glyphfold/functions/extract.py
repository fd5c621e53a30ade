"""Pluggable extractors (UDF2)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

ITEM = "ordinal int, kind string, text string"
_TAG = re.compile(r"<(title|h1|p)>([^<]*)")


def html_items(payload: str) -> Iterable[tuple[int, str, str]]:
    """The extractor that comes with the library: title, heading and paragraph starts."""
    for ordinal, found in enumerate(_TAG.finditer(payload)):
        yield ordinal, found.group(1), found.group(2)


def extract(
    df: DataFrame, key: str, payload: str, extractor: Callable[[str], Iterable[tuple]] = html_items, item_schema: str = ITEM
) -> DataFrame:
    """UDF2: run an extractor over every payload; one row per item.

    Payloads come in Arrow batches and leave as batches; nothing is grouped.
    """
    key_type = dict(df.dtypes)[key]
    names = [part.strip().split()[0] for part in item_schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, *item)
                for k, text in zip(batch[key], batch[payload])
                if text is not None
                for item in extractor(text)
            ]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, payload).mapInPandas(run, f"{key} {key_type}, {item_schema}")
