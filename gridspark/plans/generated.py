"""Workbooks made from tables at query time: table -> package bytes, so that a decoder meets known content."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a generated workbook.
BOOK_ROWS = 5000


def books(table: DataFrame, book: Column, name: str, write: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """``path, content``: one workbook per value of ``book``; each must be of bounded size."""
    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [name.format(key[0])], "content": [write(rows)]})

    return table.withColumn("_book", book.cast("string")).groupBy("_book").applyInPandas(make, "path string, content binary")


def value(x):
    """A pandas value as a writer takes it."""
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    return x.item() if hasattr(x, "item") else x


def grid_of(rows: pd.DataFrame, row: str, columns: list[str]) -> list[tuple]:
    return [(int(r[row]), k, value(r[c])) for r in rows.to_dict("records") for k, c in enumerate(columns)]


def row_in_book(key: str, size: int = BOOK_ROWS) -> tuple[Column, Column]:
    """Number of the workbook, and row within it, of a dense key."""
    return F.floor(F.col(key) / size), F.pmod(F.col(key), F.lit(size)).cast("int")
