"""One workbook as an object, for code that walks sheets instead of querying a corpus."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from ..operators import relations
from ..sources.formula_tokens import letters
from ..sources.package import workbooks


def col_to_letter(col: int) -> str:
    """0-based column index to letters."""
    return letters(col)


class Workbook:
    """``with Workbook(spark, "a.xlsb") as book: for sheet, grid in book.iter_values(): ...``

    Each method runs one query over the file. ``.xlsx`` and ``.xlsm`` are read as Open XML,
    anything else as binary.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.books = workbooks(spark, path, "*")

    def __enter__(self) -> Workbook:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open between queries."""

    @property
    def sheet_names(self) -> list[str]:
        return [r.sheet for r in relations.sheets(self.books).orderBy("sheet_idx").collect()]

    def _grids(self, rows, value) -> Iterator[tuple[str, dict[tuple[int, int], object]]]:
        grids: dict[str, dict] = {name: {} for name in self.sheet_names}
        for r in rows:
            grids.setdefault(r.sheet, {})[r.row, r.col] = value(r)
        yield from grids.items()

    def iter_values(self) -> Iterator[tuple[str, dict]]:
        """Every sheet with its values by 0-based (row, col)."""
        shown = lambda r: {"int": r.v_int, "float": r.v_num, "bool": r.v_bool, "error": r.v_err}.get(r.kind, r.v_str)
        yield from self._grids(relations.cells(self.books).orderBy("sheet_idx", "row", "col").toLocalIterator(), shown)

    def iter_formulas(self) -> Iterator[tuple[str, dict]]:
        yield from self._grids(relations.formulas(self.books).orderBy("sheet_idx", "row", "col").toLocalIterator(), lambda r: r.formula)

    def iter_filters(self) -> Iterator[dict]:
        """The filters of the sheets that have one."""
        for r in relations.auto_filters(self.books).orderBy("sheet_idx").toLocalIterator():
            yield {k: v for k, v in r.asDict(True).items() if k not in ("path", "sheet_idx")}

    def iter_pivot_tables(self) -> Iterator[dict]:
        for r in relations.pivot_tables(self.books).orderBy("sheet", "part").toLocalIterator():
            yield {k: v for k, v in r.asDict(True).items() if k != "path"}

    def iter_vba_modules(self) -> Iterator[tuple[str, str]]:
        for r in relations.vba_modules(self.books).orderBy("module").toLocalIterator():
            yield r.module, r.source
