"""The public relations over a corpus of workbooks: both formats, one schema each.

``books`` is a DataFrame with ``path, content``. Each function inflates only the parts it
needs; pass ``sheet`` to decode only the sheets of that name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import biff12, ooxml, package, vba

BOOK = r"^xl/(?:_rels/)?workbook\.(?:xml|bin)(?:\.rels)?$"
STRINGS = r"^xl/sharedstrings\.(?:xml|bin)$"
FORMATS = ("xlsx", "xlsb")
PIVOTS = r"/pivottables/|/pivottables/_rels/|^xl/worksheets/_rels/"

CELLS = ["path", "sheet_idx", "sheet", "row", "col", "addr", "kind", "v_int", "v_num", "v_str", "v_bool", "v_err", "from_formula"]
FORMULAS = ["path", "sheet_idx", "sheet", "row", "col", "addr", "formula", "formula_kind", "parse_error"]
FILTERS = ["path", "sheet_idx", "sheet", "ref", "top_left", "bottom_right", "columns"]
PIVOT_COLUMNS = [
    "path", "sheet", "part", "name", "cache_id", "data_caption", "pivot_cache_definition", "pivot_fields", "pivot_items", "location", "row_fields",
    "col_fields", "data_fields", "report_filters", "sx_filters",
]


def _parts(books: DataFrame, *wanted: str) -> DataFrame:
    return package.parts(books, "|".join(wanted))


def sheets(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """``path, format, sheet_idx, sheet, rel_id, part`` in tab order by ``sheet_idx``."""
    every = package.sheet_table(books)
    return every.filter(F.col("sheet") == sheet) if sheet is not None else every


def defined_names(books: DataFrame) -> DataFrame:
    found = _parts(books, BOOK)
    return package.ooxml_defined_names(found).unionByName(biff12.defined_names(found))


def shared_strings(books: DataFrame) -> DataFrame:
    found = _parts(books, STRINGS)
    return ooxml.shared_strings(found).unionByName(biff12.shared_strings(found))


def cells(books: DataFrame, sheet: str | None = None, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """The sparse typed grid in long form. No join and no shuffle.

    Each format is a branch of its own over ``books``; where a corpus is read with a glob for
    one format, name it in ``formats`` and its files are read once.
    """
    return _both({"xlsx": lambda: ooxml.cells(books, sheet), "xlsb": lambda: biff12.cells(books, sheet)}, formats, CELLS)


def formulas(books: DataFrame, sheet: str | None = None, functions: dict | None = None, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """Formula cells as text, shared ones resolved. ``functions`` replaces the table of worksheet functions."""
    return _both({"xlsx": lambda: ooxml.formulas(books, sheet), "xlsb": lambda: biff12.formulas(books, sheet, functions)}, formats, FORMULAS)


def auto_filters(books: DataFrame, sheet: str | None = None, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """One row per sheet that has a filter."""
    return _both({"xlsx": lambda: ooxml.auto_filters(books, sheet), "xlsb": lambda: biff12.auto_filters(books, sheet)}, formats, FILTERS)


def _both(branches: dict, formats: tuple[str, ...], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (branches[f]().select(*columns) for f in formats))


def pivot_links(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """Link traversal as joins: sheet -> its relationships -> pivot parts -> the first cache definition.

    For analyses of the links themselves; ``pivot_tables`` follows them inside each package.
    ``path, sheet_idx, sheet, pivot_part, cache``; of the sheets that share a part the first one.
    """
    links = package.rels(_parts(books, BOOK, PIVOTS))
    hop = links.select("path", F.lower("source_part").alias("source"), "resolved", "rel_seq")
    first = Window.partitionBy("path", F.lower("pivot_part")).orderBy("sheet_idx", "rel_seq")
    found = (
        sheets(books).withColumn("source", F.lower("part")).join(hop, ["path", "source"])
        .filter(F.lower("resolved").contains("/pivottables/")).withColumnRenamed("resolved", "pivot_part")
        .withColumn("_n", F.row_number().over(first)).filter("_n = 1")
        .select("path", "sheet_idx", "sheet", "pivot_part")
    )
    caches = (
        hop.filter(F.lower("resolved").contains("/pivotcache/pivotcachedefinition"))
        .groupBy("path", "source").agg(F.min_by("resolved", "rel_seq").alias("cache"))
    )
    out = found.withColumn("source", F.lower("pivot_part")).join(caches, ["path", "source"], "left").drop("source")
    return out.filter(F.col("sheet") == sheet) if sheet is not None else out


def pivot_tables(books: DataFrame, sheet: str | None = None, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """Metadata of the pivot tables that sheets link to; nothing is shuffled."""
    return _both({"xlsx": lambda: ooxml.pivot_tables(books, sheet), "xlsb": lambda: biff12.pivot_tables(books, sheet)}, formats, PIVOT_COLUMNS)


def vba_modules(books: DataFrame) -> DataFrame:
    """``path, module, module_type, stream_name, code_page, source`` of both formats."""
    return vba.modules(_parts(books, r"^xl/vbaproject\.bin$")).filter("problem is null").drop("problem")


def vba_problems(books: DataFrame) -> DataFrame:
    return vba.modules(_parts(books, r"^xl/vbaproject\.bin$")).filter("problem is not null").select("path", "module", "problem")


def last_write_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of the rows of one key the one written last; one aggregate, no sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*key, "_x.*")


def lookup(rows: DataFrame, table: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Dictionary lookup: a key out of range gives ''."""
    return rows.join(table, key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def grid(cells_: DataFrame, columns: dict[int, str]) -> DataFrame:
    """Rows of a sheet as a table: ``columns`` maps column indexes to names; values are text."""
    value = F.coalesce("v_str", "v_err", F.col("v_int").cast("string"), F.col("v_num").cast("string"), F.col("v_bool").cast("string"))
    own = cells_.filter(F.col("col").isin(*columns)).select("path", "sheet_idx", "sheet", "row", "col", value.alias("value"))
    return own.groupBy("path", "sheet_idx", "sheet", "row").agg(*(F.max(F.when(F.col("col") == k, F.col("value"))).alias(n) for k, n in columns.items()))


def to_cells(table: DataFrame, path: str, sheet: str, row: str, columns: dict[str, int]) -> DataFrame:
    """A table as sparse cells: one row per non-null value. ``row`` is an expression for the 0-based row."""
    from ..functions.cells import address

    kinds = dict(table.dtypes)
    entry = []
    for name, k in columns.items():
        number, text = kinds[name] not in ("string", "boolean"), kinds[name] == "string"
        d = F.col(name).cast("double") if number else F.lit(None).cast("double")
        whole = F.lit(number) & (d == F.floor(d)) & (F.abs(d) < 1e15)
        entry.append(F.struct(
            F.lit(k).alias("col"), F.when(whole, "int").when(F.lit(number), "float").when(F.lit(text), "str").otherwise("bool").alias("kind"),
            F.when(whole, d.cast("bigint")).alias("v_int"), d.alias("v_num"), (F.col(name) if text else F.lit(None).cast("string")).alias("v_str"),
            (F.col(name) if kinds[name] == "boolean" else F.lit(None).cast("boolean")).alias("v_bool"), F.col(name).isNull().alias("absent"),
        ))
    return (
        table.select(F.lit(path).alias("path"), F.lit(0).alias("sheet_idx"), F.lit(sheet).alias("sheet"), F.expr(row).cast("int").alias("row"), F.explode(F.array(*entry)).alias("e"))
        .filter("not e.absent")
        .select("path", "sheet_idx", "sheet", "row", "e.*").drop("absent")
        .select("path", "sheet_idx", "sheet", "row", "col", address("row", "col").alias("addr"), "kind", "v_int", "v_num", "v_str", "v_bool",
                F.lit(None).cast("string").alias("v_err"), F.lit(False).alias("from_formula"))
    )
