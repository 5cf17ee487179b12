"""Open XML relations: shared strings, cells, formulas, filters, pivots. All Catalyst once inflated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import FILTER_OPERATOR_NAMES, address, col_of, row_of, shift_references, typed_number
from .package import pivot_parts, sheet_texts, xml

SST_SCHEMA = "struct<si: array<struct<t: string, r: array<struct<t: string>>>>>"
ROWS_SCHEMA = (
    "struct<sheetData: struct<row: array<struct<_r: string, c: array<struct<_r: string, _t: string, v: string, "
    "f: struct<_VALUE: string, _t: string, _ref: string, _si: string, _ca: string, _anchor: string>, `is`: struct<t: string, r: array<struct<t: string>>>>>>>>>"
)
FILTER_SCHEMA = (
    "struct<autoFilter: struct<_ref: string, filterColumn: array<struct<_colId: string, "
    "filters: struct<_blank: string, filter: array<struct<_val: string>>>, "
    "customFilters: struct<_and: string, customFilter: array<struct<_operator: string, _val: string>>>, "
    "top10: struct<_top: string, _percent: string, _val: string, _filterVal: string>, "
    "dynamicFilter: struct<_type: string, _val: string, _maxVal: string>>>>>"
)
PIVOT_SCHEMA = (
    "struct<_name: string, _cacheId: string, _dataCaption: string, "
    "location: struct<_ref: string, _firstHeaderRow: string, _firstDataRow: string, _firstDataCol: string, _rowPageCount: string, _colPageCount: string>, "
    "pivotFields: struct<pivotField: array<struct<_axis: string, items: struct<item: array<struct<_x: string, _t: string>>>>>>, "
    "rowFields: struct<field: array<struct<_x: string>>>, colFields: struct<field: array<struct<_x: string>>>, "
    "dataFields: struct<dataField: array<struct<_name: string, _fld: string, _subtotal: string>>>, "
    "pageFields: struct<pageField: array<struct<_fld: string, _item: string>>>, "
    "filters: struct<filter: array<struct<_fld: string, _type: string>>>>"
)
CRITERION = "struct<operator: string, kind: string, v_num: double, v_str: string, v_bool: boolean>"
FILTER_COLUMN = f"struct<col_id: int, type: string, logic: string, conditions: array<{CRITERION}>, `values`: array<string>, attrs: map<string, string>>"


def _text(x: Column) -> Column:
    """Runs concatenated, else the plain text; formatting and phonetic runs dropped."""
    return F.coalesce(F.when(F.size(x["r"]) > 0, F.array_join(F.transform(x["r"], lambda r: F.coalesce(r["t"], F.lit(""))), "")), x["t"], F.lit(""))


def shared_strings(package_parts: DataFrame) -> DataFrame:
    """``path, idx, text``."""
    return (
        package_parts.filter(F.col("part_lc") == "xl/sharedstrings.xml")
        .select("path", xml("text", SST_SCHEMA).alias("x"))
        .select("path", F.posexplode("x.si").alias("idx", "si"))
        .select("path", "idx", F.when(F.col("si").isNull(), "").otherwise(_text(F.col("si"))).alias("text"))
    )


def raw_cells(chunks: DataFrame) -> DataFrame:
    """Cells as written, in document order: ``seq`` is (chunk, row, cell)."""
    return (
        chunks.select("path", "sheet_idx", "sheet", "chunk", "strings", "anchors", xml("text", ROWS_SCHEMA).alias("x"))
        .select("path", "sheet_idx", "sheet", "chunk", "strings", "anchors", F.posexplode("x.sheetData.row").alias("ri", "r"))
        .select("path", "sheet_idx", "sheet", "chunk", "strings", "anchors", "ri", F.posexplode("r.c").alias("ci", "c"))
        .select(
            "path", "sheet_idx", "sheet", F.struct("chunk", "ri", "ci").alias("seq"), row_of("c._r").alias("row"), col_of("c._r").alias("col"),
            F.col("c._t").alias("t"), F.col("c.v").alias("v"), F.col("c.f").alias("f"), F.col("c.`is`").alias("inline"), "strings", "anchors",
        )
        .filter("row is not null and col is not null")
    )


def cells(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """The typed sparse grid. Cells without a value are absent; a shared string out of range is ''."""
    raw = raw_cells(sheet_texts(books, sheet, frames=False, strings=True))
    t = F.coalesce("t", F.lit("n"))
    kind, v_int, v_num = typed_number("v")
    flag = F.lower(F.trim("v"))
    text = (
        F.when(t == "inlineStr", _text(F.col("inline")))
        .when(t == "s", F.coalesce(F.try_element_at("strings", F.trim("v").try_cast("int")), F.lit(""))).otherwise(F.col("v"))
    )
    is_bool = (t == "b") & flag.isin("0", "1", "true", "false")
    what = (
        F.when(t.isin("inlineStr", "s", "str"), "str").when(is_bool, "bool").when(t == "b", "str").when(t == "e", "error").otherwise(kind)
    )
    return raw.filter((t == "inlineStr") | F.col("v").isNotNull()).select(
        "path", "sheet_idx", "sheet", "row", "col", address("row", "col").alias("addr"), what.alias("kind"),
        F.when(what == "int", v_int).alias("v_int"), F.when(what.isin("int", "float"), v_num).alias("v_num"), F.when(what == "str", text).alias("v_str"),
        F.when(what == "bool", flag.isin("1", "true")).alias("v_bool"), F.when(what == "error", F.col("v")).alias("v_err"),
        F.col("f").isNotNull().alias("from_formula"),
    )


def formulas(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """Formulas as text. A shared follower takes the latest earlier anchor with its index, moved to its place.

    Anchors are found where the package is open, so nothing is exchanged.
    """
    raw = raw_cells(sheet_texts(books, sheet, frames=False, anchors=True)).filter("f is not null").select(
        "path", "sheet_idx", "sheet", "row", "col", "seq", F.col("f._t").alias("t"), F.col("f._ca").alias("ca"), F.trim("f._VALUE").alias("body"),
        F.try_element_at("anchors", F.col("f._anchor").cast("int") + 1).alias("x"),
    )
    is_shared = F.coalesce(F.col("t") == "shared", F.lit(False))
    linked = raw.filter(is_shared | (F.coalesce("body", F.lit("")) != "")).withColumn(
        "a", F.when(F.col("x").isNotNull(), F.struct(row_of("x.cell").alias("row"), col_of("x.cell").alias("col"), F.col("x.body").alias("body")))
    )
    return _formula_texts(linked).withColumn("addr", address("row", "col"))


def resolve_shared(raw: DataFrame) -> DataFrame:
    """The same over a table of formula cells (``seq`` is document order): an as-of join as a window.

    Only cells that share something enter the window; the others pass by it.
    """
    is_shared = F.coalesce(F.col("t") == "shared", F.lit(False))
    own = F.coalesce("body", F.lit("")) != ""
    anchor = F.when(F.col("ref").isNotNull() & own, F.struct("row", "col", "body"))
    earlier = Window.partitionBy("path", "sheet_idx", "si").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    shared = raw.filter(is_shared).withColumn("a", F.last(anchor, ignorenulls=True).over(earlier))
    return _formula_texts(raw.filter(~is_shared & own).withColumn("a", F.lit(None).cast(shared.schema["a"].dataType)).unionByName(shared))


def _formula_texts(linked: DataFrame) -> DataFrame:
    """Texts and kinds of formula cells with their anchor ``a`` (row, col, body), if they share one."""
    is_shared = F.coalesce(F.col("t") == "shared", F.lit(False))
    own = F.coalesce("body", F.lit("")) != ""
    moved = shift_references(F.col("a.body"), F.col("row") - F.col("a.row"), F.col("col") - F.col("a.col"))
    body = F.when(F.col("ca") == "1", F.regexp_replace("body", r"_xludf\.", "")).otherwise(F.col("body"))
    array = F.coalesce(F.col("t") == "array", F.lit(False))
    formula = (
        F.when(array, F.concat(F.lit("{="), body, F.lit("}"))).when(own, F.concat(F.lit("="), F.when(is_shared, F.col("body")).otherwise(body)))
        .when(F.col("a").isNotNull(), F.concat(F.lit("="), moved)).otherwise("={shared_formula}")
    )
    kind = F.when(array, "array").when(~is_shared, "normal").when(own | F.col("a").isNotNull(), "shared").otherwise("unresolved")
    return linked.select(
        "path", "sheet_idx", "sheet", "row", "col", "seq", formula.alias("formula"), kind.alias("formula_kind"), F.lit(None).cast("string").alias("parse_error")
    )


def _criterion(operator: Column, val: Column) -> Column:
    """A typed criterion: number, text, or the blanks and non-blanks that an empty value stands for."""
    table = F.create_map(*[F.lit(x) for kv in FILTER_OPERATOR_NAMES.items() for x in kv])
    sign = F.coalesce(F.try_element_at(table, F.coalesce(operator, F.lit("equal"))), operator)
    number = val.try_cast("double")
    blank = F.trim(F.coalesce(val, F.lit(""))) == ""
    kind = F.when(blank & (sign == "<>"), "nonblank").when(blank, "blank").when(number.isNotNull(), "number").otherwise("text")
    return F.struct(
        sign.alias("operator"), kind.alias("kind"), F.when(kind == "number", number).alias("v_num"), F.when(kind == "text", val).alias("v_str"),
        F.lit(None).cast("boolean").alias("v_bool"),
    )


def auto_filters(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """One row per sheet with a filter directly on it. The rows of the sheets are not parsed."""
    own = sheet_texts(books, sheet, frames=True)

    def column(c: Column) -> Column:
        custom, listed, top, dynamic = c["customFilters"], c["filters"], c["top10"], c["dynamicFilter"]
        kind = F.when(listed.isNotNull(), "discrete").when(custom.isNotNull(), "custom").when(top.isNotNull(), "top10").when(dynamic.isNotNull(), "dynamic")
        attrs = F.when(kind == "top10", F.map_from_entries(F.filter(F.array(
            *(F.struct(F.lit(k), top[f"_{k}"].alias("v")) for k in ("top", "percent", "val", "filterVal"))), lambda e: e["v"].isNotNull()))
        ).when(kind == "dynamic", F.map_from_entries(F.filter(F.array(
            *(F.struct(F.lit(k), dynamic[f"_{k}"].alias("v")) for k in ("type", "val", "maxVal"))), lambda e: e["v"].isNotNull())))
        return F.struct(
            c["_colId"].try_cast("int").alias("col_id"), kind.alias("type"),
            F.when(kind == "custom", F.when(F.lower(custom["_and"]).isin("1", "true"), "and").otherwise("or")).alias("logic"),
            F.when(kind == "custom", F.transform(custom["customFilter"], lambda x: _criterion(x["_operator"], x["_val"]))).alias("conditions"),
            F.when(kind == "discrete", F.coalesce(F.transform(listed["filter"], lambda x: x["_val"]), F.array().cast("array<string>"))).alias("values"),
            attrs.alias("attrs"),
        )

    return (
        own.select("path", "sheet_idx", "sheet", xml("text", FILTER_SCHEMA)["autoFilter"].alias("a"))
        .filter("a is not null and a._ref is not null")
        .select(
            "path", "sheet_idx", "sheet", F.col("a._ref").alias("ref"), F.split_part("a._ref", F.lit(":"), F.lit(1)).alias("top_left"),
            F.element_at(F.split("a._ref", ":"), -1).alias("bottom_right"),
            F.coalesce(F.transform("a.filterColumn", column), F.array()).cast(f"array<{FILTER_COLUMN}>").alias("columns"),
        )
    )


def pivot_tables(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """Metadata of the pivot parts that sheets link to."""
    number = lambda c: F.col(c).try_cast("int")
    indexes = lambda c: F.coalesce(F.filter(F.transform(c, lambda x: x["_x"].try_cast("int")), lambda x: x != -2), F.array().cast("array<int>"))
    ref = F.col("x.location._ref")
    first, last = F.element_at(F.split(ref, ":"), 1), F.element_at(F.split(ref, ":"), -1)
    return (
        pivot_parts(books, sheet, "xlsx")
        .select("path", "sheet", "pivot_part", "cache", xml("text", PIVOT_SCHEMA).alias("x"))
        .select(
            "path", "sheet", F.col("pivot_part").alias("part"), F.col("x._name").alias("name"), number("x._cacheId").alias("cache_id"),
            F.col("x._dataCaption").alias("data_caption"), F.col("cache").alias("pivot_cache_definition"),
            F.coalesce(F.size("x.pivotFields.pivotField"), F.lit(0)).alias("pivot_fields"),
            F.coalesce(F.aggregate("x.pivotFields.pivotField", F.lit(0), lambda a, f: a + F.coalesce(F.array_size(f["items"]["item"]), F.lit(0))), F.lit(0)).alias("pivot_items"),
            F.when(ref.isNotNull(), F.struct(
                F.struct(first.alias("top_left"), last.alias("bottom_right")).alias("rfx_geom"),
                number("x.location._firstHeaderRow").alias("rw_first_head"), number("x.location._firstDataRow").alias("rw_first_data"),
                F.col("x.location._firstDataCol").alias("col_first_data"),
                F.coalesce(number("x.location._rowPageCount"), F.lit(0)).alias("page_rows"), F.coalesce(number("x.location._colPageCount"), F.lit(0)).alias("page_cols"),
            )).alias("location"),
            indexes("x.rowFields.field").alias("row_fields"), indexes("x.colFields.field").alias("col_fields"),
            F.coalesce(F.transform("x.dataFields.dataField", lambda d: F.struct(
                d["_name"].alias("name"), d["_fld"].try_cast("int").alias("fld"), F.coalesce(d["_subtotal"], F.lit("sum")).alias("subtotal"))), F.array(),
            ).cast("array<struct<name: string, fld: int, subtotal: string>>").alias("data_fields"),
            F.concat(
                F.coalesce(F.transform("x.pageFields.pageField", lambda d: F.struct(d["_fld"].try_cast("int").alias("fld"), F.lit("page").alias("type"))), F.array().cast("array<struct<fld: int, type: string>>")),
                F.coalesce(F.transform("x.filters.filter", lambda d: F.struct(d["_fld"].try_cast("int").alias("fld"), d["_type"].alias("type"))), F.array().cast("array<struct<fld: int, type: string>>")),
            ).cast("array<struct<fld: int, type: string>>").alias("report_filters"),
            F.lit(None).cast(f"array<struct<field_index: int, filter_type: int, criteria: array<{CRITERION}>>>").alias("sx_filters"),
        )
    )
