"""Filters and pivots, evaluated as ordinary plans over tables. The metadata says what, Catalyst how."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import col_of, row_of

_COMPARE = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: ~(a == b),
}


def wildcard(pattern: str) -> str:
    """The regular expression of a filter text with ``*``, ``?`` and ``~`` as escape."""
    out = ""
    for m in re.finditer(r"~([*?~])|(\*)|(\?)|(.)", pattern, re.S):
        out += re.escape(m[1] or m[4] or "") or (".*" if m[2] else ".")
    return f"(?is)^{out}$"


def criterion(value: Column, condition: dict[str, Any], numeric: bool) -> Column:
    """One criterion on a column: never null."""
    kind, sign = condition["kind"], condition["operator"]
    empty = value.isNull() | (value.cast("string") == "")
    if kind == "blank":
        return empty
    if kind == "nonblank":
        return ~empty
    if kind == "bool":
        test = _COMPARE[sign](value.try_cast("boolean"), F.lit(condition["v_bool"]))
    elif kind == "number":
        test = _COMPARE[sign](value if numeric else value.try_cast("double"), F.lit(condition["v_num"]))
    elif sign in ("=", "<>"):
        same = value.cast("string").rlike(wildcard(condition["v_str"]))
        test = same if sign == "=" else ~same
    else:
        test = _COMPARE[sign](F.lower(value.cast("string")), F.lit(condition["v_str"].lower()))
    return F.coalesce(test, F.lit(sign == "<>"))


def _edge_of_share(known: DataFrame, share: float, top: bool, accuracy: int = 10_000) -> DataFrame:
    """The value of rank max(1, share of the rows) from one end, exactly, without a sort of all rows.

    An approximate percentile brackets it, and the distinct values within the bracket are counted
    from its outer end. All of it is one plan.
    """
    outer = F.desc if top else F.asc
    near = (1 - share if top else share)
    wide = 3 / accuracy
    low, high = (F.lit(x) for x in (min(max(near - wide, 0.0), 1.0), min(max(near + wide, 0.0), 1.0)))
    bracket = known.agg(F.percentile_approx("_v", low, accuracy).alias("a"), F.percentile_approx("_v", high, accuracy).alias("b"))
    a, b = bracket.select("a").scalar(), bracket.select("b").scalar()
    beyond = known.filter(F.col("_v") > b if top else F.col("_v") < a).agg(F.count("*")).scalar()
    wanted = known.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(share)))).scalar()
    inside = known.filter((F.col("_v") >= a) & (F.col("_v") <= b)).groupBy("_v").agg(F.count("*").alias("n"))
    counted = inside.withColumn("upto", F.sum("n").over(Window.orderBy(outer("_v"))))
    return counted.filter(F.col("upto") + beyond >= wanted).agg((F.max if top else F.min)("_v"))


def apply_filter_column(table: DataFrame, name: str, spec: dict[str, Any], among: DataFrame | None = None) -> DataFrame:
    """The rows of ``table`` that pass one filter column (a row of ``columns`` as a dict).

    ``among`` is the whole table for filters that compare with all rows; it defaults to ``table``.
    Top-10 keeps ties; a dynamic filter compares with the average.
    """
    value, numeric = F.col(name), dict(table.dtypes)[name] not in ("string", "boolean")
    kind, attrs = spec.get("type"), spec.get("attrs") or {}
    if kind == "custom" and spec.get("conditions"):
        tests = [criterion(value, c, numeric) for c in spec["conditions"] if c is not None]
        both = (lambda a, b: a & b) if spec.get("logic") == "and" else (lambda a, b: a | b)
        return table.filter(reduce(both, tests)) if tests else table
    if kind == "discrete":
        kept = [v.lower() for v in spec.get("values") or [] if v is not None]
        test = F.lower(value.cast("string")).isin(kept) if kept else F.lit(False)
        return table.filter(F.coalesce(test, F.lit(False)) | ((value.isNull() | (value.cast("string") == "")) if "" in kept else F.lit(False)))
    among = table if among is None else among
    if kind == "top10":
        n, top = float(attrs.get("val", 10)), attrs.get("top", "1") not in ("0", "false")
        known = among.filter(value.isNotNull()).select(value.alias("_v"))
        edge = _edge_of_share(known, n / 100, top) if attrs.get("percent") in ("1", "true") else (
            # the bound comes from a top-k, the rows from a filter: no window over the whole table
            known.orderBy(F.desc("_v") if top else F.asc("_v")).limit(int(n)).agg((F.min if top else F.max)("_v"))
        )
        return table.filter(value >= edge.scalar() if top else value <= edge.scalar())
    if kind == "dynamic" and attrs.get("type") in ("aboveAverage", "belowAverage"):
        mean = among.agg(F.avg(value)).scalar()
        return table.filter(value > mean if attrs["type"] == "aboveAverage" else value < mean)
    return table


def apply_autofilter(table: DataFrame, names: dict[int, str], columns: list[dict[str, Any]]) -> DataFrame:
    """All filter columns of a sheet's filter; ``names`` maps a filter's col_id to a column of ``table``."""
    out = table
    for spec in columns:
        if spec is not None and spec["col_id"] in names:
            out = apply_filter_column(out, names[spec["col_id"]], spec, table)
    return out


def _test(spec: Column, cell: Column, empty: Column) -> Column:
    """Whether a cell passes a custom or discrete filter column; never null."""
    def one(q: Column) -> Column:
        sign = F.coalesce(q["operator"], F.lit("="))

        def compare(a: Column, b: Column) -> Column:
            tests = F.when(sign == "=", a == b).when(sign == "<>", a != b).when(sign == "<", a < b).when(sign == "<=", a <= b).when(sign == ">", a > b).otherwise(a >= b)
            return F.coalesce(tests, sign == "<>")

        text, wanted = F.lower(cell["v_str"]), F.lower(q["v_str"])
        pattern = wanted
        for a, b in (("\\", "\\\\"), ("%", "\\%"), ("_", "\\_"), ("~*", "\x01"), ("~?", "\x02"), ("~~", "~"), ("*", "%"), ("?", "_"), ("\x01", "*"), ("\x02", "?")):
            pattern = F.replace(pattern, F.lit(a), F.lit(b))
        like = F.coalesce(F.when(sign == "=", F.like(text, pattern, F.lit("\\"))).otherwise(~F.like(text, pattern, F.lit("\\"))), sign == "<>")
        return (
            F.when(q["kind"] == "blank", empty).when(q["kind"] == "nonblank", ~empty)
            .when(q["kind"] == "number", compare(cell["v_num"], q["v_num"])).when(q["kind"] == "bool", compare(cell["v_bool"], q["v_bool"]))
            .when(sign.isin("=", "<>"), like).otherwise(compare(text, wanted))
        )

    criteria = F.filter(F.coalesce(spec["conditions"], F.array()), lambda q: q["kind"].isNotNull())
    custom = F.when(F.size(criteria) == 0, True).when(spec["logic"] == "and", F.forall(criteria, one)).otherwise(F.exists(criteria, one))
    values = F.filter(F.coalesce(spec["values"], F.array().cast("array<string>")), lambda v: v.isNotNull())
    shown = F.lower(F.coalesce(cell["v_str"], cell["v_err"], cell["v_int"].cast("string"), cell["v_bool"].cast("string")))
    listed = F.coalesce(F.array_contains(F.transform(values, F.lower), shown), F.lit(False)) | (empty & F.array_contains(values, F.lit("")))
    return F.when(spec["type"] == "custom", custom).when(spec["type"] == "discrete", listed).otherwise(True)


#: Rows of a sheet that meet the filters' areas under one key.
ROW_BLOCK = 2048


def visible_rows(cells: DataFrame, auto_filters: DataFrame, key: str) -> DataFrame:
    """``key, row``: the data rows that every filter of a corpus leaves visible in its own sheet.

    ``cells`` holds each cell once (``path, sheet_idx, row, col`` and its typed values);
    ``auto_filters`` is the relation of that name with an id. One join finds the cells inside
    the filters' areas; per row they become a map, in which every filter column looks up its
    cell. Averages and ranks are windows over one column of one area.

    A row counts if it holds any cell inside the area. An absent cell is blank. Texts match
    without regard to case, with wildcards; listed values match texts, whole numbers, errors and
    truth values. Filters that need a clock or formats (dates, colours) let every row pass, as do
    columns without criteria. Repeated rows of one id count once.
    """
    area = auto_filters.dropDuplicates([key]).select(
        key, "path", "sheet_idx", row_of("top_left").alias("r1"), col_of("top_left").alias("c1"), row_of("bottom_right").alias("r2"), col_of("bottom_right").alias("c2"), "columns",
    )
    own = cells.select("path", "sheet_idx", "row", "col", F.struct("v_int", "v_num", "v_str", "v_bool", "v_err").alias("v"))
    # areas and cells meet by blocks of rows, so a large sheet is many keys; a row lies in one block
    blocks = area.drop("columns").withColumn("block", F.explode(F.sequence(F.floor((F.col("r1") + 1) / ROW_BLOCK), F.floor(F.greatest("r2", F.col("r1") + 1) / ROW_BLOCK))))
    rows = (
        own.withColumn("block", F.floor(F.col("row") / ROW_BLOCK)).join(blocks, ["path", "sheet_idx", "block"])
        .filter("row > r1 and row <= r2 and col between c1 and c2")
        .groupBy(key, "row", "c1").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("cells"))
    )
    specs = rows.join(area.select(key, "columns"), key).select(key, "row", "c1", "cells", F.posexplode_outer("columns").alias("k", "spec"))
    cell = F.try_element_at("cells", F.col("c1") + F.col("spec.col_id"))
    found = specs.select(key, "row", "k", "spec", cell.alias("v"))
    empty = F.col("v").isNull() | (
        F.col("v.v_num").isNull() & F.col("v.v_bool").isNull() & F.col("v.v_err").isNull() & (F.coalesce("v.v_str", F.lit("")) == "")
    )
    attr = lambda name, default: F.coalesce(F.try_element_at("spec.attrs", F.lit(name)), F.lit(default))
    # only filters that compare with the whole column form groups; other rows stand alone
    among = F.coalesce(F.col("spec.type").isin("top10", "dynamic"), F.lit(False))
    group = Window.partitionBy(key, "k", F.when(among, F.lit(-1)).otherwise(F.col("row")))
    number, n = F.col("v.v_num"), attr("val", "10").try_cast("double")
    order = group.orderBy(F.when(attr("top", "1").isin("0", "false"), number).otherwise(-number).asc_nulls_last())
    seen = found.withColumns({"mean": F.avg(number).over(group), "numbers": F.count(number).over(group), "rank": F.rank().over(order)})
    most = F.when(attr("percent", "0").isin("1", "true"), F.greatest(F.lit(1.0), F.floor(F.col("numbers") * n / 100).cast("double"))).otherwise(n)
    dynamic = F.when(attr("type", "") == "aboveAverage", number > F.col("mean")).when(attr("type", "") == "belowAverage", number < F.col("mean")).otherwise(True)
    passes = (
        F.when(F.col("spec.type") == "top10", number.isNotNull() & (F.col("rank") <= most)).when(F.col("spec.type") == "dynamic", F.coalesce(dynamic, F.lit(False)))
        .otherwise(F.coalesce(_test(F.col("spec"), F.col("v"), empty), F.lit(True)))
    )
    return seen.groupBy(key, "row").agg(F.bool_and(passes).alias("visible")).filter("visible").select(key, "row")


# Subtotal names of data fields.
SUBTOTALS = {
    "sum": F.sum, "count": F.count, "countNums": F.count, "average": F.avg, "max": F.max, "min": F.min, "product": F.product,
    "stdDev": F.stddev_samp, "stdDevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop,
}


def pivot_eval(table: DataFrame, rows: list[str], cols: list[str], data: list[tuple[str, str, str]], totals: bool = False) -> DataFrame:
    """A pivot in long form: one row per row item and column item, one column per (field, subtotal, name).

    With ``totals`` also the subtotals over rows, over columns and over all; ``is_total`` numbers the sums.
    """
    values = [SUBTOTALS[subtotal](field).alias(name) for field, subtotal, name in data]
    if not totals:
        return table.groupBy(*rows, *cols).agg(*values)
    return table.cube(*rows, *cols).agg(*values, F.grouping_id().alias("is_total"))


def pivot_grid(table: DataFrame, rows: list[str], col: str, items: list, data: tuple[str, str]) -> DataFrame:
    """A pivot in wide form with the given column items: no pass to find them."""
    field, subtotal = data
    return table.groupBy(*rows).pivot(col, items).agg(SUBTOTALS[subtotal](field))


def ranked(table: DataFrame, name: str, groups: list[str]) -> DataFrame:
    """Competition rank within groups, the highest first."""
    return table.withColumn("rank", F.rank().over(Window.partitionBy(*groups).orderBy(F.desc(name))))
