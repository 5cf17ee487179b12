"""Relations as JSON, dicts and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relations


def shown_value() -> Column:
    """A cell's value as JSON text."""
    return F.coalesce(
        F.when(F.col("kind") == "int", F.col("v_int").cast("string")), F.when(F.col("kind") == "float", F.regexp_extract(F.to_json(F.struct(F.col("v_num").alias("v"))), r"^\{\"v\":(.*)\}$", 1)),
        F.when(F.col("kind") == "bool", F.col("v_bool").cast("string")), F.to_json(F.array(F.coalesce("v_str", "v_err"))),
    )


def cell_map(rows: DataFrame, value: Column, keys: tuple[str, ...] = ("path", "sheet_idx", "sheet")) -> DataFrame:
    """Per sheet the cells in (row, col) order as an array of ``addr, value``. A sheet's cells meet in one row."""
    ordered = F.sort_array(F.collect_list(F.struct("row", "col", "addr", value.alias("value"))))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: F.struct(x["addr"].alias("addr"), x["value"].alias("value"))).alias("cells"))


def sheet_markdown(rows: DataFrame, value: Column) -> DataFrame:
    """Per sheet one line per cell, in (row, col) order: ``- A1: value``."""
    lines = F.transform(F.col("cells"), lambda x: F.concat(F.lit("- "), x["addr"], F.lit(": "), F.coalesce(x["value"], F.lit(""))))
    return cell_map(rows, value).select("path", "sheet_idx", "sheet", F.array_join(lines, "\n").alias("markdown"))


SECTIONS = ("formulas", "values", "pivots", "filters", "vba")


def collect(books: DataFrame, include: tuple[str, ...], sheet: str | None = None) -> dict:
    """The sections of one workbook as plain data. For the command line: one workbook, not a corpus."""
    out: dict = {}
    if "formulas" in include:
        rows = relations.formulas(books, sheet).orderBy("sheet_idx", "row", "col").collect()
        out["formulas"] = _by_sheet(rows, lambda r: r.formula)
    if "values" in include:
        rows = relations.cells(books, sheet).orderBy("sheet_idx", "row", "col").collect()
        out["values"] = _by_sheet(rows, lambda r: {"int": r.v_int, "float": r.v_num, "bool": r.v_bool, "error": r.v_err}.get(r.kind, r.v_str))
    if "pivots" in include:
        out["pivot_tables"] = [r.asDict(True) for r in relations.pivot_tables(books, sheet).drop("path").collect()]
    if "filters" in include:
        out["filters"] = [r.asDict(True) for r in relations.auto_filters(books, sheet).drop("path", "sheet_idx").collect()]
    if "vba" in include:
        out["vba"] = {r.module: r.source for r in relations.vba_modules(books).collect()}
    return out


def _by_sheet(rows, value) -> dict:
    out: dict[str, dict] = {}
    for r in rows:
        out.setdefault(r.sheet, {})[r.addr] = value(r)
    return out


def as_json(data: dict) -> str:
    return json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False, default=str)


def as_markdown(data: dict) -> str:
    out: list[str] = []
    for section, title in (("formulas", "Formulas"), ("values", "Values")):
        for sheet, cells in data.get(section, {}).items():
            if cells:
                out += [f"## {title}: {sheet}", *(f"- {a}: {v}" for a, v in cells.items()), ""]
    for p in data.get("pivot_tables", ()):
        where = (p.get("location") or {}).get("rfx_geom") or {}
        out += [f"## Pivot table: {p.get('name')}", f"- sheet: {p.get('sheet')}", f"- range: {where.get('top_left')}:{where.get('bottom_right')}", f"- fields: {p.get('pivot_fields')}", ""]
    for f in data.get("filters", ()):
        out += [f"## Filter: {f['sheet']} ({f['ref']})"]
        for c in f["columns"] or ():
            shown = [f"{x['operator']} {next((x[k] for k in ('v_num', 'v_str', 'v_bool') if x[k] is not None), x['kind'])}" for x in c["conditions"] or () if x]
            out.append(f"- column {c['col_id']}: {(' ' + (c['logic'] or 'or') + ' ').join(shown) or ', '.join(v or '' for v in c['values'] or ()) or c['attrs'] or c['type']}")
        out.append("")
    for name, source in data.get("vba", {}).items():
        out += [f"## Module: {name}", "```vba", source or "", "```", ""]
    return "\n".join(out) if out else "(no formulas found)"
