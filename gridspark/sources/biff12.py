"""Binary workbook parts: record framing, and one decoder per relation.

A record stream is sequential, so a part is decoded by one task's Arrow function; the rows that
come out (values with shared-string numbers, token streams, rectangles of shared bodies) are
joined in the DataFrame layer. Damaged streams give the rows before the damage and a problem.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import ERROR_TEXT, FILTER_OPERATORS, UNKNOWN_ERROR, address, package_format
from .formula_tokens import decompile, letters

# Record types.
ROW, RK, ERROR, BOOL, REAL, TEXT, SHARED_TEXT = 0x0000, 0x0002, 0x0003, 0x0004, 0x0005, 0x0006, 0x0007
F_TEXT, F_NUMBER, F_BOOL, F_ERROR, ARRAY_BODY, SHARED_BODY = 0x0008, 0x0009, 0x000A, 0x000B, 0x01AA, 0x01AB
SST_ITEM, NAME, SHEET = 0x0013, 0x0027, 0x009C
LINKS, LINK_SELF, SHEET_LINKS = (0x0163, 0x0165, 0x0166), 0x0165, 0x016A
SX_VIEW, SX_LOCATION, SX_FIELD, SX_ITEM, SX_FILTER, SX_FILTER_END = 0x0118, 0x013A, 0x011D, 0x011A, 0x0259, 0x025A
FILTER, FILTER_END, FILTER_COLUMN, FILTER_COLUMN_END, LISTED, CUSTOM_BEGIN, CUSTOM = 0x00A1, 0x00A2, 0x00A3, 0x00A4, 0x00A7, 0x00AC, 0x00AE
#: A filter's flag says that all its criteria must hold.
AND_FLAG = True
MOST_TOKENS = 16384


def records(data: bytes) -> Iterator[tuple[int, int, bytes, str | None]]:
    """``seq, type, payload, problem``: two-byte type, four-byte size, in groups of seven bits."""
    at, seq = 0, 0
    while at < len(data):
        head = []
        for most in (2, 4):
            value = 0
            for k in range(most):
                if at >= len(data):
                    if most == 4:
                        yield seq, head[0], b"", "the size of a record is cut off"
                    return
                b = data[at]
                at += 1
                value |= (b & 0x7F) << (7 * k)
                if not b & 0x80:
                    break
            head.append(value)
        payload = data[at : at + head[1]]
        at += head[1]
        yield seq, head[0], payload, None if len(payload) == head[1] else "a record is cut off"
        seq += 1


def wide(payload: bytes, at: int) -> tuple[str, int]:
    """A counted UTF-16 text and where it ends; '' where it is cut off."""
    if at + 4 > len(payload):
        return "", len(payload)
    (n,) = struct.unpack_from("<I", payload, at)
    if n == 0xFFFFFFFF or at + 4 + 2 * n > len(payload):
        return "", len(payload) if n != 0xFFFFFFFF else at + 4
    return payload[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def rk(raw: int) -> tuple[float, bool]:
    """(number, is a whole number by its form) of a packed number."""
    if raw & 2:
        n = raw >> 2
        value = float(n - (1 << 30) if n & (1 << 29) else n)
    else:
        (value,) = struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))
    return value / 100 if raw & 1 else value, bool(raw & 2) and not raw & 1


def parsed_formula(payload: bytes, at: int) -> tuple[bytes, bytes] | None:
    """Tokens and what stands behind them, or None where there is no whole formula."""
    if at + 4 > len(payload):
        return None
    (n,) = struct.unpack_from("<I", payload, at)
    if not 0 < n <= MOST_TOKENS or at + 4 + n > len(payload):
        return None
    code, at = payload[at + 4 : at + 4 + n], at + 4 + n
    m = struct.unpack_from("<I", payload, at)[0] if at + 4 <= len(payload) else 0
    return code, payload[at + 4 : at + 4 + m]


def _number(d: float) -> dict:
    whole = d == d and abs(d) < 1e15 and d == int(d)
    return {"kind": "int" if whole else "float", "v_int": int(d) if whole else None, "v_num": d}


def cell_rows(data: bytes) -> list[dict]:
    """Values of a sheet part; a later record of the same cell replaces an earlier one."""
    grid: dict[tuple[int, int], dict] = {}
    row = 0
    for _, kind, p, _ in records(data):
        if kind == ROW and len(p) >= 4:
            (row,) = struct.unpack_from("<I", p)
            continue
        if len(p) < 9 or kind not in (RK, ERROR, BOOL, REAL, TEXT, SHARED_TEXT, F_TEXT, F_NUMBER, F_BOOL, F_ERROR):
            continue
        (col,) = struct.unpack_from("<I", p)
        if kind == RK and len(p) >= 12:
            value = _number(rk(struct.unpack_from("<I", p, 8)[0])[0])
        elif kind in (REAL, F_NUMBER) and len(p) >= 16:
            value = _number(struct.unpack_from("<d", p, 8)[0])
        elif kind in (TEXT, F_TEXT):
            value = {"kind": "str", "v_str": wide(p, 8)[0]}
        elif kind == SHARED_TEXT and len(p) >= 12:
            value = {"kind": "str", "isst": struct.unpack_from("<I", p, 8)[0]}
        elif kind in (BOOL, F_BOOL):
            value = {"kind": "bool", "v_bool": bool(p[8])}
        elif kind in (ERROR, F_ERROR):
            value = {"kind": "error", "v_err": ERROR_TEXT.get(p[8], UNKNOWN_ERROR)}
        else:
            continue
        grid[row, col] = {"row": row, "col": col, "from_formula": kind in (F_TEXT, F_NUMBER, F_BOOL, F_ERROR), **value}
    return list(grid.values())


def formula_rows(data: bytes) -> list[dict]:
    """Formula cells and shared bodies: ``what`` is 'cell', 'pending' or 'body'."""
    cells: dict[tuple[int, int], dict] = {}
    bodies, row = [], 0
    for seq, kind, p, _ in records(data):
        if kind == ROW and len(p) >= 4:
            (row,) = struct.unpack_from("<I", p)
        elif kind in (F_TEXT, F_NUMBER, F_BOOL, F_ERROR) and len(p) >= 9:
            (col,) = struct.unpack_from("<I", p)
            at = {F_TEXT: wide(p, 8)[1], F_NUMBER: 16}.get(kind, 9) + 2
            got = parsed_formula(p, at)
            if got:
                cells[row, col] = {
                    "what": "pending" if got[0][0] == 0x01 else "cell", "seq": seq, "row": row, "col": col, "code": got[0], "extra": got[1],
                }
        elif kind in (ARRAY_BODY, SHARED_BODY) and len(p) >= 20:
            r1, r2, c1, c2 = struct.unpack_from("<4I", p)
            got = parsed_formula(p, 16) or parsed_formula(p, 17)
            if got:
                bodies.append({
                    "what": "body", "seq": seq, "row": r1, "col": c1, "last_row": r2, "last_col": c2, "code": got[0], "extra": got[1], "array": kind == ARRAY_BODY,
                })
    return list(cells.values()) + bodies


def criterion(p: bytes) -> dict | None:
    if len(p) < 10:
        return None
    out = {"operator": FILTER_OPERATORS.get(p[1], str(p[1])), "kind": None, "v_num": None, "v_str": None, "v_bool": None}
    if p[0] == 0x04:
        return out | {"kind": "number", "v_num": struct.unpack_from("<d", p, 2)[0]}
    if p[0] == 0x08:
        return out | {"kind": "bool", "v_bool": bool(p[2])}
    if p[0] == 0x06:
        return out | {"kind": "text", "v_str": wide(p, 10)[0]}
    return out | {"kind": {0x0C: "blank", 0x0E: "nonblank"}[p[0]]} if p[0] in (0x0C, 0x0E) else None


def filter_rows(data: bytes) -> list[dict]:
    """The sheet's filter (the last one holds); filters inside pivot filters are skipped."""
    found, column, in_pivot = None, None, 0
    for _, kind, p, _ in records(data):
        if kind in (SX_FILTER, SX_FILTER_END):
            in_pivot += 1 if kind == SX_FILTER else -1
        elif in_pivot > 0:
            continue
        elif kind == FILTER and len(p) >= 16:
            r1, r2, c1, c2 = struct.unpack_from("<4I", p)
            a, b = f"{letters(c1)}{r1 + 1}", f"{letters(c2)}{r2 + 1}"
            found = {"ref": a if a == b else f"{a}:{b}", "top_left": a, "bottom_right": b, "columns": []}
        elif kind == FILTER_COLUMN and found and len(p) >= 4:
            column = {"col_id": struct.unpack_from("<I", p)[0], "type": None, "logic": None, "conditions": None, "values": None, "attrs": None}
        elif kind == FILTER_COLUMN_END and column:
            found["columns"].append(column)
            column = None
        elif column and kind == CUSTOM_BEGIN and len(p) >= 4:
            column |= {"type": "custom", "logic": "and" if bool(struct.unpack_from("<I", p)[0]) == AND_FLAG else "or", "conditions": column["conditions"] or []}
        elif column and kind == CUSTOM and (c := criterion(p)):
            column |= {"type": "custom", "logic": column["logic"] or "and", "conditions": [*(column["conditions"] or []), c]}
        elif column and kind == LISTED:
            column |= {"type": column["type"] or "discrete", "values": [*(column["values"] or []), wide(p, 0)[0]]}
    return [found] if found else []


def pivot_rows(data: bytes) -> list[dict]:
    out = {"name": None, "cache_id": None, "data_caption": None, "pivot_fields": 0, "pivot_items": 0, "location": None, "sx_filters": []}
    open_ = None
    for _, kind, p, _ in records(data):
        if kind == SX_VIEW and len(p) >= 32:
            name, at = wide(p, 32)
            out |= {"cache_id": struct.unpack_from("<I", p, 28)[0], "name": name, "data_caption": wide(p, at)[0] or None}
        elif kind == SX_LOCATION and len(p) >= 36:
            r1, r2, c1, c2, head, first, col, rows, cols = struct.unpack_from("<9I", p)
            out["location"] = {
                "rfx_geom": {"top_left": f"{letters(c1)}{r1 + 1}", "bottom_right": f"{letters(c2)}{r2 + 1}"},
                "rw_first_head": head + 1, "rw_first_data": first + 1, "col_first_data": letters(col), "page_rows": rows, "page_cols": cols,
            }
        elif kind == SX_FIELD:
            out["pivot_fields"] += 1
        elif kind == SX_ITEM:
            out["pivot_items"] += 1
        elif kind == SX_FILTER and len(p) >= 12:
            field, _, what = struct.unpack_from("<3i", p)
            open_ = {"field_index": field, "filter_type": what, "criteria": []}
        elif kind == CUSTOM and open_ and (c := criterion(p)):
            open_["criteria"].append(c)
        elif kind == SX_FILTER_END and open_:
            out["sx_filters"].append(open_)
            open_ = None
    return [out]


def sst_rows(data: bytes) -> list[dict]:
    """Shared strings: a flag byte, then the text; formatting runs are dropped."""
    items = [p for _, kind, p, _ in records(data) if kind == SST_ITEM]
    return [{"idx": k, "text": wide(p, 1)[0] if len(p) >= 5 else ""} for k, p in enumerate(items)]


def sheet_rows(data: bytes) -> list[dict]:
    out = []
    for _, kind, p, _ in records(data):
        if kind == SHEET and len(p) >= 12:
            rel, at = wide(p, 8)
            out.append({"sheet_idx": len(out), "sheet": wide(p, at)[0], "rel_id": rel})
    return out


def link_rows(data: bytes) -> list[dict]:
    """What the sheet numbers in formulas stand for: ``ixti`` -> sheet index, null outside this workbook.

    A workbook without such a list gives no rows; its formulas number the sheets directly.
    """
    links, out = [], []
    for _, kind, p, _ in records(data):
        if kind in LINKS:
            links.append(kind == LINK_SELF)
        elif kind == SHEET_LINKS and len(p) >= 4:
            n = min(struct.unpack_from("<I", p)[0], (len(p) - 4) // 12)
            for k in range(n):
                link, first, _ = struct.unpack_from("<Iii", p, 4 + 12 * k)
                own = not links or link < len(links) and links[link]
                out.append({"ixti": k, "sheet_idx": first if own and first >= 0 else None})
    return out


def name_rows(data: bytes) -> list[dict]:
    """Defined names, numbered from 1; a record too short for a name takes no number, one cut off later does."""
    out, idx = [], 0
    for _, kind, p, _ in records(data):
        if kind == NAME and len(p) >= 13:
            idx += 1
            text, _ = wide(p, 9)
            if text:
                out.append({"idx": idx, "name": text})
    return out


_CRITERION = pa.struct([("operator", pa.string()), ("kind", pa.string()), ("v_num", pa.float64()), ("v_str", pa.string()), ("v_bool", pa.bool_())])
_LOCATION = pa.struct([
    ("rfx_geom", pa.struct([("top_left", pa.string()), ("bottom_right", pa.string())])), ("rw_first_head", pa.int32()), ("rw_first_data", pa.int32()),
    ("col_first_data", pa.string()), ("page_rows", pa.int32()), ("page_cols", pa.int32()),
])
SCHEMAS = {
    "cells": [("row", pa.int32()), ("col", pa.int32()), ("kind", pa.string()), ("v_int", pa.int64()), ("v_num", pa.float64()), ("v_str", pa.string()), ("v_bool", pa.bool_()), ("v_err", pa.string()), ("isst", pa.int64()), ("from_formula", pa.bool_())],
    "formulas": [("what", pa.string()), ("seq", pa.int64()), ("row", pa.int32()), ("col", pa.int32()), ("last_row", pa.int64()), ("last_col", pa.int64()), ("code", pa.binary()), ("extra", pa.binary()), ("array", pa.bool_())],
    "formula_texts": [("row", pa.int32()), ("col", pa.int32()), ("formula", pa.string()), ("formula_kind", pa.string()), ("parse_error", pa.string())],
    "filters": [("ref", pa.string()), ("top_left", pa.string()), ("bottom_right", pa.string()), ("columns", pa.list_(pa.struct([("col_id", pa.int32()), ("type", pa.string()), ("logic", pa.string()), ("conditions", pa.list_(_CRITERION)), ("values", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string()))])))],
    "pivots": [("name", pa.string()), ("cache_id", pa.int32()), ("data_caption", pa.string()), ("pivot_fields", pa.int32()), ("pivot_items", pa.int32()), ("location", _LOCATION), ("sx_filters", pa.list_(pa.struct([("field_index", pa.int32()), ("filter_type", pa.int32()), ("criteria", pa.list_(_CRITERION))])))],
    "sst": [("idx", pa.int32()), ("text", pa.string())],
    "sheets": [("sheet_idx", pa.int32()), ("sheet", pa.string()), ("rel_id", pa.string())],
    "names": [("idx", pa.int32()), ("name", pa.string())],
    "links": [("ixti", pa.int32()), ("sheet_idx", pa.int32())],
    "records": [("seq", pa.int64()), ("rec_type", pa.int32()), ("payload", pa.binary()), ("problem", pa.string())],
}
DECODERS = {
    "cells": cell_rows, "formulas": formula_rows, "filters": filter_rows, "pivots": pivot_rows, "sst": sst_rows, "sheets": sheet_rows, "names": name_rows, "links": link_rows,
    "records": lambda data: [{"seq": s, "rec_type": t, "payload": p, "problem": e} for s, t, p, e in records(data)],
}
_SPARK = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}


def _ddl(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_ddl(t.value_type)}>"
    if pa.types.is_map(t):
        return "map<string, string>"
    if pa.types.is_struct(t):
        return "struct<" + ", ".join(f"`{f.name}`: {_ddl(f.type)}" for f in t) + ">"
    return _SPARK[t]


def decode(rows: DataFrame, what: str, keys: dict[str, pa.DataType], data: str = "data") -> DataFrame:
    """The rows that a decoder finds in each part, under the part's keys. Long parts come out in slices."""
    schema = pa.schema([*keys.items(), *SCHEMAS[what]])
    columns, decoder, n = list(keys), DECODERS[what], len(keys)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(n)[k].as_py()
                key = {c: batch.column(j)[k].as_py() for j, c in enumerate(columns)}
                found = decoder(raw) if raw else []
                for at in range(0, len(found), 20_000):
                    yield pa.RecordBatch.from_pylist([{**key, **r} for r in found[at : at + 20_000]], schema=schema)

    return rows.select(*columns, data).mapInArrow(run, ", ".join(f"`{f.name}` {_ddl(f.type)}" for f in schema))


_SHEET_KEYS = {"path": pa.string(), "sheet_idx": pa.int32(), "sheet": pa.string()}


def _binary(package_parts: DataFrame) -> DataFrame:
    return package_parts.filter(package_format("path") == "xlsb")


def defined_names(package_parts: DataFrame) -> DataFrame:
    return decode(_binary(package_parts).filter("part_lc = 'xl/workbook.bin'"), "names", {"path": pa.string()}).select(
        "path", "idx", "name", F.lit(None).cast("string").alias("refers_to")
    )


def shared_strings(package_parts: DataFrame) -> DataFrame:
    return decode(_binary(package_parts).filter("part_lc = 'xl/sharedstrings.bin'"), "sst", {"path": pa.string()})


def decode_sheets(books: DataFrame, what: str, rows, sheet: str | None = None) -> DataFrame:
    """``rows(package, data)`` of every binary sheet, decoded where its package is open: no join, no shuffle."""
    from .package import _packages

    schema = pa.schema([*_SHEET_KEYS.items(), *SCHEMAS[what]])

    def run(batches):
        for path, package in _packages(batches):
            for idx, name, data in package.wanted(sheet):
                found = rows(package, data)
                for at in range(0, len(found), 20_000):
                    yield pa.RecordBatch.from_pylist([{"path": path, "sheet_idx": idx, "sheet": name, **r} for r in found[at : at + 20_000]], schema=schema)

    binary = books.filter(package_format("path") == "xlsb").select("path", "content")
    return binary.mapInArrow(run, ", ".join(f"`{f.name}` {_ddl(f.type)}" for f in schema))


def cells(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """Values; a shared string out of range is ''."""
    def rows(package, data):
        strings = None
        out = cell_rows(data)
        for c in out:
            k = c.pop("isst", None)
            if k is not None:
                strings = package.strings() if strings is None else strings
                c["v_str"] = strings[k] if k < len(strings) else ""
        return out

    return decode_sheets(books, "cells", rows, sheet).drop("isst").withColumn("addr", address("row", "col"))


def first_rectangles(pending: list[dict], bodies: list[dict]) -> list[dict | None]:
    """For every cell the first body, in file order, whose rectangle holds it.

    Bodies are kept by column, so a cell meets only those that reach over its own.
    """
    by_col: dict[int, list[dict]] = {}
    wide_ones = []
    for b in sorted(bodies, key=lambda b: b["seq"]):
        if b["last_col"] - b["col"] > 64:
            wide_ones.append(b)
        else:
            for c in range(b["col"], b["last_col"] + 1):
                by_col.setdefault(c, []).append(b)
    out = []
    for p in pending:
        near = next((b for b in by_col.get(p["col"], ()) if b["row"] <= p["row"] <= b["last_row"]), None)
        far = next((b for b in wide_ones if b["row"] <= p["row"] <= b["last_row"] and b["col"] <= p["col"] <= b["last_col"]), None)
        out.append(min((b for b in (near, far) if b), key=lambda b: b["seq"], default=None))
    return out


def formula_texts(data: bytes, names) -> list[dict]:
    """The formula cells of a sheet part as text."""
    found = formula_rows(data)
    pending, bodies = [r for r in found if r["what"] == "pending"], [r for r in found if r["what"] == "body"]
    out = [(r, r, "normal") for r in found if r["what"] == "cell"]
    out += [(r, b, "unresolved" if b is None else "array" if b["array"] else "shared") for r, b in zip(pending, first_rectangles(pending, bodies))]
    texts = []
    for r, source, kind in out:
        text, problem = decompile(source["code"], source["extra"], r["row"], r["col"], names) if source else ("={shared_formula}", None)
        text = f"=<parse_error:{problem}>" if problem else "{" + text + "}" if kind == "array" else text
        texts.append({"row": r["row"], "col": r["col"], "formula": text, "formula_kind": kind, "parse_error": problem})
    return texts


def formulas(books: DataFrame, sheet: str | None = None, functions: dict | None = None) -> DataFrame:
    """Formulas as text; cells of shared bodies are resolved by their rectangle."""
    def rows(package, data):
        return formula_texts(data, package.names(functions))

    return decode_sheets(books, "formula_texts", rows, sheet).withColumn("addr", address("row", "col"))


def token_streams(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """Formula cells and shared bodies before they are resolved, to look into files."""
    return decode_sheets(books, "formulas", lambda _, data: formula_rows(data), sheet)


def resolve_rectangles(pending: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """Range join: every pending cell with the first body, in file order, whose rectangle holds it; without one it stays.

    Equal keys (workbook and sheet), the rectangle as residual condition, the first by an aggregate.
    """
    inside = F.expr("c.row BETWEEN b.row AND b.last_row AND c.col BETWEEN b.col AND b.last_col")
    same = [F.col(f"c.{k}") == F.col(f"b.{k}") for k in keys]
    first = (
        pending.alias("c").join(bodies.alias("b"), [*same, inside])
        .groupBy(*(F.col(f"c.{k}") for k in keys), "c.row", "c.col")
        .agg(F.min_by(F.struct("b.code", "b.extra", "b.array"), "b.seq").alias("body"))
    )
    return pending.join(first, [*keys, "row", "col"], "left")


def auto_filters(books: DataFrame, sheet: str | None = None) -> DataFrame:
    return decode_sheets(books, "filters", lambda _, data: filter_rows(data), sheet)


def pivot_tables(books: DataFrame, sheet: str | None = None) -> DataFrame:
    from .package import pivot_parts

    own = pivot_parts(books, sheet, "xlsb")
    keys = {"path": pa.string(), "sheet": pa.string(), "pivot_part": pa.string(), "cache": pa.string()}
    empty = "array<struct<fld: int, type: string>>"
    return decode(own, "pivots", keys).withColumnsRenamed({"pivot_part": "part", "cache": "pivot_cache_definition"}).withColumns({
        "row_fields": F.array().cast("array<int>"), "col_fields": F.array().cast("array<int>"),
        "data_fields": F.array().cast("array<struct<name: string, fld: int, subtotal: string>>"), "report_filters": F.array().cast(empty),
    })


def record_table(package_parts: DataFrame) -> DataFrame:
    """``path, part, seq, rec_type, payload, problem`` of every binary part, to look into files."""
    return decode(package_parts.filter(F.col("part_lc").endswith(".bin")), "records", {"path": pa.string(), "part": pa.string()})
