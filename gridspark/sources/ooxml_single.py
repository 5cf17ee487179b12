"""Open XML sheets and pivot parts of one package as rows, for readers that hold a single file.

The corpus relations (``ooxml``) parse in Catalyst; these give the same rows in Python, where no
Catalyst is at hand (the data source). Malformed XML raises ``ValueError``.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from ..functions.cells import FILTER_OPERATOR_NAMES, MAX_COLS, MAX_ROWS, PIECE
from .biff12 import _number
from .formula_tokens import letters
from .single import _tag, rich_text

_NUMBER = re.compile(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*")
_ADDRESS = re.compile(r"(\$?)([A-Z]{1,3})(\$?)([0-9]{1,7})")
_PIECE = re.compile(PIECE)


def root_of(data: bytes) -> ET.Element:
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise ValueError(f"malformed XML: {e}") from e


def column(name: str) -> int:
    out = 0
    for c in name:
        out = out * 26 + ord(c) - 64
    return out - 1


def _child(e: ET.Element | None, *names: str) -> ET.Element | None:
    for name in names:
        e = next((x for x in e if _tag(x) == name), None) if e is not None else None
    return e


def _children(e: ET.Element | None, *names: str) -> list[ET.Element]:
    held = _child(e, *names[:-1])
    return [x for x in held if _tag(x) == names[-1]] if held is not None else []


def _places(root: ET.Element) -> Iterator[tuple[int, int, ET.Element]]:
    for row in _children(root, "sheetData", "row"):
        for c in row:
            m = re.fullmatch(r"([A-Z]{1,3})([0-9]+)", c.get("r", "")) if _tag(c) == "c" else None
            if m:
                yield int(m[2]) - 1, column(m[1]), c


def cell_rows(root: ET.Element, strings: list[str]) -> Iterator[dict]:
    for row, col, c in _places(root):
        value = _value(c, strings)
        if value:
            yield {"row": row, "col": col, "from_formula": _child(c, "f") is not None, **value}


def _value(c: ET.Element, strings: list[str]) -> dict | None:
    kind, held = c.get("t", "n"), _child(c, "v")
    if kind == "inlineStr":
        own = _child(c, "is")
        return {"kind": "str", "v_str": rich_text(own) if own is not None else ""}
    if held is None:
        return None
    v = held.text or ""
    if kind == "s":
        k = int(v) if v.strip().isdigit() else -1
        return {"kind": "str", "v_str": strings[k] if 0 <= k < len(strings) else ""}
    if kind == "b" and v.strip().lower() in ("0", "1", "true", "false"):
        return {"kind": "bool", "v_bool": v.strip().lower() in ("1", "true")}
    if kind == "e":
        return {"kind": "error", "v_err": v}
    if kind not in ("str", "b") and _NUMBER.fullmatch(v) and abs(float(v)) != float("inf"):
        return _number(float(v))
    return {"kind": "str", "v_str": v}


def shifted(formula: str, rows: int, cols: int) -> str:
    """The formula with its relative references moved, around the sheet's edges."""
    def moved(m: re.Match) -> str:
        a = _ADDRESS.fullmatch(m[0])
        if not a or column(a[2]) >= MAX_COLS or not 0 < int(a[4]) <= MAX_ROWS:
            return m[0]
        col = a[2] if a[1] else letters((column(a[2]) + cols) % MAX_COLS)
        return f"{a[1]}{col}{a[3]}{a[4] if a[3] else (int(a[4]) - 1 + rows) % MAX_ROWS + 1}"

    return _PIECE.sub(moved, formula)


def formula_rows(root: ET.Element) -> Iterator[dict]:
    anchors: dict[str, tuple[int, int, str]] = {}
    for row, col, c in _places(root):
        f = _child(c, "f")
        if f is None:
            continue
        body, kind, index = (f.text or "").strip(), f.get("t"), f.get("si", "")
        if kind == "shared" and body and f.get("ref") is not None:
            anchors[index] = (row, col, body)
        plain = body.replace("_xludf.", "") if f.get("ca") == "1" else body
        if kind == "array" and body:
            text, what = "{=" + plain + "}", "array"
        elif body:
            text, what = "=" + (body if kind == "shared" else plain), "shared" if kind == "shared" else "normal"
        elif kind != "shared":
            continue
        elif index in anchors:
            r, k, own = anchors[index]
            text, what = "=" + shifted(own, row - r, col - k), "shared"
        else:
            text, what = "={shared_formula}", "unresolved"
        yield {"row": row, "col": col, "formula": text, "formula_kind": what, "parse_error": None}


def _criterion(e: ET.Element) -> dict:
    sign, val = FILTER_OPERATOR_NAMES.get(e.get("operator", "equal"), e.get("operator", "equal")), e.get("val")
    out = {"operator": sign, "kind": "text", "v_num": None, "v_str": None, "v_bool": None}
    if not (val or "").strip():
        return out | {"kind": "nonblank" if sign == "<>" else "blank"}
    try:
        return out | {"kind": "number", "v_num": float(val)}
    except ValueError:
        return out | {"v_str": val}


def filter_rows(root: ET.Element) -> list[dict]:
    found = _child(root, "autoFilter")
    if found is None or found.get("ref") is None:
        return []
    columns = []
    for c in _children(root, "autoFilter", "filterColumn"):
        listed, custom, top, dynamic = (_child(c, n) for n in ("filters", "customFilters", "top10", "dynamicFilter"))
        kind = next((k for k, e in (("discrete", listed), ("custom", custom), ("top10", top), ("dynamic", dynamic)) if e is not None), None)
        names = {"top10": ("top", "percent", "val", "filterVal"), "dynamic": ("type", "val", "maxVal")}.get(kind, ())
        held = top if kind == "top10" else dynamic
        columns.append({
            "col_id": int(c.get("colId")) if (c.get("colId") or "").isdigit() else None, "type": kind,
            "logic": ("and" if custom.get("and", "").lower() in ("1", "true") else "or") if kind == "custom" else None,
            "conditions": [_criterion(e) for e in _children(custom, "customFilter")] if kind == "custom" else None,
            "values": [e.get("val") for e in _children(listed, "filter")] if kind == "discrete" else None,
            "attrs": {n: held.get(n) for n in names if held.get(n) is not None} if names else None,
        })
    ref = found.get("ref")
    return [{"ref": ref, "top_left": ref.split(":")[0], "bottom_right": ref.split(":")[-1], "columns": columns}]


def pivot_row(root: ET.Element) -> dict:
    number = lambda e, k: int(e.get(k)) if e is not None and re.fullmatch(r"[-+]?\d+", e.get(k) or "") else None
    fields, where = _children(root, "pivotFields", "pivotField"), _child(root, "location")
    ref = where.get("ref") if where is not None else None
    indexes = lambda *p: [x for x in (number(e, "x") for e in _children(root, *p)) if x != -2]
    return {
        "name": root.get("name"), "cache_id": number(root, "cacheId"), "data_caption": root.get("dataCaption"),
        "pivot_fields": len(fields), "pivot_items": sum(len(_children(f, "items", "item")) for f in fields),
        "location": None if ref is None else {
            "rfx_geom": {"top_left": ref.split(":")[0], "bottom_right": ref.split(":")[-1]}, "rw_first_head": number(where, "firstHeaderRow"),
            "rw_first_data": number(where, "firstDataRow"), "col_first_data": where.get("firstDataCol"),
            "page_rows": number(where, "rowPageCount") or 0, "page_cols": number(where, "colPageCount") or 0,
        },
        "row_fields": indexes("rowFields", "field"), "col_fields": indexes("colFields", "field"),
        "data_fields": [{"name": e.get("name"), "fld": number(e, "fld"), "subtotal": e.get("subtotal", "sum")} for e in _children(root, "dataFields", "dataField")],
        "report_filters": [{"fld": number(e, "fld"), "type": "page"} for e in _children(root, "pageFields", "pageField")]
        + [{"fld": number(e, "fld"), "type": e.get("type")} for e in _children(root, "filters", "filter")],
        "sx_filters": None,
    }
