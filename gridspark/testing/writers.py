"""Writers of small valid packages, for tests and for queries that go table -> workbook -> relation."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from ..sources import biff12, vba
from ..sources.formula_tokens import letters

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def package(parts: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data.encode() if isinstance(data, str) else data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rels_xml(targets: dict[str, str]) -> str:
    rows = "".join(f'<Relationship Id="{k}" Type="t" Target={quoteattr(v)}/>' for k, v in targets.items())
    return f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


class Strings:
    def __init__(self):
        self.at: dict[str, int] = {}

    def of(self, text: str) -> int:
        return self.at.setdefault(text, len(self.at))


# Cells are (row, col, value[, formula]); a formula is text, or a dict with t, si, ref, text.
def cell_xml(row: int, col: int, value, formula, strings: Strings) -> str:
    ref = f'r="{letters(col)}{row + 1}"'
    if formula is None:
        f = ""
    elif isinstance(formula, str):
        f = f"<f>{escape(formula)}</f>"
    else:
        f = "<f " + " ".join(f'{k}="{v}"' for k, v in formula.items() if k != "text") + f">{escape(formula.get('text', ''))}</f>"
    if value is None:
        return f"<c {ref}>{f}</c>" if f else ""
    if isinstance(value, bool):
        return f'<c {ref} t="b">{f}<v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c {ref}>{f}<v>{value!r}</v></c>"
    if value.startswith("#") and value.isupper():
        return f'<c {ref} t="e">{f}<v>{escape(value)}</v></c>'
    if f:
        return f'<c {ref} t="str">{f}<v>{escape(value)}</v></c>'
    return f'<c {ref} t="s"><v>{strings.of(value)}</v></c>'


def sheet_xml(cells: Iterable[tuple], strings: Strings, tail: str = "") -> str:
    rows: dict[int, list[str]] = {}
    for row, col, value, *formula in cells:
        rows.setdefault(row, []).append(cell_xml(row, col, value, formula[0] if formula else None, strings))
    body = "".join(f'<row r="{r + 1}">{"".join(cs)}</row>' for r, cs in sorted(rows.items()))
    return f'{HEAD}<worksheet xmlns="{MAIN}" xmlns:r="{DOC}"><sheetData>{body}</sheetData>{tail}</worksheet>'


def xlsx(sheets: dict[str, Iterable[tuple]], tails: dict[str, str] | None = None, extra: dict[str, bytes | str] | None = None, names: dict[str, str] | None = None) -> bytes:
    strings = Strings()
    parts: dict[str, bytes | str] = {}
    for k, (name, cells) in enumerate(sheets.items()):
        parts[f"xl/worksheets/sheet{k + 1}.xml"] = sheet_xml(cells, strings, (tails or {}).get(name, ""))
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(sheets))
    defined = "".join(f"<definedName name={quoteattr(n)}>{escape(t)}</definedName>" for n, t in (names or {}).items())
    parts["xl/workbook.xml"] = f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{DOC}"><sheets>{listed}</sheets>' + (f"<definedNames>{defined}</definedNames>" if defined else "") + "</workbook>"
    parts["xl/_rels/workbook.xml.rels"] = rels_xml({f"rId{k + 1}": f"worksheets/sheet{k + 1}.xml" for k in range(len(sheets))})
    items = "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in strings.at)
    parts["xl/sharedStrings.xml"] = f'{HEAD}<sst xmlns="{MAIN}">{items}</sst>'
    return package(parts | (extra or {}))


def record(kind: int, payload: bytes = b"") -> bytes:
    def groups(n: int) -> bytes:
        out = bytearray()
        while True:
            out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
            n >>= 7
            if not n:
                return bytes(out)

    return groups(kind) + groups(len(payload)) + payload


def wide(text: str) -> bytes:
    raw = text.encode("utf-16-le")
    return struct.pack("<I", len(raw) // 2) + raw


def parsed(code: bytes, extra: bytes = b"") -> bytes:
    return struct.pack("<I", len(code)) + code + struct.pack("<I", len(extra)) + extra


def rk_of(value: float) -> int | None:
    """The packed form of a number, or None."""
    if value == int(value) and -(1 << 29) <= value < 1 << 29:
        return (int(value) & 0x3FFFFFFF) << 2 | 2
    cents = round(value * 100)
    if cents / 100 == value and -(1 << 29) <= cents < 1 << 29:
        return (cents & 0x3FFFFFFF) << 2 | 3
    (bits,) = struct.unpack("<Q", struct.pack("<d", value))
    return bits >> 32 if bits & 0x3FFFFFFFF == 0 else None


def cell_record(col: int, value, formula: bytes | None, strings: Strings) -> bytes:
    head = struct.pack("<II", col, 0)
    if formula is not None:
        flags = b"\0\0"
        if isinstance(value, bool):
            return record(biff12.F_BOOL, head + bytes([value]) + flags + formula)
        if isinstance(value, (int, float)):
            return record(biff12.F_NUMBER, head + struct.pack("<d", value) + flags + formula)
        return record(biff12.F_TEXT, head + wide(value or "") + flags + formula)
    if value is None:
        return b""
    if isinstance(value, bool):
        return record(biff12.BOOL, head + bytes([value]))
    if isinstance(value, (int, float)):
        packed = rk_of(value)
        return record(biff12.RK, head + struct.pack("<I", packed)) if packed is not None else record(biff12.REAL, head + struct.pack("<d", value))
    codes = {v: k for k, v in biff12.ERROR_TEXT.items()}
    if value in codes:
        return record(biff12.ERROR, head + bytes([codes[value]]))
    return record(biff12.SHARED_TEXT, head + struct.pack("<I", strings.of(value)))


def sheet_bin(cells: Iterable[tuple], strings: Strings, tail: bytes = b"") -> bytes:
    """Cells as for Open XML; a formula is a parsed formula, or (parsed formula, records to follow)."""
    out, now = [], None
    for row, col, value, *formula in sorted(cells, key=lambda c: c[:2]):
        if row != now:
            out.append(record(biff12.ROW, struct.pack("<I", row) + b"\0" * 8))
            now = row
        f = formula[0] if formula else None
        after = b""
        if isinstance(f, tuple):
            f, after = f
        out.append(cell_record(col, value, f, strings) + after)
    return b"".join(out) + tail


def xlsb(sheets: dict[str, Iterable[tuple]], tails: dict[str, bytes] | None = None, extra: dict[str, bytes | str] | None = None, names: list[str] | None = None) -> bytes:
    strings = Strings()
    parts: dict[str, bytes | str] = {}
    for k, (name, cells) in enumerate(sheets.items()):
        parts[f"xl/worksheets/sheet{k + 1}.bin"] = sheet_bin(cells, strings, (tails or {}).get(name, b""))
    book = b"".join(record(biff12.SHEET, struct.pack("<II", 0, k + 1) + wide(f"rId{k + 1}") + wide(n)) for k, n in enumerate(sheets))
    book += b"".join(record(biff12.NAME, struct.pack("<IBI", 0, 0, 0) + wide(n) + parsed(b"\x1e\x01\x00")) for n in names or [])
    parts["xl/workbook.bin"] = book
    parts["xl/_rels/workbook.bin.rels"] = rels_xml({f"rId{k + 1}": f"worksheets/sheet{k + 1}.bin" for k in range(len(sheets))})
    parts["xl/sharedStrings.bin"] = b"".join(record(biff12.SST_ITEM, b"\0" + wide(t)) for t in strings.at)
    return package(parts | (extra or {}))


# Token streams.
def token_int(n: int) -> bytes:
    return struct.pack("<BH", 0x1E, n)


def token_number(d: float) -> bytes:
    return struct.pack("<Bd", 0x1F, d)


def token_text(s: str) -> bytes:
    raw = s.encode("utf-16-le")
    return struct.pack("<BH", 0x17, len(raw) // 2) + raw


def token_ref(row: int, col: int, token: int = 0x44, relative: bool = True) -> bytes:
    return struct.pack("<BIH", token, row & 0xFFFFF if token & 0x1F == 0x0C else row, col & 0x3FFF | (0xC000 if relative else 0))


def token_area(r1: int, r2: int, c1: int, c2: int, token: int = 0x25) -> bytes:
    return struct.pack("<BIIHH", token, r1, r2, c1 | 0xC000, c2 | 0xC000)


def token_func(number: int, count: int | None = None) -> bytes:
    return struct.pack("<BH", 0x41, number) if count is None else struct.pack("<BBH", 0x42, count, number)


def filter_records(ref: tuple[int, int, int, int], columns: Iterable[dict]) -> bytes:
    out = record(biff12.FILTER, struct.pack("<4I", *ref))
    for c in columns:
        out += record(biff12.FILTER_COLUMN, struct.pack("<I", c["col_id"]))
        out += b"".join(record(biff12.LISTED, wide(v)) for v in c.get("values", ()))
        if c.get("criteria"):
            out += record(biff12.CUSTOM_BEGIN, struct.pack("<I", c.get("logic") == "and"))
            out += b"".join(record(biff12.CUSTOM, criterion_bytes(*x)) for x in c["criteria"])
        out += record(biff12.FILTER_COLUMN_END)
    return out + record(biff12.FILTER_END)


def criterion_bytes(operator: int, value) -> bytes:
    if isinstance(value, bool):
        return bytes([0x08, operator, value]) + b"\0" * 7
    if isinstance(value, str):
        return bytes([0x06, operator]) + b"\0" * 8 + wide(value)
    if value is None:
        return bytes([0x0C, operator]) + b"\0" * 8
    return bytes([0x04, operator]) + struct.pack("<d", value)


def compress(data: bytes) -> bytes:
    """A container of chunks of literals; chunks of 3640 bytes stay within the 12-bit size."""
    out = bytearray(b"\x01")
    for at in range(0, len(data), 3640):
        chunk = data[at : at + 3640]
        body = bytearray()
        for k in range(0, len(chunk), 8):
            body += b"\0" + chunk[k : k + 8]
        out += struct.pack("<H", 0xB000 | (len(body) - 1)) + body
    return bytes(out)


def compound(streams: dict[str, bytes], sector: int = 512) -> bytes:
    """A compound file of one storage 'VBA' with the streams, all in whole sectors."""
    def padded(b: bytes) -> bytes:
        return b + b"\0" * (-len(b) % sector)

    def entry(name: str, kind: int, left=0xFFFFFFFF, right=0xFFFFFFFF, child=0xFFFFFFFF, start=0, size=0) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    names = list(streams)
    blocks = [padded(streams[n]) for n in names]
    count = -(-(2 + len(names)) * 128 // sector)
    starts, at = [], count
    for b in blocks:
        starts.append(at)
        at += len(b) // sector
    directory = entry("Root Entry", 5, child=1, start=vba.END) + entry("VBA", 1, child=2 if names else 0xFFFFFFFF)
    for k, n in enumerate(names):
        directory += entry(n, 2, right=3 + k if k + 1 < len(names) else 0xFFFFFFFF, start=starts[k] if blocks[k] else vba.END, size=len(streams[n]))
    fat: list[int] = list(range(1, count)) + [vba.END]
    for s, b in zip(starts, blocks):
        n = len(b) // sector
        fat += [*range(s + 1, s + n), vba.END] if n else []
    allocation = 1
    while (len(fat) + allocation) * 4 > allocation * sector:
        allocation += 1
    first = len(fat)
    fat += [0xFFFFFFFD] * allocation
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(allocation * sector, b"\xff")
    listed = list(range(first, first + allocation))
    if allocation > 109:
        raise ValueError("too large for this writer")
    header = vba.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    header += struct.pack("<9I", 0, allocation, 0, 0, 0, vba.END, 0, vba.END, 0)
    header += struct.pack("<109I", *listed, *[vba.FREE] * (109 - allocation))
    return header + padded(directory) + b"".join(blocks) + table


def vba_project(modules: dict[str, str], page: int = 1252, types: dict[str, str] | None = None) -> bytes:
    """A macro project with the modules' source, in the code page."""
    def item(kind: int, body: bytes = b"") -> bytes:
        return struct.pack("<HI", kind, len(body)) + body

    name = vba.CODE_PAGES.get(page, f"cp{page}")
    out = item(0x0001, b"\1\0\0\0") + item(0x0003, struct.pack("<H", page)) + struct.pack("<HIIH", 0x0009, 4, 1, 1) + item(0x000F, struct.pack("<H", len(modules)))
    streams = {}
    for k, (module, source) in enumerate(modules.items()):
        stream = f"M{k}"
        out += item(0x0019, module.encode(name, "replace")) + item(0x0047, module.encode("utf-16-le")) + item(0x001A, stream.encode()) + item(0x0032, stream.encode("utf-16-le"))
        out += item(0x0031, struct.pack("<I", 4)) + item(0x0022 if (types or {}).get(module) == "class" else 0x0021) + item(0x002B)
        streams[stream] = b"skip" + compress(source.encode(name, "replace"))
    return compound({"dir": compress(out + item(0x0010)), **streams})
