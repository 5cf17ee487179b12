"""One workbook package, read in one task: its sheets, strings and names, and its sheets' parts.

Everything a sheet needs to be decoded (its name, shared strings, defined names) lies in the
same file, so it is resolved where the file is open. A scan of sheets then needs no join and
no shuffle, however large the corpus.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from ..functions.worksheet_functions import load
from . import biff12
from .formula_tokens import Names

_PREFIX = re.compile(rb"<([A-Za-z_][\w.-]*):(?:worksheet|workbook|sst|Relationships|pivotTableDefinition)[\s>]")
_SPACE = re.compile(rb"\s+xml:space\s*=\s*(?:\"[^\"]*\"|'[^']*')")
_CELL = re.compile(rb"<c\s(?:[^>]*?\s)?r\s*=\s*[\"']([A-Z]+[0-9]+)[\"'][^>]*?(?:/>|>(?:.*?)</c>)", re.S)
_SHARED = re.compile(rb"<c\s[^>]*?\bt\s*=\s*[\"']s[\"'][^>]*>(?:(?!</c>).)*?<v>\s*([0-9]+)", re.S)


def plain_xml(data: bytes) -> bytes:
    """XML whose elements have no prefix, and whose text elements have no space attribute."""
    found = _PREFIX.search(data[:4096])
    if found:
        data = re.sub(rb"<(/?)" + re.escape(found[1]) + rb":", rb"<\1", data)
    return _SPACE.sub(b"", data)


def last_cells(data: bytes) -> bytes:
    """A worksheet in which every cell stands once: of cells with one address the last."""
    addresses = [m[1] for m in _CELL.finditer(data)]
    if len(set(addresses)) == len(addresses):
        return data
    last = {a: k for k, a in enumerate(addresses)}
    place = iter(range(len(addresses)))
    return _CELL.sub(lambda m: m[0] if last[m[1]] == next(place) else b"", data)


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _xml(data: bytes | None) -> ET.Element | None:
    try:
        return ET.fromstring(data) if data else None
    except ET.ParseError:
        return None


class Package:
    """``zipfile.BadZipFile`` if the content is none. Damaged parts are as if absent; ``problems`` names them."""

    def __init__(self, path: str, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.binary = not re.search(r"\.xls[xm]$", path, re.I)
        self.book = "xl/workbook.bin" if self.binary else "xl/workbook.xml"
        self.problems: list[tuple[str, str]] = []
        self.members: dict[str, list[tuple[str, zipfile.ZipInfo]]] = {}
        for info in self.zip.infolist():
            name = info.filename.replace("\\", "/").lstrip("/")
            self.members.setdefault(name.lower(), []).append((name, info))

    def read(self, name: str | None) -> bytes | None:
        """A part by its exact name, else the first that differs only in case."""
        found = self.members.get((name or "").lstrip("/").lower())
        if not found:
            return None
        info = next((i for n, i in found if n == name), found[0][1])
        try:
            return self.zip.read(info)
        except Exception as e:  # noqa: BLE001  a damaged part leaves the others readable
            self.problems.append((info.filename, f"{type(e).__name__}: {e}"))
            return None

    def links(self, part: str) -> dict[str, str]:
        """The relationships of a part, resolved, in order: id -> part. Of entries with one id the last holds."""
        folder, name = posixpath.split(part)
        root = _xml(self.read(f"{folder}/_rels/{name}.rels"))
        out: dict[str, str] = {}
        for e in root if root is not None else ():
            rel, target = e.get("Id"), (e.get("Target") or "").replace("\\", "/")
            if rel and target:
                out[rel] = posixpath.normpath(target if target.startswith("/") else posixpath.join("/", folder, target)).lstrip("/")
        return out

    def pivots(self, sheet: str | None = None) -> Iterator[tuple[str, str, str | None]]:
        """Sheet, pivot part and first cache definition; of the sheets that share a part the first one."""
        seen = set()
        for name, part, _ in self.sheet_links():
            for target in self.links(part).values() if part else ():
                if "/pivottables/" in target.lower() and target.lower() not in seen:
                    seen.add(target.lower())
                    if sheet is None or name == sheet:
                        yield name, target, next((t for t in self.links(target).values() if "/pivotcache/pivotcachedefinition" in t.lower()), None)

    def sheets(self) -> list[tuple[str, str | None]]:
        """Names and parts of the sheets in tab order."""
        return [(name, part) for name, part, _ in self.sheet_links()]

    def sheet_links(self) -> list[tuple[str, str | None, str]]:
        """Name, part and relationship of the sheets in tab order."""
        targets = self.links(self.book)
        if self.binary:
            listed = [(s["sheet"], s["rel_id"]) for s in biff12.sheet_rows(self.read(self.book) or b"")]
        else:
            root = _xml(self.read(self.book))
            found = [e for e in root.iter() if _tag(e) == "sheet"] if root is not None else []
            listed = [(e.get("name"), next((v for k, v in e.attrib.items() if k.endswith("}id")), None)) for e in found]
            listed = [(n, r) for n, r in listed if n and r]
        return [(name, targets.get(rel), rel) for name, rel in listed]

    def strings(self) -> list[str]:
        """Shared strings; runs concatenated, phonetic runs dropped."""
        if self.binary:
            return [r["text"] for r in biff12.sst_rows(self.read("xl/sharedStrings.bin") or b"")]
        root = _xml(self.read("xl/sharedStrings.xml"))
        return [rich_text(si) for si in root if _tag(si) == "si"] if root is not None else []

    def names(self, functions: dict | None = None) -> Names:
        """What formula tokens refer to by number."""
        data = self.read(self.book) or b""
        sheets = [s["sheet"] for s in biff12.sheet_rows(data)]
        links = biff12.link_rows(data)
        if links:
            sheets = [sheets[x["sheet_idx"]] if x["sheet_idx"] is not None and x["sheet_idx"] < len(sheets) else "" for x in links]
        defined = {r["idx"]: r["name"] for r in biff12.name_rows(data)}
        return Names(tuple(sheets), tuple(defined.get(k + 1, "") for k in range(max(defined, default=0))), load() if functions is None else functions)

    def wanted(self, sheet: str | None) -> Iterator[tuple[int, str, bytes]]:
        """Index, name and data of the sheets; other sheets are not even inflated."""
        for k, (name, part) in enumerate(self.sheets()):
            if sheet is None or name == sheet:
                data = self.read(part)
                if data:
                    yield k, name, data if self.binary else last_cells(plain_xml(data))


def rich_text(item: ET.Element) -> str:
    runs = [t.text or "" for r in item if _tag(r) == "r" for t in r if _tag(t) == "t"]
    return "".join(runs) if runs else next((t.text or "" for t in item if _tag(t) == "t"), "")


def shared_indexes(data: bytes) -> set[int]:
    """Numbers of the shared strings that a piece of a worksheet refers to."""
    return {int(m[1]) for m in _SHARED.finditer(data)}


_SHARED_F = re.compile(
    rb"<c\s(?:[^>]*?\s)?r\s*=\s*[\"']([A-Z]+[0-9]+)[\"']|<f\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:/>|>([^<]*)(?:<!\[CDATA\[(.*?)\]\]>)?[^<]*</f\s*>)", re.S
)
_ATTRIBUTE = re.compile(rb"([\w:]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_ENTITY = re.compile(r"&(?:#(\d+)|#x([0-9a-fA-F]+)|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _plain(text: bytes) -> str:
    """Text of XML without its entities."""
    return _ENTITY.sub(lambda m: chr(int(m[1])) if m[1] else chr(int(m[2], 16)) if m[2] else _NAMED[m[3]], text.decode("utf-8", "replace"))


def link_shared(piece: bytes, anchors: dict[bytes, tuple[str, str]]) -> tuple[bytes, list[dict]]:
    """Rows of a worksheet whose followers of a shared formula name their anchor by number, and these anchors.

    ``anchors`` (index -> cell and body) holds what came before in document order, and is carried on:
    a follower takes the latest earlier anchor with its index. Rows that share nothing stay as they are.
    """
    if b"shared" not in piece:
        return piece, []
    used: dict[tuple[str, str], int] = {}
    out, at, cell = [], 0, b""
    for m in _SHARED_F.finditer(piece):
        if m[1]:
            cell = m[1]
            continue
        has = {a[1]: a[2] if a[2] is not None else a[3] for a in _ATTRIBUTE.finditer(m[2])}
        if has.get(b"t") != b"shared":
            continue
        body, index = (m[4] or m[3] or b"").strip(), has.get(b"si", b"")
        if body:
            if b"ref" in has:
                anchors[index] = (cell.decode(), body.decode("utf-8", "replace") if m[4] else _plain(body))
        elif index in anchors:
            k = used.setdefault(anchors[index], len(used))
            out += (piece[at : m.start() + 2], b' anchor="%d"' % k)
            at = m.start() + 2
    out.append(piece[at:])
    return b"".join(out), [{"n": k, "cell": c, "body": b} for (c, b), k in used.items()]
