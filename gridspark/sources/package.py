"""Workbook packages: files -> parts -> relationships, sheets.

``binaryFile`` finds the files, one Arrow function inflates the wanted parts, and everything
after that is joins. A worksheet's XML comes out as a frame (all but the rows) and chunks of
rows, so that a huge sheet is many rows of the DataFrame instead of one.
"""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import package_format, resolve_path
from .single import Package, last_cells, link_shared, plain_xml, shared_indexes

CHUNK_BYTES = 4 << 20
PARTS = "path string, part string, part_lc string, namesakes array<string>, chunk int, chunk_kind string, data binary, text string, problem string"
_ROWS = re.compile(rb"<sheetData\s*>(.*)</sheetData\s*>", re.S)


def workbooks(spark: SparkSession, path: str, glob: str = "*.[xX][lL][sS][xXmMbB]") -> DataFrame:
    """``path, content`` of the workbook files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def sheet_chunks(data: bytes, chunk_bytes: int = CHUNK_BYTES) -> list[tuple[str, bytes]]:
    """('frame', everything but the rows), ('rows', ...) ... of a worksheet."""
    found = _ROWS.search(data)
    if not found:
        return [("frame", data)]
    out = [("frame", data[: found.start()] + data[found.end() :])]
    rows, at = found[1], 0
    while at < len(rows):
        end = len(rows)
        if end - at > chunk_bytes:
            # cut before the first row that starts after the wanted size
            mark = re.compile(rb"<row[\s>/]").search(rows, at + chunk_bytes)
            end = mark.start() if mark else len(rows)
        out.append(("rows", b"<worksheet><sheetData>" + rows[at:end] + b"</sheetData></worksheet>"))
        at = end
    return out


def inflate(content: bytes | None, wanted: re.Pattern, chunk_bytes: int = CHUNK_BYTES) -> list[tuple]:
    """``part, part_lc, namesakes, chunk, chunk_kind, data, problem`` of the wanted parts; a broken package gives its problem."""
    if not content:
        return []
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            names: dict[str, list[str]] = {}
            for info in package.infolist():
                name = info.filename.replace("\\", "/").lstrip("/")
                names.setdefault(name.lower(), []).append(name)
            for info in package.infolist():
                part = info.filename.replace("\\", "/").lstrip("/")
                low = part.lower()
                if info.is_dir() or not wanted.search(low):
                    continue
                try:
                    data = package.read(info)
                except Exception as e:  # a damaged part leaves the others readable
                    out.append((part, low, names[low], 0, "damaged", None, f"{type(e).__name__}: {e}"))
                    continue
                if low.endswith((".xml", ".rels")):
                    data = plain_xml(data)
                if low.startswith("xl/worksheets/") and low.endswith(".xml"):
                    out += [(part, low, names[low], k, kind, d, None) for k, (kind, d) in enumerate(sheet_chunks(last_cells(data), chunk_bytes))]
                else:
                    out.append((part, low, names[low], 0, "whole", data, None))
    except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
        out.append((None, None, None, 0, "package", None, f"{type(e).__name__}: {e}"))
    return out


def _as_text(row: tuple) -> tuple:
    """XML leaves as text, anything else as bytes."""
    *head, data, problem = row
    if data is not None and row[1].endswith((".xml", ".rels")):
        return *head, None, data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace"), problem
    return *head, data, None, problem


def parts(books: DataFrame, wanted: str = r"\.(?:xml|bin|rels)$", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The parts whose lower-case name matches ``wanted``; nothing else is inflated."""
    pattern = re.compile(wanted)
    schema = pa.schema([
        ("path", pa.string()), ("part", pa.string()), ("part_lc", pa.string()), ("namesakes", pa.list_(pa.string())),
        ("chunk", pa.int32()), ("chunk_kind", pa.string()), ("data", pa.binary()), ("text", pa.string()), ("problem", pa.string()),
    ])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = [(path.as_py(), *_as_text(r)) for r in inflate(content.as_py(), pattern, chunk_bytes)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return books.select("path", "content").mapInArrow(run, PARTS)


SHEET_CHUNKS = "path string, sheet_idx int, sheet string, chunk int, text string, strings map<int, string>, anchors array<struct<n: int, cell: string, body: string>>"


def sheet_texts(books: DataFrame, sheet: str | None, frames: bool, strings: bool = False, chunk_bytes: int = CHUNK_BYTES, anchors: bool = False) -> DataFrame:
    """Open XML worksheets: their frames, or their rows in chunks with the shared strings and formulas these refer to.

    No join and no shuffle; with ``sheet`` only the sheets of that name are inflated.
    """
    schema = pa.schema([
        ("path", pa.string()), ("sheet_idx", pa.int32()), ("sheet", pa.string()), ("chunk", pa.int32()), ("text", pa.string()), ("strings", pa.map_(pa.int32(), pa.string())),
        ("anchors", pa.list_(pa.struct([("n", pa.int32()), ("cell", pa.string()), ("body", pa.string())]))),
    ])

    def run(batches):
        for path, package in _packages(batches):
            known = None
            for idx, name, data in package.wanted(sheet):
                earlier: dict[bytes, tuple[str, str]] = {}
                for k, (kind, piece) in enumerate(sheet_chunks(data, chunk_bytes)):
                    if (kind == "frame") != frames:
                        continue
                    own, shared = [], []
                    if anchors:
                        piece, shared = link_shared(piece, earlier)
                    if strings and (used := shared_indexes(piece)):
                        known = package.strings() if known is None else known
                        own = [(i, known[i]) for i in used if i < len(known)]
                    text = piece.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
                    yield pa.RecordBatch.from_pylist([{"path": path, "sheet_idx": idx, "sheet": name, "chunk": k, "text": text, "strings": own, "anchors": shared}], schema=schema)

    return books.filter(package_format("path") == "xlsx").select("path", "content").mapInArrow(run, SHEET_CHUNKS)


def sheet_table(books: DataFrame) -> DataFrame:
    """``path, format, sheet_idx, sheet, rel_id, part`` of both formats, in one pass over the files."""
    schema = pa.schema([
        ("path", pa.string()), ("format", pa.string()), ("sheet_idx", pa.int32()), ("sheet", pa.string()), ("rel_id", pa.string()), ("part", pa.string()),
    ])

    def run(batches):
        for path, package in _packages(batches):
            kind = "xlsb" if package.binary else "xlsx"
            rows = [{"path": path, "format": kind, "sheet_idx": k, "sheet": n, "rel_id": r, "part": p} for k, (n, p, r) in enumerate(package.sheet_links())]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return books.select("path", "content").mapInArrow(run, "path string, format string, sheet_idx int, sheet string, rel_id string, part string")


PIVOT_PARTS = "path string, sheet string, pivot_part string, cache string, data binary, text string"


def pivot_parts(books: DataFrame, sheet: str | None, kind: str) -> DataFrame:
    """The pivot parts of one format with the sheet and the cache they are linked to."""
    schema = pa.schema([
        ("path", pa.string()), ("sheet", pa.string()), ("pivot_part", pa.string()), ("cache", pa.string()), ("data", pa.binary()), ("text", pa.string()),
    ])

    def run(batches):
        for path, package in _packages(batches):
            for name, part, cache in package.pivots(sheet):
                data = package.read(part)
                if data is not None:
                    text = None if package.binary else plain_xml(data).decode("utf-8", "replace")
                    yield pa.RecordBatch.from_pylist(
                        [{"path": path, "sheet": name, "pivot_part": part, "cache": cache, "data": data if package.binary else None, "text": text}], schema=schema)

    return books.filter(package_format("path") == kind).select("path", "content").mapInArrow(run, PIVOT_PARTS)


def _packages(batches):
    """The readable packages of Arrow batches of (path, content)."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            data = content.as_py()
            try:
                package = Package(path.as_py(), data) if data else None
            except (zipfile.BadZipFile, ValueError, NotImplementedError):
                continue
            if package:
                yield path.as_py(), package


def problems(books: DataFrame) -> DataFrame:
    """``path, part, problem`` of packages and parts that can't be read."""
    return parts(books).filter("problem is not null").select("path", "part", "problem")


def xml(text: str, schema: str) -> Column:
    """Parse XML; malformed text gives nulls."""
    return F.from_xml(F.col(text), F.lit(schema), {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"})


RELS_SCHEMA = "struct<Relationship: array<struct<_Id: string, _Target: string, _Type: string, _TargetMode: string>>>"


def rels(package_parts: DataFrame) -> DataFrame:
    """``path, source_part, rel_id, target, resolved, rel_seq``. Of entries with the same id the last one holds."""
    source = F.regexp_replace(F.regexp_replace("part", r"(^|/)_rels/", "$1"), r"\.[rR][eE][lL][sS]$", "")
    found = (
        package_parts.filter(F.col("part_lc").endswith(".rels"))
        .select("path", source.alias("source_part"), xml("text", RELS_SCHEMA).alias("x"))
        .select("path", "source_part", F.posexplode("x.Relationship").alias("rel_seq", "r"))
        .select("path", "source_part", "rel_seq", F.col("r._Id").alias("rel_id"), F.col("r._Target").alias("target"))
        .filter("rel_id is not null and target is not null")
    )
    return (
        found.groupBy("path", "source_part", "rel_id")
        .agg(F.max_by("target", "rel_seq").alias("target"), F.max("rel_seq").alias("rel_seq"))
        .withColumn("resolved", resolve_path("source_part", "target"))
    )


NAMES_SCHEMA = "struct<definedNames: struct<definedName: array<struct<_name: string, _VALUE: string>>>>"


def ooxml_defined_names(package_parts: DataFrame) -> DataFrame:
    """``path, idx`` (1-based)``, name, refers_to``."""
    return (
        package_parts.filter((F.col("part_lc") == "xl/workbook.xml") & (package_format("path") == "xlsx"))
        .select("path", xml("text", NAMES_SCHEMA).alias("x"))
        .select("path", F.posexplode("x.definedNames.definedName").alias("idx", "n"))
        .select("path", (F.col("idx") + 1).alias("idx"), F.col("n._name").alias("name"), F.col("n._VALUE").alias("refers_to"))
    )
