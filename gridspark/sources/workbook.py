"""The Python data source ``workbook``: ``spark.read.format("workbook").option("entity", "cells").load(path)``.

Entities: ``sheets``, ``cells``, ``formulas``, ``auto_filters``, ``pivot_tables``, ``vba_modules`` with the
columns of ``gridspark.operators.relations``, and ``parts`` and ``problems`` (packages, sheets and
pivot parts that can't be read). ``path`` is a file, a folder or the URI of a file system that
Arrow knows (file, hdfs, s3, gs). Small files are read several to a task, at most ``task_bytes``
together. Filters on ``sheet`` and ``path`` keep other sheets and files from being decoded. For
operations over a corpus the functions of ``relations`` are the faster way: they parse in Catalyst.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from . import biff12, ooxml_single, single, vba
from .formula_tokens import letters

_CRITERION = "struct<operator: string, kind: string, v_num: double, v_str: string, v_bool: boolean>"
_SHEET = "path string, sheet_idx int, sheet string, "
SCHEMAS = {
    "sheets": "path string, format string, sheet_idx int, sheet string, rel_id string, part string",
    "parts": "path string, part string, size bigint",
    "problems": "path string, part string, problem string",
    "cells": _SHEET + "row int, col int, addr string, kind string, v_int bigint, v_num double, v_str string, v_bool boolean, v_err string, from_formula boolean",
    "formulas": _SHEET + "row int, col int, addr string, formula string, formula_kind string, parse_error string",
    "auto_filters": _SHEET + "ref string, top_left string, bottom_right string, columns array<struct<col_id: int, type: string, logic: string, "
    f"conditions: array<{_CRITERION}>, `values`: array<string>, attrs: map<string, string>>>",
    "pivot_tables": "path string, sheet string, part string, name string, cache_id int, data_caption string, pivot_cache_definition string, pivot_fields int, pivot_items int, "
    "location struct<rfx_geom: struct<top_left: string, bottom_right: string>, rw_first_head: int, rw_first_data: int, col_first_data: string, page_rows: int, page_cols: int>, "
    "row_fields array<int>, col_fields array<int>, data_fields array<struct<name: string, fld: int, subtotal: string>>, report_filters array<struct<fld: int, type: string>>, "
    f"sx_filters array<struct<field_index: int, filter_type: int, criteria: array<{_CRITERION}>>>",
    "vba_modules": "path string, module string, module_type string, source string",
}
#: Bytes of the files of one task, and how much a file counts at least.
TASK_BYTES, FILE_BYTES = 32 << 20, 1 << 20


def _system(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path within it, and what stands before it."""
    path = re.sub(r"^file:(?=/)(?!//)", "", path)
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, path[: path.rfind(inside)] if inside in path else ""


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("entity", "cells")]

    def reader(self, schema) -> DataSourceReader:
        kind = PushingReader if str(self.options.get("pushdown", "true")).lower() == "true" else WorkbookReader
        return kind(self.options)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))
        self.paths = paths


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.entity, self.path = options.get("entity", "cells"), options["path"]
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.only: dict[str, str] = {}

    def partitions(self):
        system, inside, prefix = _system(self.path)
        info = system.get_file_info(inside)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
        files = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and (f is info or re.search(r"\.xls[xmb]$", f.path, re.I)))
        out, held, size = [], [], 0
        for path, n in files:
            if self.only.get("path", prefix + path) != prefix + path:
                continue
            n = max(n, FILE_BYTES)
            if held and size + n > self.task_bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append(prefix + path)
            size += n
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            system, inside, _ = _system(path)
            with system.open_input_stream(inside) as f:
                content = f.read()
            problems: list[tuple[str, str | None, str]] = []
            try:
                book = single.Package(path, content)
                rows = list(getattr(self, f"_{self.entity}")(path, book, problems)) if self.entity != "problems" else []
                if self.entity == "problems":
                    for entity in ("cells", "pivot_tables", "vba_modules"):
                        for _ in getattr(self, f"_{entity}")(path, book, problems):
                            pass
                    problems += [(path, part, text) for part, text in book.problems]
            except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
                rows, problems = [], [(path, None, f"{type(e).__name__}: {e}")]
            yield from dict.fromkeys(problems) if self.entity == "problems" else rows

    def _wanted(self, path, book, problems):
        """Index, name and content of the sheets: bytes of a binary one, the tree of the other."""
        for idx, name, data in book.wanted(self.only.get("sheet")):
            try:
                yield idx, name, data if book.binary else ooxml_single.root_of(data)
            except ValueError as e:
                problems.append((path, name, str(e)))

    def _parts(self, path, book, problems):
        return ((path, name, info.file_size) for found in book.members.values() for name, info in found)

    def _sheets(self, path, book, problems):
        only = self.only.get("sheet")
        return ((path, "xlsb" if book.binary else "xlsx", k, n, r, p) for k, (n, p, r) in enumerate(book.sheet_links()) if only is None or n == only)

    def _cells(self, path, book, problems):
        strings = book.strings()
        for idx, sheet, held in self._wanted(path, book, problems):
            for c in biff12.cell_rows(held) if book.binary else ooxml_single.cell_rows(held, strings):
                k = c.pop("isst", None)
                if k is not None:
                    c["v_str"] = strings[k] if k < len(strings) else ""
                yield (path, idx, sheet, c["row"], c["col"], _addr(c), c["kind"], *(c.get(n) for n in ("v_int", "v_num", "v_str", "v_bool", "v_err")), c["from_formula"])

    def _formulas(self, path, book, problems):
        names = book.names() if book.binary else None
        for idx, sheet, held in self._wanted(path, book, problems):
            for r in biff12.formula_texts(held, names) if book.binary else ooxml_single.formula_rows(held):
                yield path, idx, sheet, r["row"], r["col"], _addr(r), r["formula"], r["formula_kind"], r["parse_error"]

    def _auto_filters(self, path, book, problems):
        for idx, sheet, held in self._wanted(path, book, problems):
            for r in biff12.filter_rows(held) if book.binary else ooxml_single.filter_rows(held):
                yield path, idx, sheet, r["ref"], r["top_left"], r["bottom_right"], _rows(r["columns"])

    def _pivot_tables(self, path, book, problems):
        for sheet, part, cache in book.pivots(self.only.get("sheet")):
            data = book.read(part)
            if data is None:
                continue
            try:
                own = biff12.pivot_rows(data)[0] if book.binary else ooxml_single.pivot_row(ooxml_single.root_of(single.plain_xml(data)))
            except ValueError as e:
                problems.append((path, part, str(e)))
                continue
            own = {"row_fields": [], "col_fields": [], "data_fields": [], "report_filters": [], **own, "path": path, "sheet": sheet, "part": part, "pivot_cache_definition": cache}
            yield tuple(_rows(own[n]) for n in PIVOT_NAMES)

    def _vba_modules(self, path, book, problems):
        data = book.read("xl/vbaProject.bin")
        try:
            for m in vba.read_project(data) if data else ():
                if m["source"] is not None:
                    yield path, m["module"], m["module_type"], m["source"]
        except vba.Damaged as e:
            problems.append((path, "xl/vbaProject.bin", str(e)))


PIVOT_NAMES = (
    "path", "sheet", "part", "name", "cache_id", "data_caption", "pivot_cache_definition", "pivot_fields", "pivot_items", "location", "row_fields", "col_fields",
    "data_fields", "report_filters", "sx_filters",
)


def _addr(r: dict) -> str:
    return f"{letters(r['col'])}{r['row'] + 1}"


def _rows(x):
    """Nested dicts as rows, but for maps of attributes."""
    if isinstance(x, list):
        return [_rows(y) for y in x]
    return Row(**{k: v if k == "attrs" else _rows(v) for k, v in x.items()}) if isinstance(x, dict) else x


class PushingReader(WorkbookReader):
    """Takes equality on ``sheet`` and ``path``; Spark keeps the rest."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("sheet",), ("path",)) and f.attribute[0] not in self.only:
                self.only[f.attribute[0]] = f.value
            else:
                yield f


def register(spark: SparkSession) -> None:
    """Register the source and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
