"""Packages with their authoring metadata blanked. The originals stay as they are."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame

# The elements whose text is blanked.
BLANKED = ("lastModifiedBy", "Application", "AppVersion")
_TAGS = re.compile(rb"(<(?:\w+:)?(?:" + "|".join(BLANKED).encode() + rb")(?:\s[^>]*)?>)[^<]*(</)")


def scrub(content: bytes) -> bytes:
    """The same parts in the same order; only document properties change."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for info in old.infolist():
            data = old.read(info)
            if info.filename.lower().startswith("docprops/"):
                data = _TAGS.sub(rb"\1\2", data)
            new.writestr(info, data, info.compress_type)
    return out.getvalue()


def strip_metadata(books: DataFrame) -> DataFrame:
    """``path, content`` of the scrubbed packages; what is no package passes unchanged."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                try:
                    data = scrub(data) if data else data
                except zipfile.BadZipFile:
                    pass
                yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "content": data}], schema=schema)

    return books.select("path", "content").mapInArrow(run, "path string, content binary")


def write_files(books: DataFrame, folder: str, root: str = "") -> None:
    """Write packages below a folder that all executors reach, one file per row.

    ``folder`` is a path or the URI of a file system (file, hdfs, s3, gs). A package keeps its path
    relative to ``root``, so that workbooks of one name in different folders stay apart; two rows of
    one path are one file.
    """
    base = _place(root)

    def save(rows):
        import os

        from pyarrow import fs

        system, target = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        for r in rows:
            own = _place(r.path)
            name = f"{target}/{own[len(base):].lstrip('/') if own.startswith(base) else own.lstrip('/')}"
            system.create_dir(name.rpartition("/")[0], recursive=True)
            part = f"{name}.{os.getpid()}.part"
            with system.open_output_stream(part) as f:
                f.write(r.content)
            system.move(part, name)  # a task that runs again replaces, never appends

    books.foreachPartition(save)


def _place(path: str) -> str:
    """A path without its scheme and host."""
    return re.sub(r"^[A-Za-z][\w+.-]*:(?://[^/]*)?", "", path)
