"""Macro projects: compound file -> streams -> module directory -> module source."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
MODULES = "path string, module string, module_type string, stream_name string, code_page int, source string, problem string"
# Code pages by number, where the name differs from 'cp<number>'.
CODE_PAGES = {10000: "mac_roman", 20866: "koi8-r", 28591: "latin-1", 28592: "iso8859-2", 28595: "iso8859-5", 51932: "euc_jp", 936: "gbk", 65001: "utf-8", 1200: "utf-16-le"}


class Damaged(ValueError):
    """A container or stream that can't be read on."""


def decompress(data: bytes) -> bytes:
    """Expand a compressed container: chunks of up to 4096 bytes, raw or of literals and copies."""
    if not data or data[0] != 1:
        raise Damaged("no compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        (head,) = struct.unpack_from("<H", data, at)
        at += 2
        end = min(len(data), at + (head & 0x0FFF) + 1)
        if not head & 0x8000:
            out += data[at:end]
            at = end
            continue
        start = len(out)
        while at < end:
            flags = data[at]
            at += 1
            for k in range(8):
                if at >= end:
                    break
                if not flags >> k & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end:
                    at = end
                    break
                (token,) = struct.unpack_from("<H", data, at)
                at += 2
                done = len(out) - start
                bits = max(4, (done - 1).bit_length()) if done else 4
                length, offset = (token & (0xFFFF >> bits)) + 3, (token >> (16 - bits)) + 1
                if offset > done:
                    raise Damaged("a copy reaches before its chunk")
                piece = out[len(out) - offset : len(out) - offset + length]
                while len(piece) < length:  # a copy may overlap what it writes
                    piece += piece[: length - len(piece)]
                out += piece
    return bytes(out)


class CompoundFile:
    """The streams of a compound file by their path, upper case."""

    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8] != MAGIC:
            raise Damaged("no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 16 or not 2 <= mini_shift <= shift:
            raise Damaged("odd sector size")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        self.directory_start, _, self.cutoff, mini_start, _, difat_start, _ = struct.unpack_from("<7I", data, 48)
        per = self.size // 4
        sectors = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while difat_start < END and difat_start not in seen:  # more of the list of allocation sectors
            seen.add(difat_start)
            block = self._sector(difat_start)
            if len(block) < self.size:
                break
            entries = struct.unpack(f"<{per}I", block)
            sectors += entries[:-1]
            difat_start = entries[-1]
        raw = b"".join(self._sector(s) for s in sectors if s < END)
        self.fat = struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
        raw = self._chain(mini_start, self.fat, self._sector) if mini_start < END else b""
        self.mini_fat = struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
        self.entries = self._directory()
        root = self.entries[0] if self.entries else None
        self.mini = self._chain(root[3], self.fat, self._sector) if root else b""

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def _chain(self, start: int, table: tuple[int, ...], read) -> bytes:
        out, seen = [], set()
        while start < END and start < len(table):
            if start in seen:
                raise Damaged("a chain of sectors runs in a circle")
            seen.add(start)
            out.append(read(start))
            start = table[start]
        return b"".join(out)

    def _directory(self) -> list[tuple]:
        raw = self._chain(self.directory_start, self.fat, self._sector)
        out = []
        for at in range(0, len(raw) - 127, 128):
            (n,) = struct.unpack_from("<H", raw, at + 64)
            name = raw[at : at + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<3I", raw, at + 68)
            start, size = struct.unpack_from("<IQ", raw, at + 116)
            out.append((name, raw[at + 66], (left, right, child), start, size if self.size > 512 else size & 0xFFFFFFFF))
        return out

    def streams(self) -> dict[str, bytes]:
        found, seen, todo = {}, set(), [(0, "")]
        while todo:
            k, above = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            name, kind, (left, right, child), start, size = self.entries[k]
            todo += [(left, above), (right, above)]
            here = above if kind == 5 else f"{above}{name.upper()}"
            if kind in (1, 5):
                todo.append((child, above if kind == 5 else here + "/"))
            elif kind == 2:
                small = size < self.cutoff
                m = self.mini_size
                read = (lambda n: self.mini[n * m : (n + 1) * m]) if small else self._sector
                found[here] = self._chain(start, self.mini_fat if small else self.fat, read)[:size]
        return found


def read_directory(data: bytes) -> tuple[int, list[dict]]:
    """Code page and modules (name, stream, offset, type) of a decompressed module directory."""
    page, modules, at, now = 1252, [], 0, None
    while at + 6 <= len(data):
        kind, n = struct.unpack_from("<HI", data, at)
        at += 6
        if kind == 0x0009:  # the version is two bytes longer than it says
            n += 2
        body = data[at : at + n]
        at += n
        if kind == 0x0003 and n >= 2:
            page = struct.unpack_from("<H", body)[0]
        elif kind == 0x0019:
            now = {"name": body, "stream": body, "offset": 0, "type": "procedural"}
            modules.append(now)
        elif now is None:
            continue
        elif kind == 0x001A:
            now["stream"] = body
        elif kind == 0x0032:
            now["wide_stream"] = body
        elif kind == 0x0047:
            now["wide_name"] = body
        elif kind == 0x0031 and n >= 4:
            now["offset"] = struct.unpack_from("<I", body)[0]
        elif kind == 0x0022:
            now["type"] = "class"
    return page, modules


def decoded(raw: bytes, page: int) -> str:
    name = CODE_PAGES.get(page, f"cp{page}")
    try:
        return raw.decode(name, "replace")
    except LookupError:
        return raw.decode("cp1252", "replace")


def read_project(data: bytes) -> list[dict]:
    """The modules of a macro project; a module that can't be read gives its problem."""
    streams = CompoundFile(data).streams()
    where = next((k for k in sorted(streams, key=len) if k == "DIR" or k.endswith("/DIR")), None)
    if where is None:
        raise Damaged("no module directory")
    page, modules = read_directory(decompress(streams[where]))
    folder = where[: -len("DIR")]
    out: dict[str, dict] = {}
    for m in modules:
        name = m["wide_name"].decode("utf-16-le", "replace") if "wide_name" in m else decoded(m["name"], page)
        stream = m["wide_stream"].decode("utf-16-le", "replace") if "wide_stream" in m else decoded(m["stream"], page)
        row = {"module": name, "module_type": m["type"], "stream_name": stream, "code_page": page, "source": None, "problem": None}
        try:
            row["source"] = decoded(decompress(streams[folder + stream.upper()][m["offset"] :]), page)
        except (KeyError, Damaged) as e:
            row["problem"] = f"{type(e).__name__}: {e}"
        out[name] = row  # of modules of one name the last one holds
    return list(out.values())


def modules(package_parts: DataFrame) -> DataFrame:
    """Modules of every workbook with a macro project, of either format; a broken project is one row with a problem."""
    schema = pa.schema([
        ("path", pa.string()), ("module", pa.string()), ("module_type", pa.string()), ("stream_name", pa.string()), ("code_page", pa.int32()), ("source", pa.string()), ("problem", pa.string()),
    ])

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):
                try:
                    rows = read_project(data.as_py() or b"")
                except (Damaged, struct.error, IndexError) as e:
                    rows = [{"problem": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist([{"path": path.as_py(), **r} for r in rows], schema=schema)

    return package_parts.filter("part_lc = 'xl/vbaproject.bin'").select("path", "data").mapInArrow(run, MODULES)
