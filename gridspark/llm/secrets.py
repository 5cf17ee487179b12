"""Credentials in source code: find them by a corpus-wide index, re-scan, and mask them.

Three steps. (1) Every literal and comment is read for values that stand where a credential
would stand (a password of a connection, a token of a header, a key of a known format, a
random constant). (2) Every file is scanned again, whole, for all those values with an
Aho-Corasick automaton, also where literals joined by & split a value. (3) The places found are
the index: the owners of a value are the workbooks that hold it, copies and edited copies of a
module (near-duplicate groups) counting once, and a value that ``SHARED`` owners or more hold,
times the strength of its place, is a placeholder or a common word and is suppressed.

A value of letters only, or that looks like a number or a cell address, counts where it stands as a
credential or is a whole literal; any other value counts wherever it stands, unless it goes on in
letters or digits.

The automaton is a broadcast of at most ``BLOCK_CHARS`` characters of values; more values make
more blocks, one after the other, each of which meets every file. The result does not depend on
how the files are partitioned.

Defined results: null and empty texts give no rows; a repeated row gives the same rows once;
a private key counts once, at its BEGIN line, and reaches to its END line; a value split over
concatenated literals counts where its first part begins; without a column ``path`` every module
is an owner of its own; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache, reduce
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .near_dup import near_duplicate_groups
from .vba_text import Lines, Segment, segments

#: A value with so many owners, times the strength of its place, is a placeholder.
SHARED = 8
#: Characters of the values in one automaton (about 50 bytes of memory each).
BLOCK_CHARS = 2_000_000

#: Names under which credentials stand, in the languages of the corpus.
_NAMES = (
    "pass(?:word|wort|wd|phrase)?", "pwd", r"(?<![a-z])pw(?![a-z])", r"(?-i:(?<=[a-z])P[wW](?![a-z]))", "kennwort", "senha", "mdp", "mot[_ ]?de[_ ]?passe", "contrase(?:ñ|n)a", "clave", "has[lł]o", "wachtwoord",
    "parola", "chiave", "пароль", "секрет", "ключ", "密码", "密碼", "密钥", "パスワード", "secret", "token", "api_?key", "access_?key", "private_?key", "credential",
)
_NAME = re.compile(rf"(?:{'|'.join(_NAMES)}|_key(?:_?b64)?)\w*$|^(?:{'|'.join(_NAMES)})", re.I)
#: Formats that issuers publish.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?:AKIA|ASIA)[0-9A-Z]{16}"
    r"|[sr]k_live_[0-9A-Za-z]{16,}"
    r"|xox[abeoprs]-[0-9A-Za-z-]{10,}"
    r"|gh[oprsu]_[0-9A-Za-z]{30,}|github_pat_[0-9A-Za-z_]{30,}|glpat-[0-9A-Za-z_-]{20,}"
    r"|AIza[0-9A-Za-z_-]{35}"
    r"|SG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}"
    r"|eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"
    r")"
)
_CONNECTION = re.compile(r"(?:^|[;{\s])(?:password|passwort|pwd|passwd)\s*=\s*([^;\"]+)", re.I)
_URL_USER = re.compile(r"[a-z][a-z0-9+.-]*://[^/\s:@\"]+:([^/\s@\"]+)@", re.I)
_URL_QUERY = re.compile(r"[?&](?:\w*(?:api_?key|token|secret|password|passwd|pwd|signature)|key|sig|auth|code)=([^&\s\"#]+)", re.I)
_HEADER = re.compile(r"^\s*(?:Authorization:\s*)?(?:Bearer|Basic|Token|ApiKey)\s+(\S+)\s*$", re.I)
_JSON = re.compile(r"\"\"\w*(?:secret|password|passwd|pwd|token|api_?key|access_?key|private_?key)\w*\"\"\s*:\s*\"\"([^\"]+)\"\"", re.I)
_COMMAND = re.compile(r"(?:^|\s)(?:-u|--user|-U)[ =]?\s*[^\s:\"]+:([^\s\"]+)")
_SAID = re.compile(
    rf"(?:^|[\s/,;(])(?:{'|'.join(_NAMES)})(?:\s*(?:is|ist|est|es|jest|=|:|：)\s*|\s+)(\S+?)[.,;)]?\s*$|(?:密码|密碼|パスワード|пароль)\s*[:：=はは是为]*\s*([!-~]+)\s*$", re.I
)
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_BODY = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}")
#: A line that may stand between BEGIN and END: a piece of the body, a header of the key, or nothing.
_KEY_LINE = re.compile(r"[A-Za-z0-9+/]{16,}|[A-Z][\w-]+: |^\W*$|vb(?:Cr)?Lf")
#: Something of this stands, in small letters, in every text that one of the patterns above can match.
_TRIGGERS = (
    "pass", "pwd", "token", "secret", "key", "sig=", "code=", "auth=", "://", "bearer", "basic", "akia", "asia", "k_live_", "xox", "gho_", "ghp_", "ghr_", "ghs_", "ghu_",
    "github_pat", "glpat", "sg.", "eyj", "-u", "-user", "credential", "pw", "kennwort", "senha", "mdp", "mot", "contrase", "clave", "has", "wachtwoord", "parola", "chiave",
    "пароль", "секрет", "ключ", "密码", "密碼", "密钥", "パスワード",
)


@lru_cache(None)
def _trigger_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in _TRIGGERS:
        automaton.add_word(word, len(word))
    automaton.make_automaton()
    return automaton


def _triggers(text: str) -> list[int]:
    """Where the trigger words end, in order."""
    low = text.lower()
    if len(low) != len(text):  # letters that are two in small
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return [last for last, _ in _trigger_automaton().iter(low)]


#: What stands before a literal that is given to a credential: a name, or a call's argument.
_TARGET = re.compile(r"([\w.]+)\)?\s*(?:As\s+\w+\s*)?:?=\s*$", re.I)
_KEYED = re.compile(r"\(\s*\"([^\"]+)\"\s*\)\s*=\s*$")
_LOGIN = re.compile(r"\b\w*(?:login|logon|connect|signin|auth)\w*\s*\(?\s*(?:\w+\s*:?=\s*)?\"[^\"]*\"\s*,\s*$", re.I)
#: The password of an open connection: connection, user and password as arguments.
_OPENED = re.compile(r"\.open\b\s*\(?\s*(?:\w+\s*:=\s*)?(?:\"[^\"]*\"|[\w.]+)\s*,\s*(?:[^,\"]*,\s*){0,2}\"[^\"]*\"\s*,\s*$", re.I)
_PROTECT = re.compile(r"\b(?:un)?protect\s*\(?\s*(?:password\s*:=\s*)?$", re.I)
_OPEN = re.compile(r"\bworkbooks\.open\b[^\"]*,\s*,\s*,\s*,\s*$", re.I)
#: What stands for a value instead of being one.
_PLACEHOLDER = re.compile(
    r"^(?:<.*>|\[.*\]|\{.*\}|%.*%|\$\{?\w+\}?|[*xX.•#_-]+|n/?a|none|null|empty|your.*|my.?pass.*|change.?me.*|todo|tbd|example.*|.*EXAMPLE(?:KEY)?|dummy.*|sample.*|redacted.*|masked)$", re.I
)
_RUN = re.compile(r"(.)\1{7}")
#: Names under which stands what is said of a credential, and not the credential.
_ABOUT = re.compile(r"(?:label|prompt|caption|title|text|msg|message|field|column|col|header|name|type|path|file|sheet|range|cell|box|url|uri|char|len(?:gth)?)s?\d*$", re.I)
_SECRET_NAME = re.compile(rf"(?:{'|'.join(n for n in _NAMES if 'key' not in n and n not in ('token', 'clave', 'chiave', 'ключ'))})", re.I)
_PICTURE = re.compile(r"^(?:iVBOR|R0lGOD|/9j/|Qk[0-9A-Za-z]|UEsDB|JVBER|PHN2Z|data:)")
#: No white space, and none of the signs of a path, a query or a format.
_BARE = re.compile(r"[^\s\\:;<>]{4,}")
_UUID = re.compile(r"^\{?[0-9A-F]{8}-(?:[0-9A-F]{4}-){3}[0-9A-F]{12}\}?$", re.I)
_CHECKSUM = re.compile(r"\b(?:md5|sha-?\d*|crc\d*|checksum|hash|etag|digest|guid|uuid|thumbprint|fingerprint)\b", re.I)
_PICTURE_NAME = re.compile(r"(?:icon|png|gif|jpe?g|logo|image|img|picture|bitmap)", re.I)
_OPAQUE = re.compile(r"^[A-Za-z0-9+/_=.!?~*-]+$")
_JOIN = re.compile(r'"[ \t]*&\s*(?:_[ \t]*\r?\n\s*)?"')
#: An account and what opens it, in a note: ``ERP: name / word value``.
_NOTED = re.compile(r"^[^:/]{1,40}:\s*\S+\s*/\s*(?:\S+\s+){1,2}(\S+?)\s*$")
_DULL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+|[0-9.,#]+|[A-Z]{1,3}\d+")
FOUND = "module_id bigint, owner string, line_no int, start int, length int, kind string, value string, part int, strength int"


class Found(NamedTuple):
    """``value`` at a place of the file; ``part`` > 0 continues a value begun before."""

    start: int
    length: int
    value: str
    part: int
    kind: str
    strength: int


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def opaque(value: str) -> bool:
    """Random-looking: no words, no path, of several kinds of characters or long hexadecimal."""
    if len(value) < 12 or not _OPAQUE.match(value) or _PICTURE.match(value) or _UUID.match(value):
        return False
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return len(value) >= 32 and entropy(value) > 3
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]"))
    switches = len(re.findall(r"[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Za-z]|[A-Z][a-z](?=[A-Z0-9])", value))
    digits = sum(c.isdigit() for c in value)
    return kinds == 3 and digits > 1 and switches >= len(value) / 4 and entropy(value) > 3.2 and not re.search(r"[/.]\w+[/.]", value)


def plausible(value: str) -> bool:
    """A literal that stands where a password stands and may be one."""
    return len(value) >= 4 and len(set(value)) > 2 and not _PLACEHOLDER.match(value) and not _RUN.search(value) and not re.search(r"\s", value)


def strong(value: str) -> bool:
    """Letters and digits with signs or capitals between them: more than a name with a number."""
    return len(value) >= 8 and bool(re.search(r"\d", value) and re.search(r"[^\W\d_]", value)) and (
        bool(re.search(r"[^\w\s.:,/\\]", value)) or opaque(value) or len(re.findall(r"[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Za-z]", value)) > 2
    )


def groups(text: str, segs: list[Segment]):
    """Comments one by one, literals with all that are joined to them by &."""
    k = 0
    while k < len(segs):
        group = [segs[k]]
        if segs[k].kind == "literal":
            while k + 1 < len(segs) and segs[k + 1].kind == "literal" and re.fullmatch(
                r'"?\s*&\s*(?:_[ \t]*\r?\n\s*)?"', text[group[-1].end : segs[k + 1].start]
            ):
                k += 1
                group.append(segs[k])
        k += 1
        yield group, segs[k] if k < len(segs) else None


def _parts(group: list[Segment], a: int, n: int) -> list[tuple[int, int]]:
    """Where the characters a to a + n of joined literals stand in the file."""
    out, at = [], 0
    for s in group:
        x, y = max(a - at, 0), min(a + n - at, s.end - s.start)
        if x < y:
            out.append((s.start + x, y - x))
        at += s.end - s.start
    return out


def candidates(text: str) -> list[Found]:
    """Values in a file that may be credentials, with how sure their place makes it (1-3)."""
    out: list[Found] = []
    segs = segments(text)
    keys = _private_keys(text)
    for begin, end, body in keys:
        out.append(Found(begin, end - begin, body, 0, "private_key", 3))
    lines, triggers = Lines(text), _triggers(text)
    for group, following in groups(text, segs):
        if keys and any(a <= group[0].start < b for a, b, _ in keys):
            continue
        # a trigger word may lie across a join
        told = len(group) > 1 or bisect_left(triggers, group[0].start) < bisect_left(triggers, group[-1].end)
        _read_group(text, lines, group, following, told, out)
    return out


def _private_keys(text: str) -> list[tuple[int, int, str]]:
    """(position of BEGIN, end, first line of the body) of the private keys that have a body.

    A key ends at its END line; without one before the next key, where its lines end.
    """
    out = []
    begins = list(_BEGIN.finditer(text))
    for k, m in enumerate(begins):
        stop = begins[k + 1].start() if k + 1 < len(begins) else len(text)
        end = _END.search(text, m.end(), stop)
        if end:
            stop = end.start()
        else:
            at = text.find("\n", m.end(), stop)
            while at >= 0:
                after = text.find("\n", at + 1, stop)
                if not _KEY_LINE.search(text[at + 1 : after if after >= 0 else stop]):
                    stop = at
                    break
                at = after
        if body := _BODY.search(text, m.end(), stop):
            out.append((m.start(), stop, body.group()))
    return out


def _read_group(text: str, lines: Lines, group: list[Segment], following: Segment | None, told: bool, out: list[Found]) -> None:
    first = group[0]
    value = "".join(text[s.start : s.end] for s in group)

    def add(a: int, v: str, kind: str, strength: int) -> None:
        """``a`` is a place in the joined value; what stands in several of its literals comes out in parts."""
        a, v = a + len(v) - len(v.lstrip()), v.strip()
        if plausible(v):
            out.extend(Found(x, n, v, k, kind, strength) for k, (x, n) in enumerate(_parts(group, a, len(v))))

    if told:
        for pattern, kind, strength in (
            (_KNOWN, "known_format", 3), (_CONNECTION, "connection", 2), (_URL_USER, "url_user", 2), (_URL_QUERY, "url_query", 2),
            (_HEADER, "header", 2), (_JSON, "json", 2), (_COMMAND, "command", 2),
        ):
            for m in pattern.finditer(value):
                g = 1 if pattern.groups else 0
                if (kind != "header" or len(m[g]) >= 8) and (kind != "url_query" or strong(m[g]) or "code=" not in m[0]):
                    add(m.start(g), m[g], kind, strength)
    if first.kind == "comment":
        if told and (m := _SAID.search(value)):
            g = 1 if m[1] else 2
            if len(m[g]) >= 6 and re.search(r"\d", m[g]) and re.search(r"[A-Za-z]", m[g]) and not _CHECKSUM.search(value):
                add(m.start(g), m[g], "said", 2)
        elif "/" in value and (m := _NOTED.search(value)) and strong(m[1]) and "://" not in value and not _CHECKSUM.search(value):
            add(m.start(1), m[1], "said", 1)
        return
    if not _BARE.fullmatch(value):
        return
    head = text[lines.start(first.start) : first.start - 1]
    if not head.strip() and lines.start(first.start):  # the value stands on a continuation line
        before = text[: lines.start(first.start)].rstrip("\r\n \t")
        if before.endswith("_"):
            head = before[:-1].rsplit("\n", 1)[-1].rstrip() + " "
    own = text[group[-1].end : following.start] if following else ""
    note = text[following.start : following.end] if following and following.kind == "comment" and "\n" not in own else ""
    target, strength = "", 0
    end = head.rstrip()[-1:]
    mixed = lambda: bool(re.search(r"\d", value)) or opaque(value) or len(value) >= 10 and entropy(value) > 3
    if end == "=":
        target = (m := _TARGET.search(head)) and m[1].rsplit(".", 1)[-1] or (m := _KEYED.search(head)) and m[1] or ""
    if (_LOGIN.search(head) or _OPEN.search(head) or _OPENED.search(head)) if end == "," else "protect" in head.lower() and _PROTECT.search(head):
        strength = 2
    elif target and _NAME.search(target) and not re.fullmatch(r"(?i)key", target):
        # a plain word only under a name that says password, and not where it is said about one
        word = _SECRET_NAME.search(target) and not _ABOUT.search(target) and not _NAME.search(value) and value.lower() not in target.lower()
        strength = 2 if mixed() or word else 0
    elif note and _NAME.search(note.strip()):
        strength = 2 if len(value) >= 8 and mixed() else 0
    elif opaque(value) and not _PICTURE_NAME.search(target) and (len(group) > 1 or not _KNOWN.search(value)):
        strength = 1
    if not strength or not plausible(value) or _PICTURE.match(value) or _UUID.match(value):
        return
    if _CHECKSUM.search(note) or _CHECKSUM.search(head) or head.lstrip().startswith("Attribute "):
        return
    if any(f.start >= first.start and f.start < group[-1].end for f in out):
        return
    add(0, value, "literal", strength)


def _owned(table: list[tuple[str, str]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for value, kind in table:
        automaton.add_word(value, (value, kind, bool(_DULL.fullmatch(value))))
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str, int, str]]:
    """``start, length, value, part, kind`` of the values wherever they stand in a text."""
    found = []
    begins = None
    for last, (v, kind, dull) in automaton.iter(text):
        a, b = last - len(v) + 1, last + 1
        if kind == "private_key":
            if begins is None:
                keys = _private_keys(text)
                begins = [k[0] for k in keys]
            k = bisect_right(begins, a) - 1
            own = k >= 0 and a < keys[k][1]
            found.append((keys[k][0], keys[k][1] - keys[k][0], keys[k][2], 0, kind) if own else (a, b - a, v, 0, kind))
        elif dull and not (text[a - 1 : a] == '"' == text[b : b + 1]) or a and _joins(text[a - 1], v[0]) or b < len(text) and _joins(text[b], v[-1]):
            continue
        else:
            found.append((a, b - a, v, 0, kind))
    if _JOIN.search(text):
        for group, _ in groups(text, segments(text)):
            if len(group) < 2:
                continue
            value = "".join(text[s.start : s.end] for s in group)
            for last, (v, kind, dull) in automaton.iter(value):
                a, b = last - len(v) + 1, last + 1
                whole = not a and b == len(value)
                if kind == "private_key" or dull and not whole or a and _joins(value[a - 1], v[0]) or b < len(value) and _joins(value[b], v[-1]):
                    continue
                parts = _parts(group, a, b - a)
                if len(parts) > 1:
                    found += [(x, n, v, k, kind) for k, (x, n) in enumerate(parts)]
    return found


def _joins(x: str, y: str) -> bool:
    return (x.isalnum() or x == "_") and (y.isalnum() or y == "_")


def _blocks(values: DataFrame, block_chars: int):
    """Lists of (value, kind) of at most ``block_chars`` characters, fetched one by one."""
    block, size = [], 0
    for row in values.toLocalIterator():
        if block and size + len(row.value) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.value, row.kind))
        size += len(row.value)
    if block:
        yield block


_FOUND_SCHEMA = pa.schema([
    ("module_id", pa.int64()), ("owner", pa.string()), ("line_no", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string()),
    ("value", pa.string()), ("part", pa.int32()), ("strength", pa.int32()),
])


def _rows(read):
    """``read(text)`` -> (start, length, value, part, kind, strength) over batches of ``module_id, owner, text``."""
    def run(batches):
        for batch in batches:
            rows = []
            for i, owner, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = read(text)
                if found:
                    lines = Lines(text)
                    rows += [(i, owner, lines.of(a), a, n, kind, v, part, strength) for a, n, v, part, kind, strength in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND_SCHEMA)], schema=_FOUND_SCHEMA)

    return run


def find_credentials(modules: DataFrame, shared: int = SHARED, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per occurrence: ``module_id, line_no, start, length, kind, part, value_digest``.

    ``modules`` has ``module_id, vba_source_text`` and, to tell owners by, ``path``. The value itself is not returned.
    """
    owner = F.col("path").cast("string") if "path" in modules.columns else F.lit(None).cast("string")
    texts = spread(
        modules.select(
            F.col("module_id").cast("bigint").alias("module_id"), F.coalesce(owner, F.concat(F.lit("module "), "module_id")).alias("owner"),
            F.col("vba_source_text").alias("text"),
        ).filter("text is not null and text <> ''")
    )
    first = cut(texts.mapInArrow(_rows(candidates), FOUND))
    values = first.groupBy("value").agg(F.max("kind").alias("kind"))
    context = modules.sparkSession.sparkContext
    scans = [first]
    for block in _blocks(values, block_chars):
        held = context.broadcast(block)
        made: list[ahocorasick.Automaton] = []

        def rescan(text, held=held, made=made):
            if not made:
                made.append(_owned(held.value))
            return [(*x, 0) for x in occurrences(made[0], text)]

        scans.append(cut(texts.mapInArrow(_rows(rescan), FOUND)))
        held.unpersist()
    found = reduce(DataFrame.unionByName, scans)
    owners = found.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.max("strength").alias("strength"), F.max("kind").alias("kind"))
    wide = cut(owners.filter(F.col("owners") >= shared))
    shared_values = _suppressed(modules, found.join(wide.select("value", "owners", F.col("strength").alias("most")), "value"), shared) if wide.limit(1).count() else wide
    return (
        found.join(shared_values.select("value"), "value", "left_anti")
        .groupBy("module_id", "line_no", "start", "length", "part", "value").agg(F.max("kind").alias("kind"))
        .select("module_id", "line_no", "start", "length", "kind", "part", F.xxhash64("value").alias("value_digest"))
    )


def _suppressed(modules: DataFrame, places: DataFrame, shared: int) -> DataFrame:
    """``value`` of those that too many owners hold when edited copies of a module count once."""
    ids = places.select("module_id").distinct()
    texts = modules.select(F.col("module_id").cast("bigint").alias("id"), F.col("vba_source_text").alias("text")).join(ids.withColumnRenamed("module_id", "id"), "id", "left_semi")
    kin = near_duplicate_groups(texts, 0.6, 3).select(F.col("id").alias("module_id"), "group_id").distinct()
    return (
        places.select("value", "module_id", "owners", "most").distinct().join(kin, "module_id", "left")
        .groupBy("value").agg(F.countDistinct(F.coalesce("group_id", "module_id")).alias("kinds"), F.max("owners").alias("owners"), F.max("most").alias("most"))
        .filter(F.least("kinds", "owners") >= shared * F.col("most"))
    )


def mask(text: str, places: list[tuple[int, int]]) -> str:
    """The text with the places blanked by asterisks; line ends, quotes and joins between literals stay."""
    chars = list(text)
    for a, n in places:
        for k in range(a, min(a + n, len(chars))):
            if chars[k].isalnum() or chars[k] in "+/=_-!#$%*?.~@^":
                chars[k] = "*"
    return "".join(chars)


def mask_credentials(modules: DataFrame, found: DataFrame) -> DataFrame:
    """``module_id, masked_text, n_masked`` of the modules that hold a credential."""
    places = found.groupBy("module_id").agg(F.collect_set(F.struct("start", "length", "kind")).alias("places"))
    schema = pa.schema([("module_id", pa.int64()), ("masked_text", pa.string()), ("n_masked", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                spans = []
                for p in own:
                    a, b = p["start"], p["start"] + p["length"]
                    if p["kind"] == "private_key" and _BEGIN.match(text, a):
                        spans += [(m.start(), m.end() - m.start()) for m in re.finditer(r"[A-Za-z0-9+/]{12,}={0,2}|(?<=[\"' ])[A-Za-z0-9+/]+={1,2}(?=\W)", text[:b]) if m.start() > a + 20]
                    else:
                        spans.append((a, b - a))
                rows.append((i, mask(text, spans), len(own)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    texts = modules.select(F.col("module_id").cast("bigint").alias("module_id"), F.col("vba_source_text").alias("text")).filter("text is not null").distinct()
    return texts.join(places, "module_id").select("module_id", "text", "places").mapInArrow(run, "module_id bigint, masked_text string, n_masked int")
