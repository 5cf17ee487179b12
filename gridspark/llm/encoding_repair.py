"""Text that was decoded with a wrong character encoding: find it and restore it.

(1) Words that hold non-ASCII characters (or a question mark between letters) are joined with
their twins: words that are equal once everything outside ASCII is stripped. Every twin without
lost characters may be the clean one. (2) Character alignment of a word with each such twin infers
the transformation: which encoding was read as which, or which characters were lost. Where one
byte was read as another, both directions may align: hard signs of damage decide (among them a
Cyrillic letter or two within a Latin word), then a number of module families (copies count once)
that is ``USUAL`` times the other's, then what the other pairs say of the transformation, and the
plain number of families only if all are silent. Garbled words vote for their transformation. (3) The transformations
learned that way are applied to the remaining records, those without a twin (scripts that
leave nothing when stripped, rare words): the inverse is accepted if the restored characters
are much more usual between their neighbours, by counts over the whole corpus. A transformation
without votes stays possible but must win by a wider margin.

Code that names garbled sequences in order to repair them is exempt: a literal of non-ASCII
characters only in a call that searches, replaces or repairs, and a literal beside another one on
its line of which one is the other misread.

Units of text are judged once however often they occur, and joined with their places at the end.

Sizes: votes are bounded by the pairs of encodings, character counts by the characters of
Unicode times a dozen classes of neighbours; both come to the driver and are broadcast. Words,
twins and records stay distributed; what is held at once are the distinct words of one skeleton,
each looked up in the others' misreadings, so time is linear in them.

Defined results: null and empty fields give no rows; repeated rows count once; a field with a
replacement character (U+FFFD) outside repair code is a case even if nothing can be restored;
a word that aligns with several twins is restored to one that is not garbled itself, then to that
with fewest signs of damage, then to that of more families, then to the smaller word;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .vba_text import segments

#: Encodings that text is written in, and encodings it is read in by mistake.
WRITTEN = ("utf-8", "cp1252", "cp1250", "cp1251", "cp932", "gbk", "euc_jp", "mac_roman", "cp437", "cp850", "cp852", "koi8-r", "cp866", "iso8859-2", "iso8859-5", "big5", "euc_kr")
READ = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8-r", "cp866", "gbk", "cp932")
MULTIBYTE = frozenset(("utf-8", "cp932", "gbk", "euc_jp", "big5", "euc_kr"))
PAIRS = tuple((w, r) for w in WRITTEN for r in READ if w != r and not (r in ("gbk", "cp932") and w != "utf-8"))
LOST = "lost"
#: Of two opposite transformations one is believed if its pairs, less one, outnumber those of the other so many times.
SURELY = 4
#: Of two forms without a sign of loss the one that so many times as many families hold is the clean one.
USUAL = 8
UNITS = "module_id bigint, field string, unit string, family string"
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_WORD = re.compile(r"[A-Za-z?\u0080-\U0010ffff]*[^\x00-\x7f][A-Za-z?\u0080-\U0010ffff]*|[A-Za-z]*(?:(?<=[A-Za-z])\?+(?=[A-Za-z])|(?<![^\s\"'(])\?+(?=[a-z]{2}))[A-Za-z?]+")
_CYRILLIC = re.compile(r"[\u0400-\u052f]")
_CYRILLIC_RUN = re.compile(r"[\u0400-\u052f]+")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
_LETTERS = re.compile(r"[A-Za-z]+")
_GAP = re.compile(r"[^A-Za-z]+")
_LOST_SIGN = re.compile("[?\ufffd]")
_HURT = re.compile("[?\ufffd\x80-\x9f\u2500-\u259f]")
_REPAIR = re.compile(r"(?i)\b(?:replace|instr(?:rev)?|split|strcomp|substitute|\w*(?:fix|repair|clean|decode|mojibake|unmangle|correct)\w*)\s*\(")


@lru_cache(None)
def _reader(name: str) -> tuple[list[str], dict[str, int]]:
    """byte -> character and back, for a one-byte encoding; undefined bytes are C1 controls."""
    table = []
    for b in range(256):
        try:
            table.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            table.append(chr(b))
    back = {c: b for b, c in enumerate(table)}
    if name in ("cp1252", "cp1250", "cp1251"):  # text of ISO 8859 is read the same but for the controls
        for b in range(0x80, 0xA0):
            back.setdefault(chr(b), b)
    return table, back


def misread(text: str, pair: tuple[str, str]) -> str | None:
    """What ``text`` written in pair[0] looks like when read in pair[1]."""
    try:
        raw = text.encode(pair[0])
    except UnicodeEncodeError:
        return None
    if pair[1] in MULTIBYTE:
        return raw.decode(pair[1], "replace")
    table = _reader(pair[1])[0]
    return "".join(table[b] for b in raw)


def raw_of(text: str, reading: str) -> bytes | None:
    """The bytes that look like ``text`` when read in an encoding; None if none do."""
    if reading in MULTIBYTE:
        try:
            return text.encode(reading)
        except UnicodeEncodeError:
            return None
    back = _reader(reading)[1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def reread(text: str, pair: tuple[str, str], errors: str = "strict") -> str | None:
    """The inverse of ``misread``; None if the text can't come from it."""
    raw = raw_of(text, pair[1])
    return None if raw is None else _decoded(raw, pair[0], errors)


def _decoded(raw: bytes, writing: str, errors: str = "strict") -> str | None:
    try:
        return raw.decode(writing, errors)
    except UnicodeDecodeError:
        return None


def family_of(name: str | None) -> str:
    """The name without what tells copies of a module apart."""
    return re.sub(r"(?:_old|_new|Copy|_?\d+)+$", "", name or "")


def skeleton(word: str) -> str:
    return "".join(_LETTERS.findall(word))


def damage(word: str) -> int:
    """Signs that a word is not as written: lost characters, controls, drawing and maths signs."""
    return sum(c in "?�" or "\x80" <= c <= "\x9f" or "─" <= c <= "▟" or c in "¡¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿†‡ˆ‰‹›Œœƒ˜™€„…•" for c in word)


def align(word: str, clean: str) -> str | None:
    """The transformation that turns the clean word into ``word``, by their characters; None if none does."""
    ours, theirs = _NON_ASCII.findall(clean), re.findall(r"[^\x00-\x7f]|\?", word)
    if not ours or word == clean:
        return None
    if all(c in "?�" for c in theirs) and theirs:
        parts = [re.escape(c) if c < "\x80" else r"[?�]{1,%d}" % len(c.encode()) for c in clean]
        return LOST if re.fullmatch("".join(parts), word) else None
    for pair in PAIRS:
        once = misread(clean, pair)
        if once is None:
            continue
        if once == word or misread(once, pair) == word or pair[1] == "cp1252" and misread(clean, (pair[0], "latin-1")) == word:
            return f"{pair[0]}>{pair[1]}"
    seen = [c for c in theirs if c not in "?�"]
    if len(seen) < len(theirs):  # partly lost: what is left must come from one transformation
        for pair in PAIRS:
            once = misread(clean, pair) or ""
            if re.fullmatch(".{0,3}?".join(re.escape(c) for c in re.sub("[?�]", "", word)), re.sub("[\x80-\x9f]", "", once)):
                return f"{pair[0]}>{pair[1]}"
    return None


def misreadings(clean: str) -> dict[str, str]:
    """Every form that ``align`` takes for the clean word misread whole, with the transformation."""
    out: dict[str, str] = {}
    for pair in PAIRS:
        once = misread(clean, pair)
        if once is None or once == clean:
            continue
        forms = [once, misread(once, pair)]
        if pair[1] == "cp1252":
            forms.append(misread(clean, (pair[0], "latin-1")))
        for form in forms:
            if form is not None and form != clean:
                out.setdefault(form, f"{pair[0]}>{pair[1]}")
    return out


@lru_cache(20_000)
def _forms_of(clean: str) -> frozenset[str]:
    return frozenset(misreadings(clean))


def oddness(word: str) -> tuple[int, int, int]:
    """Signs that stand in no written word (characters lost, drawing signs, signs within letters), those that stand
    in few, and capitals inside a small word: one of these may begin a part of a name, ``modÜbersicht``."""
    hard = weak = capitals = 0
    for m in _CYRILLIC_RUN.finditer(word):  # a letter or two among Latin ones; a longer run is a word with a prefix
        if len(m[0]) < 3 and (_LATIN.match(word[m.start() - 1 : m.start()]) or _LATIN.match(word[m.end() : m.end() + 1])):
            hard += len(m[0])
    for k, c in enumerate(word):
        if c < "\x80" and c != "?":
            continue
        left, right = word[k - 1 : k] if k else "", word[k + 1 : k + 2]
        if _HURT.match(c) or not c.isalpha() and (
            left.isalpha() and right.isalpha() and c not in "‘’–—·\xad…\xa0" or not k and c not in "«‹„‚“‘’¿¡§…–—" and re.match("[a-z]{3}", word[1:])
        ):
            hard += 1
        elif c not in "Œœ" and damage(c):
            weak += 1
        elif left.islower() and c.isupper():
            capitals += 1
    return hard, weak + (capitals if capitals > 1 else 0), capitals


@lru_cache(None)
def _class(c: str) -> str:
    if c < "\x80":
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "."
    if c < "ɐ":
        return "l" if c.isalpha() else "s"
    if "Ѐ" <= c < "԰":
        return "c"
    if "぀" <= c < "㄀":
        return "k"
    if "一" <= c < "ꀀ":
        return "h"
    if "　" <= c < "぀" or "＀" <= c < "ｦ":
        return "w"
    return "x" if c.isalpha() else "s"


def features(text: str) -> list[str]:
    """A non-ASCII character with the class of its left, and of its right neighbour."""
    out = []
    for m in _NON_ASCII.finditer(text):
        k = m.start()
        c = text[k]
        out.append("<" + (_class(text[k - 1]) if k else " ") + c)
        out.append(">" + (_class(text[k + 1]) if k + 1 < len(text) else " ") + c)
    return out


class Judge:
    """Decides whether a unit is garbled, from counts of characters and votes for transformations."""

    def __init__(self, counts: dict[str, int], votes: dict[str, int], least_votes: int = 2):
        self.counts, self.least_votes, self.learned = counts, least_votes, {t for t, n in votes.items() if n >= least_votes}
        self.logs = {f: math.log(n + 0.3) for f, n in counts.items()}
        self.alone: Counter = Counter()
        for f, n in counts.items():
            if f[0] == "<":
                self.alone[f[-1]] += n

    def with_votes(self, transformations) -> Judge:
        out = Judge(self.counts, {}, self.least_votes)
        out.learned = self.learned | set(transformations)
        return out

    def usual(self, text: str) -> float:
        if len(text) < 4 and not re.search(r"[\x00-\x7f]", text):  # a sign or two by themselves have no neighbours to tell by
            return sum(math.log(self.alone.get(c, 0) + 0.3) for c in text) / len(text) if text else 9.0
        of, unseen = self.logs.get, math.log(0.3)
        total, n, last = 0.0, 0, len(text) - 1
        for m in _NON_ASCII.finditer(text):
            k = m.start()
            c = text[k]
            total += of("<" + (_class(text[k - 1]) if k else " ") + c, unseen) + of(">" + (_class(text[k + 1]) if k < last else " ") + c, unseen)
            n += 2
        return total / n if n else 9.0

    def restore(self, unit: str) -> tuple[str, str] | None:
        """(restored, transformation), or None if the unit looks as written."""
        best = None
        before = self.usual(unit)
        raws = {r: raw_of(unit, r) for r in READ}
        words = _words(unit)
        hurt = sum(damage(w) > 0 for w in words) > 1
        lone = len(words) == 1 and "´" not in unit and oddness(words[0])[0] > 0  # a name, a short literal
        gains: dict[str, float] = {}
        for pair in PAIRS:
            raw = raws[pair[1]]
            after = whole = None if raw is None else _decoded(raw, pair[0])
            if after is None or after == unit:
                after, whole = self._by_runs(unit, pair) if pair[0] == "utf-8" else None, None
            if after is None or after == unit or after.isascii():
                continue
            # one Latin letter for another: only where the words show damage, and more than one does or there is but one
            latin = pair[0] not in MULTIBYTE and not _CYRILLIC.search(after)
            if latin and not hurt and (not lone or oddness(after)[0]):
                continue
            name = f"{pair[0]}>{pair[1]}"
            margin = (0.5 if pair[0] in MULTIBYTE else 1.0) if name in self.learned and (hurt or not latin) else 2.0
            if pair[0] == "utf-8" and whole:  # a whole text that is valid UTF-8 by chance gets rarer with every byte
                margin = max(-4.0, min(margin, 1.0) - 0.5 * (len(_NON_ASCII.findall(unit)) - 2))
            if after not in gains:
                gains[after] = self.usual(after) - before
            if gains[after] >= margin and (best is None or gains[after] > best[0]):
                best = (gains[after], after, name)
        if best is None:
            return self._damaged(raws, before)
        again = self.restore(best[1]) if best[2].startswith("utf-8>") else None
        return again or best[1:]

    def _damaged(self, raws: dict[str, bytes | None], before: float) -> tuple[str, str] | None:
        """Multi-byte text with some bytes gone: most of it must decode to usual characters."""
        best = None
        for pair in PAIRS:
            if pair[0] not in MULTIBYTE or f"{pair[0]}>{pair[1]}" not in self.learned:
                continue
            raw = raws[pair[1]]
            after = None if raw is None else _decoded(raw, pair[0], "replace")
            n = len(_NON_ASCII.findall(after or ""))
            if not n or after.count("�") * 4 > n:
                continue
            gain = self.usual(after.replace("�", "")) - before
            # the fewer characters, the more each must gain
            if gain >= 2.5 and gain * n >= 10 and (best is None or gain > best[0]):
                best = (gain, after, f"{pair[0]}>{pair[1]}")
        return best and best[1:]

    @staticmethod
    def _by_runs(unit: str, pair: tuple[str, str]) -> str:
        return re.sub(r"[^\x00-\x7f]{2,}", lambda m: reread(m[0], pair) or m[0], unit)


def _words(unit: str) -> list[str]:
    return [w for w in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", unit) if _NON_ASCII.search(w)]


def units(text: str) -> list[tuple[int, int]]:
    """Spans of the comments, literals and pieces of code that may hold garbled text."""
    if text.isascii() and "?" not in text:
        return []
    out, at = [], 0
    segs = segments(text)
    for k, s in enumerate(segs):
        out += _code_units(text, at, s.start)
        at = s.end
        own = text[s.start : s.end]
        if (not own.isascii() or "?" in own) and not (s.kind == "literal" and _exempt(text, segs, k)):
            out.append((s.start, s.end))
    return out + _code_units(text, at, len(text))


def _code_units(text: str, a: int, b: int) -> list[tuple[int, int]]:
    if text[a:b].isascii():
        return []
    return [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\n]+", text[a:b]) if not m[0].isascii()]


def _exempt(text: str, segs: list, k: int) -> bool:
    """A literal that names a sequence in order to search or replace it, or stands beside what it is misread as."""
    own = text[segs[k].start : segs[k].end]
    line = text.rfind("\n", 0, segs[k].start) + 1
    if not re.search(r"[\x00-\x7f]", own) and _REPAIR.search(text, line, segs[k].start):
        return True
    for j in (k - 1, k + 1):
        if 0 <= j < len(segs) and segs[j].kind == "literal" and "\n" not in text[min(segs[k].end, segs[j].end) : max(segs[k].start, segs[j].start)]:
            other = text[segs[j].start : segs[j].end]
            if not own.isascii() and not other.isascii() and (own in _forms_of(other) or other in _forms_of(own)):
                return True
    return False


def _fields(modules: DataFrame) -> DataFrame:
    fields = [F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("name", "vba_source_text")]
    return (
        modules.select(F.col("module_id").cast("bigint").alias("module_id"), F.col("name").alias("module"), F.explode(F.array(*fields)).alias("x"))
        .select("module_id", "x.field", "x.text", "module")
        .filter(F.col("text").rlike(r"[^\x00-\x7f]|\?"))
    )


def field_units(modules: DataFrame) -> DataFrame:
    """``module_id, field, unit, family`` of every place that may hold garbled text; copies of one module are a family."""
    schema = pa.schema([("module_id", pa.int64()), ("field", pa.string()), ("unit", pa.string()), ("family", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for i, field, text, name in zip(*(batch.column(k).to_pylist() for k in range(4))):
                family = family_of(name)
                own = {text} if field == "name" else {text[a:b].strip() for a, b in units(text)}
                rows += [(i, field, u, family) for u in own if u and (not u.isascii() or _WORD.search(u))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spread(_fields(modules)).mapInArrow(run, UNITS)


def _exploded(own: DataFrame, column: str, of, key: str) -> DataFrame:
    """The key and ``<column>``: the distinct strings that ``of`` finds in a unit."""
    schema = pa.schema([(key, pa.string()), (column, pa.string())])

    def run(batches):
        for batch in batches:
            rows = {(k, x) for k, unit in zip(*(c.to_pylist() for c in batch.columns)) for x in of(unit)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)

    return own.select(F.col(key), F.col("unit").alias("_unit")).mapInArrow(run, f"{key} string, {column} string")


def words_of(unit: str) -> list[str]:
    return [w for w in _WORD.findall(unit) if len(skeleton(w)) >= 2 or not _LOST_SIGN.search(w)]


def _one_byte(transformation: str) -> bool:
    return transformation != LOST and not MULTIBYTE & set(transformation.split(">"))


def aligned(variants: list[tuple[str, int]]) -> list[tuple]:
    """``word, clean, transformation, back, one_byte, hard, weak, capitals, n, clean_n, odd`` of the pairs of one skeleton that align.

    ``back`` is the transformation of the opposite direction, if that aligns too; ``hard``, ``weak`` and ``capitals``
    are 1 if the word is the one with more signs of damage, -1 if the clean one is.
    """
    counts = dict(variants)
    cleans = [w for w in counts if not _HURT.search(w)]
    odd = {w: oddness(w) for w in counts}
    pairs: dict[tuple[str, str], str] = {}
    by_pattern: dict[str, list[str]] = {}
    for clean in cleans:
        by_pattern.setdefault(_GAP.sub("*", clean), []).append(clean)
        forms = misreadings(clean)
        pairs.update(((w, clean), forms[w]) for w in (forms.keys() & counts.keys()))
    for w in counts:
        if _LOST_SIGN.search(w):
            gone = all(c in "?\ufffd" for c in w if c == "?" or c > "\x7f")
            for clean in by_pattern.get(_GAP.sub("*", w), ()) if gone else cleans:
                if (w, clean) not in pairs and (t := align(w, clean)):
                    pairs[w, clean] = t
    return [
        (w, c, t, pairs.get((c, w)), _one_byte(t), *((x > y) - (x < y) for x, y in zip(odd[w], odd[c])), counts[w], counts[c], sum(odd[c][:2]))
        for (w, c), t in pairs.items()
    ]


def _aligned_pairs(counted: DataFrame) -> DataFrame:
    """``aligned`` over all skeletons."""
    schema = pa.schema([
        ("word", pa.string()), ("clean", pa.string()), ("transformation", pa.string()), ("back", pa.string()), ("one_byte", pa.bool_()),
        ("hard", pa.int32()), ("weak", pa.int32()), ("capitals", pa.int32()), ("n", pa.int64()), ("clean_n", pa.int64()), ("odd", pa.int32()),
    ])

    def run(batches):
        for batch in batches:
            rows = [r for own in batch.column(0).to_pylist() for r in aligned([(x["word"], x["n"]) for x in own])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return (
        counted.groupBy(F.regexp_replace("word", "[^A-Za-z]", "").alias("skeleton")).agg(F.collect_list(F.struct("word", "n")).alias("own"))
        .filter("size(own) > 1 and length(skeleton) > 1").select("own")
        .mapInArrow(run, "word string, clean string, transformation string, back string, one_byte boolean, hard int, weak int, capitals int, n bigint, clean_n bigint, odd int")
    )


def _short_pairs(counted: DataFrame) -> DataFrame:
    """``word, clean, transformation, shown, clean_n, odd`` of the words with under two ASCII letters (``là``, ``été``).

    Their skeletons say too little (all of Chinese has the empty one), so a Latin word meets its misreadings
    themselves. ``shown``: the word alone shows it, by signs that the clean one hasn't and in no Cyrillic reading.
    """
    schema = pa.schema([
        ("word", pa.string()), ("clean", pa.string()), ("transformation", pa.string()), ("shown", pa.bool_()), ("clean_n", pa.int64()), ("odd", pa.int32()),
    ])

    def run(batches):
        for batch in batches:
            rows = []
            for clean, n in zip(*(c.to_pylist() for c in batch.columns)):
                before = sum(oddness(clean)[:2])
                for form, t in misreadings(clean).items():
                    written, reading = t.split(">")
                    worse = sum(oddness(form)[:2]) > before
                    # a lone sign is no word, and one byte for another must leave a sign
                    if reading not in MULTIBYTE and (written in MULTIBYTE or worse and skeleton(clean)):
                        rows.append((form, clean, t, worse and written in MULTIBYTE and not _CYRILLIC.search(form), n, before))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    short = counted.filter(F.length(F.regexp_replace("word", "[^A-Za-z]", "")) < 2)
    forms = short.filter(F.col("word").rlike(r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$")).select("word", "n").mapInArrow(
        run, "word string, clean string, transformation string, shown boolean, clean_n bigint, odd int"
    )
    return forms.join(short.select("word"), "word")


def twin_words(known: DataFrame) -> DataFrame:
    """``word, clean, transformation``: the garbled words of the units, each with the best of the clean twins it aligns with.

    ``known`` (family, unit) has every unit once for a family of copies.
    """
    words = _exploded(known, "word", words_of, "family").distinct()
    counted = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    pairs = cut(_aligned_pairs(counted))
    # what damage says of a transformation over all its pairs; at most one row for a pair of encodings
    known = pairs.filter("one_byte and coalesce(nullif(hard, 0), nullif(weak, 0), capitals) > 0").groupBy("transformation").agg(F.count("*").alias("known"))
    garbled = (
        pairs.join(F.broadcast(known), "transformation", "left")
        .join(F.broadcast(known.select(F.col("transformation").alias("back"), F.col("known").alias("back_known"))), "back", "left")
        .fillna(0, ["known", "back_known"])
        .withColumn("learned", F.expr(f"case when known > {SURELY} * back_known + 1 then 1 when back_known > {SURELY} * known + 1 then -1 else 0 end"))
        .withColumn("side", F.expr(f"case when hard <> 0 then hard when n >= {USUAL} * clean_n then -1 when clean_n >= {USUAL} * n then 1 when learned <> 0 then learned when weak <> 0 then weak else sign(clean_n - n) end"))
        .filter("not one_byte or side > 0")
        .select("word", "clean", "transformation", "clean_n", "odd")
    )
    votes = garbled.groupBy("transformation").agg(F.countDistinct("word").alias("votes")).filter("votes > 1")
    short = _short_pairs(counted).join(F.broadcast(votes), "transformation", "left").filter("shown or votes is not null")
    garbled = garbled.unionByName(short.select(*garbled.columns))
    again = garbled.select(F.col("word").alias("clean"), F.lit(1).alias("again")).distinct()
    return (
        garbled.join(again, "clean", "left").fillna(0, ["again"])
        .groupBy("word")
        .agg(F.min_by(F.struct("clean", "transformation"), F.struct("again", "odd", -F.col("clean_n"), "clean")).alias("best"))
        .select("word", "best.clean", "best.transformation")
    )


def judge_of(weighed: DataFrame, twins: DataFrame) -> Judge:
    """Character counts over the units (unit, families), once for a family of copies, and the votes of the twins."""
    def count(batches):
        for batch in batches:
            c: Counter = Counter()
            for unit, n in zip(*(batch.column(k).to_pylist() for k in range(2))):
                for f in set(features(unit)):
                    c[f] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["feature", "n"])

    counts = weighed.select("unit", "families").mapInArrow(count, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    votes = twins.filter(F.col("transformation") != LOST).groupBy("transformation").agg(F.count("*").alias("n"))
    return Judge({r.feature: r.n for r in counts.toLocalIterator()}, {r.transformation: r.n for r in votes.collect()})


def garbled_units(modules: DataFrame) -> DataFrame:
    """``module_id, field, unit, restored, transformation, evidence`` of every garbled place.

    ``evidence`` is 'twin', 'learned' or 'lost'; ``restored`` is null where nothing can be restored.
    """
    own = cut(field_units(modules))
    known = own.select("family", "unit").distinct()
    weighed = cut(known.groupBy("unit").agg(F.count("*").alias("families")))
    twins = cut(twin_words(known))
    context = own.sparkSession.sparkContext
    first = judge_of(weighed, twins)
    schema = pa.schema([("unit", pa.string()), ("families", pa.int64()), ("restored", pa.string()), ("transformation", pa.string()), ("evidence", pa.string())])

    def run(judge):
        def judged(batches):
            for batch in batches:
                rows = []
                for u, n in zip(*(batch.column(k).to_pylist() for k in range(2))):
                    if u.isascii():
                        continue
                    if got := judge.value.restore(u):
                        rows.append((u, n, got[0], got[1], "learned"))
                    elif "�" in u:
                        rows.append((u, n, None, LOST, "lost"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), schema)], schema=schema)

        return judged

    shape = "unit string, families bigint, restored string, transformation string, evidence string"
    # one pass over everything with all margins low leaves the few units that any judge could take
    easy = context.broadcast(first.with_votes(f"{a}>{b}" for a, b in PAIRS))
    suspects = cut(spread(weighed).mapInArrow(run(easy), shape).select("unit", "families"))
    # scripts that leave no skeleton have no twins: what wins by the wide margin there votes for the rest
    # these are judged by what is usual in the other units, however many of them there are
    others = judge_of(weighed.join(suspects.select("unit"), "unit", "left_anti"), twins)
    sure = suspects.mapInArrow(run(context.broadcast(others)), shape).filter("evidence = 'learned'").select("unit", "transformation")
    seconds = sure.groupBy("transformation").agg(F.count("*").alias("n")).filter(F.col("n") >= first.least_votes).collect()
    judge = context.broadcast(others.with_votes(r.transformation for r in seconds))
    learned = suspects.mapInArrow(run(judge), shape).select("unit", F.col("unit").alias("place"), "restored", "transformation", "evidence")
    by_twin = _exploded(weighed, "word", words_of, "unit").join(twins, "word").select(
        "unit", F.col("word").alias("place"), F.col("clean").alias("restored"), "transformation", F.lit("twin").alias("evidence")
    )
    return (
        own.select("module_id", "field", "unit").join(by_twin.unionByName(learned), "unit")
        .select("module_id", "field", F.col("place").alias("unit"), "restored", "transformation", "evidence").distinct()
    )


def restore_fields(modules: DataFrame, garbled: DataFrame) -> DataFrame:
    """``module_id, field, restored_text, n_places, complete`` of every field with a case."""
    fixes = garbled.groupBy("module_id", "field").agg(F.collect_set(F.struct("unit", "restored", "evidence")).alias("fixes"))
    schema = pa.schema([("module_id", pa.int64()), ("field", pa.string()), ("restored_text", pa.string()), ("n_places", pa.int32()), ("complete", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for i, f, text, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rank = {"learned": 0, "twin": 1, "lost": 2}
                for fix in sorted(own, key=lambda x: (rank[x["evidence"]], -len(x["unit"]), x["unit"])):
                    if fix["restored"] is not None:
                        text = text.replace(fix["unit"], fix["restored"])
                rows.append((i, f, text, len(own), "�" not in text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), schema)], schema=schema)

    return (
        _fields(modules).drop("module").distinct().join(fixes, ["module_id", "field"]).select("module_id", "field", "text", "fixes")
        .mapInArrow(run, "module_id bigint, field string, restored_text string, n_places int, complete boolean")
    )
