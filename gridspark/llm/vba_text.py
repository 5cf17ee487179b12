"""A lexer that finds the comments and string literals of Basic source."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

#: A literal ends at its quote or, unclosed, at the line's end; a comment runs to the line's end.
_SEGMENT = re.compile(r'"(?:[^"\n]|"")*(?:"|(?=\n)|\Z)|\'[^\n]*|(?:(?<=\n)|(?<=:)|\A)[ \t]*[Rr][Ee][Mm](?=[ \t\r\n]|\Z)[^\n]*')
#: The same for texts without a Rem comment, which most are: its branches begin with one of two signs, so the search skips what lies between.
_QUOTED = re.compile(r'"(?:[^"\n]|"")*(?:"|(?=\n)|\Z)|\'[^\n]*')
_REM = re.compile(r"[ \t]*[Rr][Ee][Mm](?=[ \t\r\n]|\Z)")


class Segment(NamedTuple):
    """``start`` and ``end`` delimit the content: without quotes, apostrophe or Rem."""

    kind: str
    start: int
    end: int


def _may_have_rem(text: str) -> bool:
    """Whether a Rem may begin a comment anywhere."""
    low = text.lower()
    at = low.find("rem")
    while at >= 0:
        after = low[at + 3 : at + 4]
        if after in (" ", "\t", "\r", "\n", ""):
            k = at - 1
            while k >= 0 and low[k] in " \t":
                k -= 1
            if k < 0 or low[k] in "\n:":
                return True
        at = low.find("rem", at + 3)
    return False


def segments(text: str) -> list[Segment]:
    """The literals and comments in order of appearance."""
    out = []
    for m in (_SEGMENT if _may_have_rem(text) else _QUOTED).finditer(text):
        a, b = m.span()
        first = text[a]
        if first == '"':
            closed = b - a > 1 and text[b - 1] == '"'
            out.append(Segment("literal", a + 1, b - 1 if closed else b))
        else:
            rem = None if first == "'" else _REM.match(text, a)
            out.append(Segment("comment", rem.end() if rem else a + 1, b - 1 if text[b - 1 : b] == "\r" else b))
    return out


class Lines:
    """Line numbers of character positions, counted from 1, separated by LF."""

    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def of(self, position: int) -> int:
        return bisect_right(self.starts, position)

    def start(self, position: int) -> int:
        return self.starts[bisect_right(self.starts, position) - 1]
