"""Token streams of binary formulas to text.

A postfix machine driven by a table: every token is (bytes of operand, action on the stack).
Nothing raises on damaged input: the text so far and the problem come back.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import NamedTuple

from ..functions.cells import ERROR_TEXT, MAX_COLS, MAX_ROWS, UNKNOWN_ERROR
from ..functions.worksheet_functions import load

#: Operand bytes of an array constant's token (its contents stand behind the formula).
ARRAY_OPERAND = 7
# Operators by token.
INFIX = dict(zip(range(0x03, 0x10), ("+", "-", "*", "/", "^", "&", "<", "<=", "=", ">=", ">", "<>", " ")))
# Flags of the attribute token.
ATTR_CHOOSE, ATTR_SUM, ATTR_SPACE = 0x04, 0x10, 0x40


class Names(NamedTuple):
    """What tokens refer to by number: sheets (0-based), defined names (1-based), functions."""

    sheets: tuple[str, ...] = ()
    defined: tuple[str, ...] = ()
    functions: dict[int, tuple[str, int | None]] = load()


class _Stop(Exception):
    pass


def number_text(d: float) -> str:
    """A number as a formula shows it: whole numbers without a point, others in shortest form."""
    if d != d or d in (float("inf"), float("-inf")):
        return "#NUM!"
    return str(int(d)) if d == int(d) and abs(d) < 1e15 else repr(d)


def letters(col: int) -> str:
    out, c = "", col + 1
    while c > 0:
        c, k = divmod(c - 1, 26)
        out = chr(65 + k) + out
    return out


def quoted_sheet(name: str) -> str:
    """A sheet name as a prefix needs it: quoted where it isn't a plain word, inner quotes doubled."""
    plain = name and (name[0].isalpha() or name[0] == "_") and all(c.isalnum() or c in "_." for c in name)
    return name if plain else "'" + name.replace("'", "''") + "'"


class Machine:
    def __init__(self, code: bytes, extra: bytes, row: int, col: int, names: Names):
        self.code, self.at, self.extra, self.row, self.col, self.names = code, 0, extra, row, col, names
        self.stack: list[str] = []

    def take(self, form: str) -> tuple:
        size = struct.calcsize("<" + form)
        if self.at + size > len(self.code):
            raise _Stop("token stream ends early")
        out = struct.unpack_from("<" + form, self.code, self.at)
        self.at += size
        return out

    def pop(self) -> str:
        return self.stack.pop() if self.stack else "?"

    def args(self, n: int) -> list[str]:
        got = self.stack[-n:] if n else []
        del self.stack[len(self.stack) - len(got) :]
        return ["?"] * (n - len(got)) + got

    def place(self, row: int, col: int, offsets: bool) -> str:
        """A cell from its row and its column word: 14 bits of column, then flags for relative column and row."""
        c, relative_col, relative_row = col & 0x3FFF, bool(col & 0x4000), bool(col & 0x8000)
        if offsets:
            if relative_row:
                row = (self.row + row) % MAX_ROWS
            if relative_col:
                c = (self.col + c) % MAX_COLS
        return f"{'' if relative_col else '$'}{letters(c)}{'' if relative_row else '$'}{row % MAX_ROWS + 1}"

    def sheet(self, index: int) -> str:
        known = index < len(self.names.sheets) and self.names.sheets[index]
        return (quoted_sheet(known) if known else f"[sheet{index}]") + "!"

    def reference(self, offsets: bool = False, prefix: str = "") -> None:
        row, col = self.take("IH")
        self.stack.append(prefix + self.place(row, col, offsets))

    def area(self, offsets: bool = False, prefix: str = "") -> None:
        r1, r2, c1, c2 = self.take("IIHH")
        self.stack.append(f"{prefix}{self.place(r1, c1, offsets)}:{self.place(r2, c2, offsets)}")

    def function(self, number: int, args: list[str], prefix: str = "") -> None:
        name = self.names.functions.get(number, (f"_func{number:#06x}",))[0]
        self.stack.append(f"{prefix}{name}({','.join(args)})")

    # one method per token from here on

    def infix(self, sign: str) -> None:
        right, left = self.pop(), self.pop()
        self.stack.append(f"{left}{sign}{right}")

    def text(self) -> None:
        (n,) = self.take("H")
        raw = self.code[self.at : self.at + 2 * n]
        if len(raw) < 2 * n:
            raise _Stop("text ends early")
        self.at += 2 * n
        self.stack.append('"' + raw.decode("utf-16-le", "replace").replace('"', '""') + '"')

    def structured(self) -> None:
        (kind,) = self.take("B")
        if kind == 0x1D:
            self.stack.append(f"PivotName{self.take('I')[0]}")
        elif kind != 0x19:
            self.stack.append(f"?ptglist{kind:#04x}")
        else:
            _, which, state, table, first, last = self.take("HBBIHH")
            span = ("", f"[col{first + 1}]")[which & 3] if which & 3 < 2 else f"[col{first + 1}:col{last + 1}]"
            self.stack.append("#REF!" if state & 0x10 else f"Table{table}" + ("[?]" if state & 0x20 else span))

    def attribute(self) -> None:
        (flags,) = self.take("B")
        (word,) = self.take("H")
        if flags & ATTR_SUM:
            self.stack.append(f"SUM({self.pop()})")
        elif flags & ATTR_CHOOSE:
            self.take(f"{2 * (word + 1)}x")

    def array_of(self) -> None:
        (row,) = self.take("I")
        col = struct.unpack_from("<I", self.extra)[0] if len(self.extra) >= 4 else 0
        self.stack.append(f"{{array@{letters(col & 0x3FFF)}{row + 1}}}")

    def data_table(self) -> None:
        row, col = self.take("IH")
        self.stack.append(f"TABLE({letters(col & 0x3FFF)}{row + 1})")

    def fixed(self) -> None:
        (number,) = self.take("H")
        count = self.names.functions.get(number, ("", None))[1]
        self.function(number, self.args(1 if count is None else count))

    def variable(self) -> None:
        count, number = self.take("BH")
        args = self.args(count & 0x7F)
        if number != 0xFF or not args:
            return self.function(number, args, "_xlfn." if count & 0x80 else "")
        name = args[0].strip().replace("_xlfn.", "")
        self.stack.append(f"{'@' if name and not name.startswith('_') else ''}{name}({','.join(args[1:])})")

    def name(self, skip: str = "") -> None:
        number = self.take(skip + "I")[-1]
        known = 0 < number <= len(self.names.defined) and self.names.defined[number - 1]
        self.stack.append(known or f"name{number}")

    def skip(self, n: int, shown: str | None = None) -> None:
        self.take(f"{n}x")
        if shown is not None:
            self.stack.append(shown)

    def run(self) -> tuple[str, str | None]:
        try:
            while self.at < len(self.code):
                (token,) = self.take("B")
                action = SIMPLE.get(token) if token < 0x20 else CLASSED.get(token & 0x1F)
                if action:
                    action(self)
                elif token < 0x20:
                    self.stack.append(f"?ptg{token:#04x}")
                else:
                    self.stack.append(f"?ptg{token:#04x}")
                    break
        except (_Stop, struct.error) as e:
            return (self.stack[-1] if self.stack else ""), str(e)
        return (self.stack[-1] if self.stack else ""), None


def _push(form: str, show: Callable) -> Callable[[Machine], None]:
    return lambda m: m.stack.append(show(*m.take(form)))


def _wrap(left: str, right: str) -> Callable[[Machine], None]:
    return lambda m: m.stack.append(left + m.pop() + right)


SIMPLE: dict[int, Callable[[Machine], None]] = {
    **{t: (lambda sign: lambda m: m.infix(sign))(s) for t, s in INFIX.items()},
    0x01: Machine.array_of, 0x02: Machine.data_table,
    0x10: lambda m: (m.infix(","), m.stack.append(f"({m.stack.pop()})")), 0x11: lambda m: m.infix(":"),
    0x12: _wrap("+", ""), 0x13: _wrap("-", ""), 0x14: _wrap("", "%"), 0x15: _wrap("(", ")"),
    0x16: lambda m: m.stack.append(""), 0x17: Machine.text, 0x18: Machine.structured, 0x19: Machine.attribute,
    0x1C: _push("B", lambda b: ERROR_TEXT.get(b, UNKNOWN_ERROR)), 0x1D: _push("B", lambda b: "TRUE" if b else "FALSE"),
    0x1E: _push("H", str), 0x1F: _push("d", number_text),
}
CLASSED: dict[int, Callable[[Machine], None]] = {
    0x00: lambda m: m.skip(ARRAY_OPERAND, "{array}"), 0x01: Machine.fixed, 0x02: Machine.variable, 0x03: Machine.name,
    0x04: Machine.reference, 0x05: Machine.area, **dict.fromkeys(range(0x06, 0x0A), lambda m: m.skip(6)),
    0x0A: lambda m: m.skip(6, "#REF!"), 0x0B: lambda m: m.skip(12, "#REF!:#REF!"),
    0x0C: lambda m: m.reference(True), 0x0D: lambda m: m.area(True), 0x19: lambda m: m.name("H"),
    0x1A: lambda m: m.reference(prefix=m.sheet(m.take("H")[0])), 0x1B: lambda m: m.area(prefix=m.sheet(m.take("H")[0])),
    0x1C: lambda m: m.skip(8, "#REF!"), 0x1D: lambda m: m.skip(14, "#REF!"),
}


def decompile(code: bytes, extra: bytes, row: int, col: int, names: Names) -> tuple[str, str | None]:
    """(text with '=', problem or None) of a token stream that stands at (row, col)."""
    text, problem = Machine(code, extra, row, col, names).run()
    return "=" + text, problem
