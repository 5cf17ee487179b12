"""Column expressions for addresses, numbers, errors and paths of spreadsheet packages.

Everything here is a plain Catalyst expression: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROWS, MAX_COLS = 1 << 20, 1 << 14

# The codes of cell errors.
ERROR_TEXT = {
    0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#GETTING_DATA",
}
UNKNOWN_ERROR = "#ERR"

# The codes of comparison operators, and their names in Open XML.
FILTER_OPERATORS = {1: "<", 2: "=", 3: "<=", 4: ">", 5: "<>", 6: ">="}
FILTER_OPERATOR_NAMES = {
    "lessThan": "<", "equal": "=", "lessThanOrEqual": "<=", "greaterThan": ">", "notEqual": "<>", "greaterThanOrEqual": ">=",
}

#: A reference inside a formula. No part of a name, a call or a longer word.
REFERENCE = r"(?<![A-Za-z0-9_.$])(\$?)([A-Z]{1,3})(\$?)([0-9]{1,7})(?![A-Za-z0-9_(.])"
#: A reference, or text that must not be read as one: a literal, or a quoted sheet name.
PIECE = r'"(?:[^"]|"")*"|' + r"'(?:[^']|'')*'|" + REFERENCE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def column_letters(index: Column | str) -> Column:
    """0-based column index to letters, for 0..16383; null outside."""
    c = _col(index).cast("int")
    letter = lambda x: F.chr((F.lit(65) + x).cast("int"))
    text = F.concat(
        F.when(c >= 702, letter(F.floor((c - 702) / 676))).otherwise(""),
        F.when(c >= 26, letter(F.pmod(F.floor((c - 26) / 26), F.lit(26)))).otherwise(""),
        letter(F.pmod(c, F.lit(26))),
    )
    return F.when((c >= 0) & (c < MAX_COLS), text)


def column_index(letters: Column | str) -> Column:
    """Letters (either case) to the 0-based column index; null if they are none."""
    s = F.upper(_col(letters))
    value = F.aggregate(F.split(s, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))
    return F.when(s.rlike("^[A-Z]{1,3}$"), value - 1)


def address(row: Column | str, col: Column | str) -> Column:
    """A1 text of 0-based coordinates."""
    return F.concat(column_letters(col), (_col(row).cast("bigint") + 1).cast("string"))


def row_of(ref: Column | str) -> Column:
    """0-based row of an A1 reference, null if malformed."""
    return (F.regexp_extract(_col(ref), r"^\$?[A-Za-z]{1,3}\$?([0-9]+)$", 1)).try_cast("int") - 1


def col_of(ref: Column | str) -> Column:
    """0-based column of an A1 reference, null if malformed."""
    return column_index(F.regexp_extract(_col(ref), r"^\$?([A-Za-z]{1,3})\$?[0-9]+$", 1))


def error_text(code: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ERROR_TEXT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _col(code).cast("int")), F.lit(UNKNOWN_ERROR))


def rk_number(raw: Column | str) -> Column:
    """A packed number: bit 0 divides by 100, bit 1 marks a signed 30-bit integer, else the high 30 bits of a double."""
    r = _col(raw).cast("bigint")
    whole = F.shiftright(r, 2)
    signed = F.when(whole.bitwiseAND(1 << 29) != 0, whole - (1 << 30)).otherwise(whole).cast("double")
    sign = F.when(F.shiftright(r, 31).bitwiseAND(1) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(r, 20).bitwiseAND(2047), whole.bitwiseAND((1 << 18) - 1) / F.lit(float(1 << 18))
    real = sign * F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise(
        F.pow(F.lit(2.0), (exponent - 1023).cast("double")) * (1 + fraction)
    )
    value = F.when(r.bitwiseAND(2) != 0, signed).otherwise(real)
    return F.when(r.bitwiseAND(1) == 1, value / 100).otherwise(value)


def typed_number(text: Column | str) -> tuple[Column, Column, Column]:
    """``kind``, ``v_int``, ``v_num`` of the text of a number: whole and under 1e15 is int, not a number is str."""
    d = F.trim(_col(text)).try_cast("double")
    number = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")) & _col(text).rlike(r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$")
    whole = number & (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, "int").when(number, "float").otherwise("str"), F.when(whole, d.cast("bigint")), F.when(number, d)


def resolve_path(source: Column | str, target: Column | str) -> Column:
    """The part that a relationship of ``source`` names: absolute from the root, else beside the source; ``.`` and ``..`` folded."""
    t = F.regexp_replace(_col(target), r"\\", "/")
    base = F.regexp_replace(_col(source), r"[^/]*$", "")
    full = F.when(t.startswith("/"), t).otherwise(F.concat(base, t))
    fold = F.aggregate(
        F.split(full, "/"), F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x.isin("", "."), a).otherwise(F.array_append(a, x)),
    )
    return F.array_join(fold, "/")


def package_format(path: Column | str) -> Column:
    """'xlsx' for .xlsx and .xlsm in either case, anything else 'xlsb'."""
    return F.when(F.lower(_col(path)).rlike(r"\.xls[xm]$"), "xlsx").otherwise("xlsb")


def wrap_row(base: Column | str, offset: Column | str) -> Column:
    """A row reached by a signed 20-bit offset, modulo the sheet's height."""
    return F.pmod(_col(base).cast("bigint") + _col(offset).cast("bigint"), F.lit(MAX_ROWS))


def wrap_col(base: Column | str, offset: Column | str) -> Column:
    return F.pmod(_col(base).cast("bigint") + _col(offset).cast("bigint"), F.lit(MAX_COLS))


def shift_references(formula: Column | str, rows: Column | str, cols: Column | str) -> Column:
    """The formula with its relative references moved; literals, quoted names and calls stay.

    Moves past an edge wrap around the sheet.
    """
    f, dr, dc = _col(formula), _col(rows), _col(cols)

    def moved(piece: Column) -> Column:
        part = lambda k: F.regexp_extract(piece, r"^(\$?)([A-Z]{1,3})(\$?)([0-9]{1,7})$", k)
        index, row = column_index(part(2)), part(4).try_cast("bigint") - 1
        new = F.concat(
            part(1), F.when(part(1) == "$", part(2)).otherwise(column_letters(wrap_col(index, dc))),
            part(3), F.when(part(3) == "$", part(4)).otherwise((wrap_row(row, dr) + 1).cast("string")),
        )
        inside = (index >= 0) & (index < MAX_COLS) & (row >= 0) & (row < MAX_ROWS)
        return F.coalesce(F.when(inside, new), piece)

    return F.array_join(
        F.zip_with(
            F.split(f, PIECE, -1), F.transform(F.regexp_extract_all(f, F.lit(PIECE), F.lit(0)), moved),
            lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))),
        ), "",
    )


def varint(raw: Column | str, at: Column | int = 1, most: int = 4) -> Column:
    """Little-endian 7-bit groups of a binary column from the 1-based byte ``at``."""
    at = F.lit(at) if isinstance(at, int) else at
    byte = lambda k: F.conv(F.hex(F.substring(_col(raw), at + k, F.lit(1))), 16, 10).cast("bigint")
    value, more = F.lit(0).cast("bigint"), F.lit(True)
    for k in range(most):
        b = F.coalesce(byte(k), F.lit(0))
        value = value + F.when(more, F.shiftleft(b.bitwiseAND(0x7F), 7 * k)).otherwise(0)
        more = more & (b.bitwiseAND(0x80) != 0)
    return value


def serial_to_timestamp(serial: Column | str, date1904: bool = False) -> Column:
    """A day number to a time without zone. Additive: readers never convert by themselves."""
    start = "1904-01-01" if date1904 else "1899-12-30"
    return F.expr(f"timestampadd(MICROSECOND, 0, timestamp_ntz'{start} 00:00:00')") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.round(_col(serial) * 86400, 6).cast("decimal(18,6)")
    )


def timestamp_to_serial(ts: Column | str) -> Column:
    """A time without zone to its day number."""
    us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1899-12-30 00:00:00'"), _col(ts))
    return us / F.lit(86400000000.0)
