import math
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.functions import cells, worksheet_functions
from gridspark.sources import biff12
from gridspark.sources.formula_tokens import letters


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_every_column(spark):
    rows = spark.range(16384).select("id", cells.column_letters("id").alias("s")).withColumn("back", cells.column_index("s")).collect()
    assert all(r.s == letters(r.id) and r.back == r.id for r in rows)
    assert {0: "A", 25: "Z", 26: "AA", 701: "ZZ", 702: "AAA", 16383: "XFD"}.items() <= {r.id: r.s for r in rows}.items()


def test_addresses(spark):
    assert one(spark, a=cells.address(F.lit(0), F.lit(0)), b=cells.address(F.lit(1048575), F.lit(16383)), c=cells.row_of(F.lit("B12")), d=cells.col_of(F.lit("$AA$3")), e=cells.row_of(F.lit("bad")), f=cells.column_letters(F.lit(-2))) == {
        "a": "A1", "b": "XFD1048576", "c": 11, "d": 26, "e": None, "f": None}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_rk_reference_values(raw):
    value, _ = biff12.rk(raw)
    whole = raw >> 2
    if raw & 2:
        want = float(whole - (1 << 30) if whole >> 29 else whole)
    else:
        (want,) = struct.unpack("<d", struct.pack("<Q", (raw & ~3) << 32))
    want = want / 100 if raw & 1 else want
    assert value == want or math.isnan(value) and math.isnan(want)


def test_rk_expression(spark):
    raws = [0x3FF00000, 402, 495, 0xFFFFFFFE, 0, 2, 3, 0x40590000, 0xBFF80000, 0x00100000]
    rows = spark.createDataFrame([(r,) for r in raws], "raw bigint").select("raw", cells.rk_number("raw").alias("v")).collect()
    assert {r.raw: r.v for r in rows} == {r: biff12.rk(r)[0] for r in raws}


def test_errors_numbers_paths(spark):
    got = one(spark, a=cells.error_text(F.lit(7)), b=cells.error_text(F.lit(0x2A)), c=cells.error_text(F.lit(0x99)),
              d=cells.resolve_path(F.lit("xl/worksheets/sheet1.xml"), F.lit("../pivotTables/p1.xml")), e=cells.resolve_path(F.lit("xl/workbook.xml"), F.lit("/xl/a/../b.xml")),
              f=cells.resolve_path(F.lit("xl/workbook.xml"), F.lit("../../../b.xml")), g=cells.package_format(F.lit("A.XLSM")), h=cells.package_format(F.lit("a.bin")),
              i=cells.wrap_row(F.lit(0), F.lit(-1)), j=cells.varint(F.unhex(F.lit("8001"))))
    assert got == {"a": "#DIV/0!", "b": "#N/A", "c": "#ERR", "d": "xl/pivotTables/p1.xml", "e": "xl/b.xml", "f": "b.xml", "g": "xlsx", "h": "xlsb", "i": 1048575, "j": 128}


def test_typed_numbers(spark):
    texts = ["1", " 2 ", "-0.5", "1e3", "1e15", "inf", "nan", "1e400", "1_000", "", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kind, v_int, v_num = cells.typed_number("t")
    assert [tuple(r) for r in df.select(kind, v_int, v_num).collect()] == [
        ("int", 1, 1.0), ("int", 2, 2.0), ("float", None, -0.5), ("int", 1000, 1000.0), ("float", None, 1e15), *[("str", None, None)] * 7]


def test_shifted_references(spark):
    shift = lambda f, r, c: one(spark, x=cells.shift_references(F.lit(f), F.lit(r), F.lit(c)))["x"]
    assert shift('LOG10(A1)+$B$2+Q1X+"A1"&\'A1 b\'!C$3', 1, 1) == 'LOG10(B2)+$B$2+Q1X+"A1"&\'A1 b\'!D$3'
    assert shift("A1", -1, -1) == "XFD1048576"
    assert shift("SUM(A1:B2)", 2, 0) == "SUM(A3:B4)"
    assert shift("", 1, 1) == ""


def test_serials(spark):
    got = one(spark, a=cells.timestamp_to_serial(F.expr("timestamp_ntz'1998-09-02 12:00:00'")), b=cells.serial_to_timestamp(F.lit(36040.5)).cast("string"), c=cells.serial_to_timestamp(F.lit(0.0), True).cast("string"))
    assert got == {"a": 36040.5, "b": "1998-09-02 12:00:00", "c": "1904-01-01 00:00:00"}


def test_function_table(tmp_path):
    own = worksheet_functions.load()
    assert own[7] == ("MAX", None) and own[0x18] == ("ABS", 1) and len(own) == 378
    more = tmp_path / "table.md"
    more.write_text("| 0x0241 | XLOOKUP | `x:1` | | join |\n0x0301, JOINED, 2\n0x0018 ABSOLUTE 3\n")
    table = worksheet_functions.load(str(more))
    assert table[0x241] == ("XLOOKUP", None) and table[0x301] == ("JOINED", 2) and table[0x18] == ("ABSOLUTE", 1) and table[4] == own[4]
