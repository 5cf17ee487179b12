"""Registered queries over bytes written out by hand from the published record and token layouts.

The writers of ``testing`` have no part in them, so a misreading shared by reader and writer shows.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from .functions import worksheet_functions
from .operators import relations
from .plans import render
from .registry import query
from .sources import formula_tokens

#: Token streams, what stands behind them, and the text of each, at cell A1 (row and column 0).
TOKENS = [
    ("1e020041e900", "", "=ACOSH(2)"), ("23010000001e01004202ff00", "", "=@ACOT(1)"), ("1e03001e01004202db00", "", "=ADDRESS(3,1)"),
    ("3b0000b9000000f000000009c009c03b0000b9000000f000000009c009c01704003e003100300030004203e401", "", '=AVERAGEIFS(Ledger!J186:J241,Ledger!J186:J241,">100")'),
    ("440100000009c01e000042020700", "", "=MAX(J2,0)"), ("440100000009c01e000042020600411800", "", "=ABS(MIN(J2,0))"), ("440100000009c0440100000008c005", "", "=J2*I2"),
    ("24000000000000", "", "=$A$1"), ("64000000000080", "", "=$A1"), ("44000000000040", "", "=A$1"), ("1e01001e0200031514", "", "=(1+2)%"),
    ("1f000000000000f83f13", "", "=-1.5"), ("1e05001312", "", "=+-5"), ("1703006100220062001d0108", "", '="a""b"&TRUE'), ("25000000000100000000c001c019100000", "", "=SUM(A1:B2)"),
    ("161c2a1c9942030100", "", "=IF(,#N/A,#ERR)"), ("440000000000c0440100000001c010", "", "=(A1,B2)"), ("440000000000c0440100000001c011440200000002c00f", "", "=A1:B2 C3"),
    ("1e01001e020009", "", "=1<2"), ("1e01001e02000a", "", "=1<=2"), ("1e01001e02000b", "", "=1=2"), ("1e01001e02000c", "", "=1>=2"), ("1e01001e02000d", "", "=1>2"), ("1e01001e02000e", "", "=1<>2"),
    ("1e07001e02000406", "", "=?/7-2"), ("1e02001e030007", "", "=2^3"), ("2301000000", "", "=_xlfn.ACOT"), ("4309000000", "", "=name9"), ("59000001000000", "", "=_xlfn.ACOT"),
    ("5a00000000000000c0", "", "=Ledger!A1"), ("5a07000000000000c0", "", "=[sheet7]!A1"), ("3a01000000000002c0", "", "='Two words'!C1"),
    ("2a000000000000", "", "=#REF!"), ("2b000000000000000000000000", "", "=#REF!:#REF!"), ("3c0000000000000000", "", "=#REF!"), ("3d0000000000000000000000000000", "", "=#REF!"),
    ("4c0100000001c0", "", "=B2"), ("4cffff0f00ffff", "", "=XFD1048576"), ("4d00000000010000000000ffff", "", "=$A$1:XFD2"),
    ("26000000000000440000000000c0", "", "=A1"), ("29000000000000440000000000c0", "", "=A1"), ("6000000000000000", "", "={array}"),
    ("1819000002000200000000000200", "", "=Table2[col1:col3]"), ("1819000000000200000000000200", "", "=Table2"), ("181d05000000", "", "=PivotName5"),
    ("1a", "", "=?ptg0x1a"), ("19040100000000001e0100", "", "=1"), ("1e010042810400", "", "=_xlfn.SUM(1)"), ("02020000000100", "", "=TABLE(B3)"), ("0104000000", "02000000", "={array@C5}"),
    ("410a00", "", "=NA()"), ("1e01001e02001e0300412900", "", "=DSUM(1,2,3)"), ("1e01004201ea7f", "", "=_func0x7fea(1)"),
]
_NAMES = formula_tokens.Names(("Ledger", "Two words"), ("_xlfn.ACOT",))


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(x if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") AS t({names})"


@query("token_streams", _values([(_quoted(c), _quoted(t)) for c, _, t in TOKENS], "code, formula"))
def token_streams(spark, root):
    @F.udf("string", useArrow=True)
    def text(code, extra):
        return formula_tokens.decompile(bytes.fromhex(code), bytes.fromhex(extra), 0, 0, _NAMES)[0]

    rows = spark.createDataFrame(TOKENS, "code string, extra string, formula string")
    return rows.select("code", text("code", "extra").alias("formula"))


#: Numbers of the public list, its fixed arguments, and names, across all its runs.
_FUNCTIONS = [
    (0, "COUNT", None), (2, "ISNA", 1), (10, "NA", 0), (40, "DCOUNT", 3), (45, "DSTDEV", 3), (47, "DVAR", 3), (61, "MIRR", 3), (97, "ATAN2", 2), (119, "REPLACE", 4), (125, "CELL", None), (142, "SLN", 3), (163, "MDETERM", 1),
    (169, "COUNTA", None), (183, "PRODUCT", None), (184, "FACT", 1), (189, "DPRODUCT", 3), (193, "STDEVP", None), (198, "ISLOGICAL", 1), (212, "ROUNDUP", 2), (216, "RANK", None), (219, "ADDRESS", None), (221, "TODAY", 0), (222, "VDB", None),
    (227, "MEDIAN", None), (228, "SUMPRODUCT", None), (229, "SINH", 1), (230, "COSH", 1), (231, "TANH", 1), (232, "ASINH", 1), (233, "ACOSH", 1), (234, "ATANH", 1), (235, "DGET", 3), (244, "INFO", 1), (247, "DB", None), (252, "FREQUENCY", 2),
    (261, "ERROR.TYPE", 1), (269, "AVEDEV", None), (273, "BINOMDIST", 4), (276, "COMBIN", 2), (285, "FLOOR", 2), (288, "CEILING", 2), (293, "NORMDIST", 4), (300, "POISSON", 3), (307, "CORREL", 2), (309, "FORECAST", 3), (321, "SUMSQ", None),
    (325, "LARGE", 2), (326, "SMALL", 2), (327, "QUARTILE", 2), (328, "PERCENTILE", 2), (336, "CONCATENATE", 2), (337, "POWER", 2), (342, "RADIANS", 1), (344, "SUBTOTAL", None), (345, "SUMIF", None), (346, "COUNTIF", None), (347, "COUNTBLANK", 1),
    (350, "ISPMT", 4), (351, "DATEDIF", 3), (358, "GETPIVOTDATA", None), (359, "HYPERLINK", None), (361, "AVERAGEA", None), (367, "VARA", None), (379, "RTD", None), (384, "HEX2BIN", None), (396, "IMSUB", 2), (411, "COMPLEX", None), (417, "QUOTIENT", 2),
    (424, "ERFC", 1), (430, "XNPV", 3), (441, "PRICE", None), (449, "EDATE", 2), (450, "EOMONTH", 2), (464, "RANDBETWEEN", 2), (465, "WEEKNUM", None), (471, "WORKDAY", None), (472, "NETWORKDAYS", None), (475, "LCM", None), (480, "IFERROR", 2),
    (481, "COUNTIFS", None), (482, "SUMIFS", None), (483, "AVERAGEIF", None), (484, "AVERAGEIFS", None),
]


@query("function_names", _values([(k, _quoted(n)) for k, n, _ in _FUNCTIONS], "id, name"))
def function_names(spark, root):
    own = worksheet_functions.load()
    return spark.createDataFrame([(k, own[k][0]) for k, _, _ in _FUNCTIONS], "id int, name string")


@query("function_arities", _values([(k, c) for k, _, c in _FUNCTIONS if c is not None], "id, arguments"))
def function_arities(spark, root):
    own = worksheet_functions.load()
    return spark.createDataFrame([(k, own[k][1]) for k, _, c in _FUNCTIONS if c is not None], "id int, arguments int")


@query("function_runs", "SELECT * FROM (VALUES (378, 364, 484)) AS t(functions, of_the_public_list, last_of_it)")
def function_runs(spark, root):
    own = worksheet_functions.load()
    listed = [k for k in own if k <= 484]
    return spark.createDataFrame([(len(own), len(listed), max(listed))], "functions int, of_the_public_list int, last_of_it int")


_SHEET = (
    "0019" + "02000000" + "00" * 21  # row 3
    + "020c" + "0000000000000000" + "aa000000"  # packed whole number 42
    + "020c" + "0a00000000000000" + "ab000000"  # the same in hundredths
    + "0309" + "0100000000000000" + "07" + "0409" + "0200000000000000" + "01" + "0510" + "0300000000000000" + "000000000000f83f"
    + "0610" + "0400000000000000" + "0200000048006900" + "070c" + "0500000000000000" + "01000000"
    + "081b" + "0600000000000000" + "010000007800" + "0000" + "030000001e0100" + "00000000"
    + "091d" + "0700000000000000" + "0000000000000440" + "0000" + "030000001e0200" + "00000000"
    + "0a16" + "0800000000000000" + "00" + "0000" + "030000001e0300" + "00000000"
    + "0b16" + "0900000000000000" + "2a" + "0000" + "030000001e0400" + "00000000"
    + "a10110" + "02000000" + "09000000" + "00000000" + "0a000000"  # filter A3:K10
    + "a30106" + "01000000" + "0000" + "ac0104" + "01000000" + "ae010a" + "0404" + "0000000000002440" + "ae010a" + "0802" + "0100000000000000" + "ad0100" + "a40100"
    + "a30106" + "04000000" + "0000" + "ac0104" + "00000000" + "ae0110" + "0602" + "0000000000000000" + "0100000061 00".replace(" ", "") + "ae010a" + "0c02" + "0000000000000000"
    + "ae010a" + "0e05" + "0000000000000000" + "ad0100" + "a40100" + "a20100"
)
_BOOK = {
    "xl/workbook.bin": "9c011a" + "00000000" + "01000000" + "040000007200490064003100" + "010000005300",
    "xl/sharedStrings.bin": "130b" + "00" + "03000000" + "6f006e006500" + "130b" + "00" + "03000000" + "740077006f00",
    "xl/worksheets/sheet1.bin": _SHEET,
    "xl/pivotTables/p.bin": "98022a" + "00" * 28 + "05000000" + "010000005000" + "00000000" + "9d0200" + "9a0200" + "d9040c" + "02000000" + "00000000" + "0a000000" + "ae010a" + "0404" + "0000000000002440" + "da0400",
}
_LINKS = {
    "xl/_rels/workbook.bin.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.bin"/></Relationships>',
    "xl/worksheets/_rels/sheet1.bin.rels": '<Relationships><Relationship Id="a" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/pivotTable" Target="../pivotTables/p.bin"/></Relationships>',
}


def _book(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, code in _BOOK.items():
            z.writestr(name, bytes.fromhex(code))
        for name, text in _LINKS.items():
            z.writestr(name, text)
    return spark.createDataFrame([("/literal.xlsb", held.getvalue())], "path string, content binary")


@query("binary_cells", _values([
    (0, "'int'", 42, "42.0::DOUBLE", "NULL", "NULL::BOOLEAN", "NULL", "false"), (10, "'float'", "NULL", "0.42::DOUBLE", "NULL", "NULL", "NULL", "false"),
    (1, "'error'", "NULL", "NULL", "NULL", "NULL", "'#DIV/0!'", "false"), (2, "'bool'", "NULL", "NULL", "NULL", "true", "NULL", "false"), (3, "'float'", "NULL", "1.5", "NULL", "NULL", "NULL", "false"),
    (4, "'str'", "NULL", "NULL", "'Hi'", "NULL", "NULL", "false"), (5, "'str'", "NULL", "NULL", "'two'", "NULL", "NULL", "false"), (6, "'str'", "NULL", "NULL", "'x'", "NULL", "NULL", "true"),
    (7, "'float'", "NULL", "2.5", "NULL", "NULL", "NULL", "true"), (8, "'bool'", "NULL", "NULL", "NULL", "false", "NULL", "true"), (9, "'error'", "NULL", "NULL", "NULL", "NULL", "'#N/A'", "true"),
], "col, kind, v_int, v_num, v_str, v_bool, v_err, from_formula"))
def binary_cells(spark, root):
    return relations.cells(_book(spark)).filter("row = 2 and sheet = 'S'").select("col", "kind", "v_int", "v_num", "v_str", "v_bool", "v_err", "from_formula")


@query("binary_formulas", _values([(6, "'=1'"), (7, "'=2'"), (8, "'=3'"), (9, "'=4'")], "col, formula"))
def binary_formulas(spark, root):
    return relations.formulas(_book(spark)).select("col", "formula")


@query("binary_filters", _values([
    ("'A3:K10'", 1, "'and'", 0, "'>'", "'number'", "10.0::DOUBLE", "NULL", "NULL::BOOLEAN"), ("'A3:K10'", 1, "'and'", 1, "'='", "'bool'", "NULL", "NULL", "true"),
    ("'A3:K10'", 4, "'or'", 0, "'='", "'text'", "NULL", "'a'", "NULL"), ("'A3:K10'", 4, "'or'", 1, "'='", "'blank'", "NULL", "NULL", "NULL"), ("'A3:K10'", 4, "'or'", 2, "'<>'", "'nonblank'", "NULL", "NULL", "NULL"),
], "ref, col_id, logic, pos, operator, kind, v_num, v_str, v_bool"))
def binary_filters(spark, root):
    columns = relations.auto_filters(_book(spark)).select("ref", F.explode("columns").alias("c"))
    return columns.select("ref", "c.col_id", "c.logic", F.posexplode("c.conditions").alias("pos", "x")).select("ref", "col_id", "logic", "pos", "x.operator", "x.kind", "x.v_num", "x.v_str", "x.v_bool")


@query("binary_pivot_filters", _values([("'P'", 5, 1, 1, 2, 10, "'>'", "10.0::DOUBLE")], "name, cache_id, pivot_fields, pivot_items, field_index, filter_type, operator, v_num"))
def binary_pivot_filters(spark, root):
    own = relations.pivot_tables(_book(spark)).select("name", "cache_id", "pivot_fields", "pivot_items", F.explode("sx_filters").alias("f"))
    return own.select("name", "cache_id", "pivot_fields", "pivot_items", "f.field_index", "f.filter_type", F.explode("f.criteria").alias("x")).select(
        "name", "cache_id", "pivot_fields", "pivot_items", "field_index", "filter_type", "x.operator", "x.v_num")


_OPEN_XML = {
    "xl/workbook.xml": '<x:workbook xmlns:x="m" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><x:sheets><x:sheet name="S" sheetId="1" r:id="rId1"/></x:sheets></x:workbook>',
    "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Target='worksheets/Sheet1.xml' Id='rId1'/></Relationships>",
    "xl/SharedStrings.xml": '<x:sst xmlns:x="m"><x:si><x:t xml:space="preserve"> a </x:t></x:si><x:si><x:r><x:t>b</x:t></x:r><x:r><x:t>c</x:t></x:r><x:rPh><x:t>no</x:t></x:rPh></x:si></x:sst>',
    "XL/worksheets/sheet1.xml": '<x:worksheet xmlns:x="m"><x:sheetData><x:row r="1"><x:c r="A1"><x:v>7</x:v></x:c><x:c r="B1"><x:f>A1/2</x:f><x:v>3.5</x:v></x:c><x:c r="C1" t="b"><x:v>1</x:v></x:c>'
    '<x:c r="D1" t="e"><x:v>#REF!</x:v></x:c><x:c r="E1" t="s"><x:v>0</x:v></x:c><x:c r="F1" t="s"><x:v>1</x:v></x:c><x:c r="G1" t="inlineStr"><x:is><x:t>in</x:t></x:is></x:c><x:c r="H1" t="str"><x:f>"x"&amp;1</x:f><x:v>x1</x:v></x:c>'
    '<x:c r="I1"/></x:row><x:row r="2"><x:c r="A2"><x:v>1</x:v></x:c><x:c r="A2"><x:v>2</x:v></x:c></x:row></x:sheetData>'
    '<x:autoFilter ref="A1:C9"><x:filterColumn colId="1"><x:customFilters and="1"><x:customFilter operator="greaterThanOrEqual" val="2"/><x:customFilter operator="notEqual" val=" "/></x:customFilters></x:filterColumn></x:autoFilter></x:worksheet>',
}


def _open_xml(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in _OPEN_XML.items():
            z.writestr(name, text)
    return spark.createDataFrame([("/literal.xlsx", held.getvalue())], "path string, content binary")


@query("open_xml_cells", _values([
    ("'A1'", "'int'", "'7'", "false"), ("'B1'", "'float'", "'3.5'", "true"), ("'C1'", "'bool'", "'true'", "false"), ("'D1'", "'error'", "'#REF!'", "false"), ("'E1'", "'str'", "' a '", "false"), ("'F1'", "'str'", "'bc'", "false"),
    ("'G1'", "'str'", "'in'", "false"), ("'H1'", "'str'", "'x1'", "true"), ("'A2'", "'int'", "'2'", "false"),
], "addr, kind, value, from_formula"))
def open_xml_cells(spark, root):
    """Prefixed names, part names in another case, attributes in any order, rich and inline text, a repeated cell."""
    value = F.coalesce("v_str", "v_err", F.col("v_int").cast("string"), F.col("v_num").cast("string"), F.col("v_bool").cast("string"))
    return relations.cells(_open_xml(spark)).select("addr", "kind", value.alias("value"), "from_formula")


_JSON_TEXT = """{
  "filters": [
    {
      "bottom_right": "C9",
      "columns": [
        {
          "attrs": null,
          "col_id": 1,
          "conditions": [
            {
              "kind": "number",
              "operator": ">=",
              "v_bool": null,
              "v_num": 2.0,
              "v_str": null
            },
            {
              "kind": "nonblank",
              "operator": "<>",
              "v_bool": null,
              "v_num": null,
              "v_str": null
            }
          ],
          "logic": "and",
          "type": "custom",
          "values": null
        }
      ],
      "ref": "A1:C9",
      "sheet": "S",
      "top_left": "A1"
    }
  ],
  "formulas": {
    "S": {
      "B1": "=A1/2",
      "H1": "=\\"x\\"&1"
    }
  }
}"""
_MARKDOWN = """## Formulas: S
- B1: =A1/2
- H1: ="x"&1

## Filter: S (A1:C9)
- column 1: >= 2.0 and <> nonblank
"""


@query("rendered_book", _values([("'json'", _quoted(_JSON_TEXT)), ("'markdown'", _quoted(_MARKDOWN)), ("'dict'", "'S=B1,H1'")], "form, text"))
def rendered_book(spark, root):
    """One workbook as the command line shows it."""
    data = render.collect(_open_xml(spark), ("formulas", "filters"))
    shown = ";".join(f"{s}={','.join(cells)}" for s, cells in data["formulas"].items())
    return spark.createDataFrame([("json", render.as_json(data)), ("markdown", render.as_markdown(data)), ("dict", shown)], "form string, text string")
