import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.operators import relations
from gridspark.plans import render, scrub
from gridspark.sources import biff12, formula_tokens, package, vba, workbook
from gridspark.sources.formula_tokens import Names, decompile
from gridspark.streaming import ingest
from gridspark.testing import writers as w

CELLS = [
    (0, 0, "text"), (0, 1, 42), (0, 2, 3.25), (0, 3, True), (0, 4, "#DIV/0!"), (1, 0, ""), (1, 1, -1), (1, 2, 1.23), (2, 0, 1e300), (2, 1, " spaced "), (5, 16383, "last"),
]


def books(spark, **files):
    return spark.createDataFrame([(f"/b/{n.replace('_', '.')}", c) for n, c in files.items()], "path string, content binary")


def values(df):
    return {(r.sheet, r.row, r.col): (r.kind, next((getattr(r, k) for k in ("v_int", "v_num", "v_str", "v_bool", "v_err") if getattr(r, k) is not None), None)) for r in df.collect()}


def test_values_of_both_formats(spark):
    sheets = {"One": CELLS, "It's": [(0, 0, "text")], "Empty": []}
    got = relations.cells(books(spark, a_xlsx=w.xlsx(sheets), b_xlsb=w.xlsb(sheets)))
    want = {("One", r, c): ({bool: "bool", str: "str", float: "float", int: "int"}[type(v)] if not str(v).startswith("#") else "error", v) for r, c, v in CELLS} | {("It's", 0, 0): ("str", "text")}
    for path in ("/b/a.xlsx", "/b/b.xlsb"):
        assert values(got.filter(f"path = '{path}'")) == want
    assert [r.sheet for r in relations.sheets(books(spark, a_xlsx=w.xlsx(sheets))).orderBy("sheet_idx").collect()] == ["One", "It's", "Empty"]
    assert set(values(relations.cells(books(spark, a_xlsx=w.xlsx(sheets), b_xlsb=w.xlsb(sheets)), "It's"))) == {("It's", 0, 0)}


def test_odd_cells(spark):
    body = (
        '<c r="A1" t="inlineStr"><is><r><t>ri</t></r><r><t xml:space="preserve">ch </t></r></is></c><c r="B1" t="s"><v>99</v></c><c r="C1" t="s"><v>0</v></c><c r="D1" t="b"><v>true</v></c>'
        '<c r="E1"><v>1e400</v></c><c r="F1"><v>1</v></c><c r="F1"><v>2</v></c><c r="G1"/><c r="bad"><v>1</v></c><c r="H1" t="inlineStr"><is><t/></is></c><c r="I1" t="d"><v>2024-01-02</v></c>'
    )
    sheet = f'<x:worksheet xmlns:x="{w.MAIN}"><x:sheetData><x:row r="1">' + body.replace("<c ", "<x:c ").replace("</c>", "</x:c>").replace("<v>", "<x:v>").replace("</v>", "</x:v>").replace("<is>", "<x:is>").replace("</is>", "</x:is>").replace("<r>", "<x:r>").replace("</r>", "</x:r>").replace("<t>", "<x:t>").replace("<t ", "<x:t ").replace("</t>", "</x:t>").replace("<t/>", "<x:t/>") + "</x:row></x:sheetData></x:worksheet>"
    strings = f'<sst xmlns="{w.MAIN}"><si><r><t>a</t></r><r><t>b</t></r><rPh sb="0"><t>ph</t></rPh></si></sst>'
    made = w.xlsx({"S": []}, extra={"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": strings})
    got = {k[2]: v for k, v in values(relations.cells(books(spark, a_xlsx=made))).items()}
    assert got == {0: ("str", "rich "), 1: ("str", ""), 2: ("str", "ab"), 3: ("bool", True), 4: ("str", "1e400"), 5: ("int", 2), 7: ("str", ""), 8: ("str", "2024-01-02")}


def test_relationships_in_any_order_and_case(spark):
    made = w.package({
        "XL/Workbook.xml": f'<workbook xmlns="{w.MAIN}" xmlns:r="{w.DOC}"><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" r:id="r2"/><sheet name="C" sheetId="3" r:id="none"/><sheet name="" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Target="/xl/worksheets/ONE.xml" Id="r1"/><Relationship Target="worksheets/../worksheets/two.xml" Id="r2"/><Relationship Id="r3"/></Relationships>',
        "xl/worksheets/one.xml": w.sheet_xml([(0, 0, 1)], w.Strings()), "xl/worksheets/two.xml": "<worksheet><sheetData><row",
    })
    df = books(spark, a_xlsx=made)
    assert [(r.sheet, r.part) for r in relations.sheets(df).orderBy("sheet_idx").collect()] == [("A", "xl/worksheets/ONE.xml"), ("B", "xl/worksheets/two.xml"), ("C", None)]
    assert values(relations.cells(df)) == {("A", 0, 0): ("int", 1)}


def test_large_sheets_are_cut_at_rows():
    xml = w.sheet_xml([(r, c, r * c) for r in range(200) for c in range(5)], w.Strings()).encode()
    chunks = package.sheet_chunks(package.plain_xml(xml), 2000)
    assert len(chunks) > 5 and chunks[0][0] == "frame" and b"<row" not in chunks[0][1]
    assert sum(c.count(b"<c ") for _, c in chunks[1:]) == 1000 and all(c.count(b"<row") == c.count(b"</row>") for _, c in chunks[1:])


def test_broken_packages_do_not_fail(spark):
    whole = w.xlsb({"S": CELLS})
    df = books(spark, a_xlsx=b"not a zip", b_xlsb=b"", c_xlsb=whole[:200], d_xlsb=whole, e_xlsm=w.xlsx({"S": []}, extra={"xl/vbaProject.bin": b"junk"}))
    assert {r.path for r in package.problems(df).collect()} == {"/b/a.xlsx", "/b/c.xlsb"}
    assert relations.cells(df).select("path").distinct().count() == 1
    assert relations.vba_modules(df).count() == 0 and relations.vba_problems(df).count() == 1
    for f in (relations.formulas, relations.auto_filters, relations.pivot_tables, relations.defined_names, relations.shared_strings):
        f(df).collect()


def test_streams_cut_at_every_byte():
    strings = w.Strings()
    whole = w.sheet_bin([*CELLS, (7, 0, 1.0, w.parsed(w.token_int(1)))], strings, w.filter_records((0, 9, 0, 3), [{"col_id": 1, "values": ["x"], "criteria": [(4, 1.0)]}]))
    everything = biff12.cell_rows(whole)
    for n in range(len(whole)):
        for decoder in biff12.DECODERS.values():
            decoder(whole[:n])
    assert len(everything) == len(CELLS) + 1


def test_record_framing():
    assert [(t, p) for _, t, p, _ in biff12.records(bytes.fromhex("AA0300"))] == [(0x01AA, b"")]
    assert [e for *_, e in biff12.records(bytes.fromhex("AA0305"))] == ["a record is cut off"]
    assert [e for *_, e in biff12.records(bytes.fromhex("AA0380"))] == ["the size of a record is cut off"]
    assert [len(p) for _, _, p, _ in biff12.records(w.record(5, b"x" * 300))] == [300]


# Formulas that must come out of these tokens.
AREA = w.token_area(185, 240, 9, 9, 0x3B)
FORMULAS = {
    "=ACOSH(2)": w.token_int(2) + w.token_func(0xE9), "=@ACOT(1)": b"\x23\x01\0\0\0" + w.token_int(1) + w.token_func(0xFF, 2), "=ADDRESS(3,1)": w.token_int(3) + w.token_int(1) + w.token_func(0xDB, 2),
    '=AVERAGEIFS(Ledger!J186:J241,Ledger!J186:J241,">100")': (AREA[:1] + b"\0\0" + AREA[1:]) * 2 + w.token_text(">100") + w.token_func(0x1E4, 3),
    "=MAX(J2,0)": w.token_ref(1, 9) + w.token_int(0) + w.token_func(7, 2), "=ABS(MIN(J2,0))": w.token_ref(1, 9) + w.token_int(0) + w.token_func(6, 2) + w.token_func(0x18),
    "=J2*I2": w.token_ref(1, 9) + w.token_ref(1, 8) + b"\x05", "=$A$1": w.token_ref(0, 0, relative=False), "=(1+2)%": w.token_int(1) + w.token_int(2) + b"\x03\x15\x14",
    "=-1.5": w.token_number(1.5) + b"\x13", '="a""b"&TRUE': w.token_text('a"b') + b"\x1d\x01\x08", "=SUM(A1:B2)": w.token_area(0, 1, 0, 1) + b"\x19\x10\0\0",
    "=IF(,#N/A,#ERR)": b"\x16\x1c\x2a\x1c\x99" + w.token_func(1, 3), "=(A1,B2)": w.token_ref(0, 0) + w.token_ref(1, 1) + b"\x10", "=A1:B2 C3": w.token_ref(0, 0) + w.token_ref(1, 1) + b"\x11" + w.token_ref(2, 2) + b"\x0f",
    "=name9": b"\x43\x09\0\0\0", "=[sheet7]!A1": b"\x5a\x07\0" + w.token_ref(0, 0)[1:], "=#REF!": b"\x2a" + b"\0" * 6, "=#REF!:#REF!": b"\x2b" + b"\0" * 12, "={array}": b"\x60" + b"\0" * 7,
    "=Table2[col1:col3]": b"\x18\x19" + struct.pack("<HBBIHH", 0, 2, 0, 2, 0, 2), "=Table2": b"\x18\x19" + struct.pack("<HBBIHH", 0, 0, 0, 2, 0, 2), "=PivotName5": b"\x18\x1d" + struct.pack("<I", 5),
    "=?ptg0x1a": b"\x1a", "=1": b"\x19\x04\x01\0\0\0\0\0" + w.token_int(1), "=_xlfn.SUM(1)": w.token_int(1) + w.token_func(4, 0x81), "=?+?": b"\x03",
    "=TABLE(B3)": b"\x02" + struct.pack("<IH", 2, 1), "={array@C5}": b"\x01" + struct.pack("<I", 4),
}


@pytest.mark.parametrize("text", FORMULAS)
def test_tokens(text):
    extra = struct.pack("<I", 2) if text == "={array@C5}" else b""
    assert decompile(FORMULAS[text], extra, 0, 0, Names(("Ledger",), ("_xlfn.ACOT",))) == (text, None)


def test_relative_offsets_wrap():
    assert decompile(w.token_ref(0xFFFFF, 0, 0x4C), b"", 0, 0, Names()) == ("=A1048576", None)
    assert decompile(w.token_ref(0, -1, 0x4C), b"", 4, 0, Names()) == ("=XFD5", None)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60))
def test_any_tokens_give_text(code):
    text, _ = decompile(code, b"", 3, 3, Names())
    assert text.startswith("=")


@settings(max_examples=300, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_text(d):
    assert float(formula_tokens.number_text(d)) == d


def test_formulas_of_both_formats(spark):
    pending = w.parsed(b"\x01" + struct.pack("<I", 1), struct.pack("<I", 0))
    body = w.record(biff12.SHARED_BODY, struct.pack("<4I", 1, 3, 0, 0) + w.parsed(w.token_ref(0, 1, 0x4C) + w.token_int(2) + b"\x05"))
    second = w.record(biff12.SHARED_BODY, struct.pack("<4I", 1, 9, 0, 0) + w.parsed(w.token_int(9)))
    binary = w.xlsb({"S": [(0, 0, 1.0, w.parsed(w.token_ref(0, 1) + w.token_func(0x18))), (1, 0, 1.0, (pending, body)), (2, 0, "x", pending), (3, 0, True, (pending, second)), (7, 0, 2.0, pending), (20, 0, 2.0, pending), (21, 0, 0.0, w.parsed(b"\x1f\0"))]})
    xml = w.xlsx({"S": [
        (0, 0, 1, "ABS(B1)"), (1, 0, 1, {"t": "shared", "si": 0}), (2, 0, 1, {"t": "shared", "si": 0, "ref": "A3:A5", "text": "B3*LOG10(2)"}), (3, 0, 1, {"t": "shared", "si": 0}),
        (4, 0, 1, {"t": "shared", "si": 0, "ref": "A5:A9", "text": "$B$1"}), (5, 0, 1, {"t": "shared", "si": 0}), (6, 0, 1, {"t": "array", "ref": "A7", "text": "SUM(B1:B2*2)"}), (7, 0, 1, {"ca": "1", "text": "_xludf.F(1)"}),
    ]})
    got = {(r.path[-4:], r.addr): (r.formula, r.formula_kind) for r in relations.formulas(books(spark, a_xlsb=binary, b_xlsx=xml)).collect()}
    assert got == {
        ("xlsb", "A1"): ("=ABS(B1)", "normal"), ("xlsb", "A2"): ("=B2*2", "shared"), ("xlsb", "A3"): ("=B3*2", "shared"), ("xlsb", "A4"): ("=B4*2", "shared"), ("xlsb", "A8"): ("=9", "shared"),
        ("xlsb", "A21"): ("={shared_formula}", "unresolved"), ("xlsb", "A22"): ("=<parse_error:token stream ends early>", "normal"),
        ("xlsx", "A1"): ("=ABS(B1)", "normal"), ("xlsx", "A2"): ("={shared_formula}", "unresolved"), ("xlsx", "A3"): ("=B3*LOG10(2)", "shared"), ("xlsx", "A4"): ("=B4*LOG10(2)", "shared"),
        ("xlsx", "A5"): ("=$B$1", "shared"), ("xlsx", "A6"): ("=$B$1", "shared"), ("xlsx", "A7"): ("{=SUM(B1:B2*2)}", "array"), ("xlsx", "A8"): ("=F(1)", "normal"),
    }


def test_names_and_links(spark):
    extra = {
        "xl/worksheets/_rels/sheet1.xml.rels": w.rels_xml({"a": "../pivotTables/p1.xml"}), "xl/worksheets/_rels/sheet2.xml.rels": w.rels_xml({"a": "../pivotTables/P1.xml", "b": "../pivotTables/p2.xml"}),
        "xl/pivotTables/p1.xml": f'<pivotTableDefinition xmlns="{w.MAIN}" name="P1" cacheId="10"><location ref="A13:E21" firstHeaderRow="1" firstDataRow="2" firstDataCol="1"/></pivotTableDefinition>',
        "xl/pivotTables/p2.xml": "<broken", "xl/pivotTables/_rels/p1.xml.rels": w.rels_xml({"a": "../pivotCache/pivotCacheDefinition1.xml", "b": "../pivotCache/pivotCacheDefinition2.xml"}),
    }
    df = books(spark, a_xlsx=w.xlsx({"One": [], "Two": []}, extra=extra, names={"n1": "One!$A$1"}), b_xlsb=w.xlsb({"S": []}, names=["first", "second"]))
    got = {r.part: r for r in relations.pivot_tables(df).collect()}
    assert (got["xl/pivotTables/p1.xml"].sheet, got["xl/pivotTables/p1.xml"].cache_id, got["xl/pivotTables/p1.xml"].pivot_cache_definition) == ("One", 10, "xl/pivotCache/pivotCacheDefinition1.xml")
    assert got["xl/pivotTables/p1.xml"].location.rfx_geom.asDict() == {"top_left": "A13", "bottom_right": "E21"}
    assert got["xl/pivotTables/p2.xml"].name is None and len(got) == 2
    links = {(r.sheet, r.pivot_part, r.cache) for r in relations.pivot_links(df).collect()}
    assert links == {(r.sheet, r.part, r.pivot_cache_definition) for r in got.values()}
    assert sorted((r.idx, r.name) for r in relations.defined_names(df).collect()) == [(1, "first"), (1, "n1"), (2, "second")]


def test_filters(spark):
    tail = '<autoFilter ref="A1:M241"><filterColumn colId="12"><customFilters><customFilter operator="greaterThan" val="1"/></customFilters></filterColumn><filterColumn colId="1"><top10 val="3" percent="1"/></filterColumn><filterColumn colId="2"><dynamicFilter type="aboveAverage"/></filterColumn><filterColumn colId="3"><colorFilter dxfId="0"/></filterColumn></autoFilter>'
    (row,) = relations.auto_filters(books(spark, a_xlsx=w.xlsx({"S": [], "T": []}, {"S": tail}))).collect()
    c = {x.col_id: x for x in row["columns"]}
    assert (row.ref, row.top_left, row.bottom_right) == ("A1:M241", "A1", "M241")
    assert (c[12].type, c[12].logic, c[12].conditions[0].operator, c[12].conditions[0].v_num) == ("custom", "or", ">", 1.0)
    assert c[1].attrs == {"val": "3", "percent": "1"} and c[2].attrs == {"type": "aboveAverage"} and c[3].type is None
    inner = w.record(biff12.SX_FILTER, b"\0" * 12) + w.filter_records((0, 1, 0, 1), []) + w.record(biff12.SX_FILTER_END)
    tail = inner + w.filter_records((0, 9, 0, 2), [{"col_id": 0, "criteria": [(2, None), (4, True), (3, "a")]}]) + inner
    (row,) = relations.auto_filters(books(spark, a_xlsb=w.xlsb({"S": []}, {"S": tail}))).collect()
    assert row.ref == "A1:C10" and [(x.operator, x.kind) for x in row["columns"][0].conditions] == [("=", "blank"), (">", "bool"), ("<=", "text")]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=9000))
def test_compression_round_trip(data):
    assert vba.decompress(w.compress(data)) == data


def test_copy_tokens_and_damage():
    # "abcabcabc": three literals, then a copy of six that overlaps itself
    chunk = b"\x08abc" + struct.pack("<H", (3 - 1) << 12 | (6 - 3))
    assert vba.decompress(b"\x01" + struct.pack("<H", 0xB000 | len(chunk) - 1) + chunk) == b"abcabcabc"
    for bad in (b"", b"\x02", b"\x01" + struct.pack("<H", 0xB002) + b"\x01\xff\xff"):
        with pytest.raises(vba.Damaged):
            vba.decompress(bad)
    looped = bytearray(w.vba_project({"M": "x" * 2000}))
    fat = struct.unpack_from("<I", looped, 76)[0]
    struct.pack_into("<I", looped, (fat + 1) * 512, 0)
    with pytest.raises(vba.Damaged):
        vba.read_project(bytes(looped))


def test_modules(spark):
    sources = {"ThisWorkbook": "", "modLog": "Sub A()\r\nEnd Sub\r\n" * 500, "Prüfläufe": "' Zürich\r\n"}
    made = w.vba_project(sources, 1252, {"ThisWorkbook": "class"})
    df = books(spark, a_xlsm=w.xlsx({"S": []}, extra={"xl/vbaProject.bin": made}), b_xlsb=w.xlsb({"S": []}, extra={"xl/vbaProject.bin": w.vba_project({"M": "' Сводка"}, 1251)}), c_xlsx=w.xlsx({"S": []}))
    got = {(r.path, r.module): (r.source, r.module_type) for r in relations.vba_modules(df).collect()}
    assert got == {("/b/a.xlsm", k): (v, "class" if k == "ThisWorkbook" else "procedural") for k, v in sources.items()} | {("/b/b.xlsb", "M"): ("' Сводка", "procedural")}


def test_rendering_and_scrubbing(spark, tmp_path, capsys):
    made = w.xlsx({"S": [(0, 0, "a"), (9, 0, 2.5), (1, 1, 1, "A1+1")]}, {"S": '<autoFilter ref="A1:B2"><filterColumn colId="0"><filters><filter val="a"/></filters></filterColumn></autoFilter>'}, {"docProps/app.xml": "<Properties><Application>X</Application><AppVersion>1</AppVersion></Properties>"})
    df = books(spark, a_xlsx=made)
    data = render.collect(df, render.SECTIONS)
    assert data["formulas"] == {"S": {"B2": "=A1+1"}} and data["values"] == {"S": {"A1": "a", "B2": 1, "A10": 2.5}}
    text = render.as_markdown(data)
    assert "- B2: =A1+1" in text and "- column 0: a" in text and render.as_markdown({}) == "(no formulas found)"
    assert '"A10": 2.5' in render.as_json(data)
    (row,) = package.parts(scrub.strip_metadata(df), "docprops").collect()
    assert row.text == "<Properties><Application></Application><AppVersion></AppVersion></Properties>"
    assert values(relations.cells(scrub.strip_metadata(df))) == values(relations.cells(df))
    root = df.first().path.rpartition("/")[0]
    scrub.write_files(scrub.strip_metadata(df), str(tmp_path / "out"), root)
    twice = df.withColumn("path", F.explode(F.array(F.lit("file:///in/x/a.xlsx"), F.lit("file:///in/y/a.xlsx"))))
    scrub.write_files(twice, f"file://{tmp_path}/two", "file:///in")
    assert sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / "two").rglob("*.*")) == ["two/x/a.xlsx", "two/y/a.xlsx"]
    from gridspark import cli

    assert cli.main([str(tmp_path / "out" / "a.xlsx"), "S", "--format", "json", "--include", "Values"]) == 0
    assert '"A1": "a"' in capsys.readouterr().out
    assert package.workbooks(spark, str(tmp_path / "out")).count() == 1


def test_source_with_and_without_pushdown(spark, tmp_path):
    for name, make in (("a.xlsx", w.xlsx), ("b.xlsb", w.xlsb)):
        (tmp_path / name).write_bytes(make({"One": CELLS, "Two": [(0, 0, 1)]}))
    (tmp_path / "c.xlsm").write_bytes(w.xlsx({"S": []}, extra={"xl/vbaProject.bin": w.vba_project({"M": "x"})}))
    workbook.register(spark)
    for push in ("true", "false"):
        read = lambda entity: spark.read.format("workbook").option("entity", entity).option("pushdown", push).load(str(tmp_path))  # noqa: B023, E731
        got = read("cells")
        assert got.filter("sheet = 'Two'").count() == 2
        for n in ("a.xlsx", "b.xlsb"):
            assert values(got.filter(f"path = '{tmp_path}/{n}' and sheet = 'One'")) == {("One", *k[1:]): v for k, v in values(relations.cells(books(spark, a_xlsx=w.xlsx({"One": CELLS})))).items()}
        assert read("sheets").count() == 5 and read("vba_modules").first().source == "x" and read("parts").count() > 10
        if push == "false":
            spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(w.xlsx({"S": [(0, 0, 1)]}))
    def run():
        q = ingest.stream_relation(ingest.workbook_stream(spark, str(tmp_path / "in")), "cells", str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()

    run()
    (tmp_path / "in" / "b.xlsb").write_bytes(w.xlsb({"S": [(0, 0, 2), (1, 0, 3)]}))
    run()
    assert sorted(r.v_int for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_sheet_links(spark):
    """A list of sheet links redirects the numbers in formulas; without one they are direct."""
    formula = w.parsed(b"\x5a\x01\0" + w.token_ref(0, 0)[1:])
    plain = w.xlsb({"First": [(0, 0, 1.0, formula)], "Second": []})
    assert relations.formulas(books(spark, a_xlsb=plain)).first().formula == "=Second!A1"
    strings = w.Strings()
    book = b"".join(w.record(biff12.SHEET, struct.pack("<II", 0, k + 1) + w.wide(f"rId{k + 1}") + w.wide(n)) for k, n in enumerate(["First", "Second"]))
    book += w.record(0x0163) + w.record(biff12.LINK_SELF) + w.record(biff12.SHEET_LINKS, struct.pack("<I", 3) + struct.pack("<Iii", 1, 1, 1) + struct.pack("<Iii", 1, 0, 0) + struct.pack("<Iii", 0, 0, 0))
    linked = w.xlsb({"First": [(0, 0, 1.0, formula), (1, 0, 1.0, w.parsed(b"\x5a\x02\0" + w.token_ref(0, 0)[1:]))], "Second": []}, extra={"xl/workbook.bin": book})
    assert sorted(r.formula for r in relations.formulas(books(spark, a_xlsb=linked)).collect()) == ["=First!A1", "=[sheet2]!A1"]


def test_facade(spark, tmp_path):
    from gridspark.plans.facade import Workbook, col_to_letter

    made = w.xlsx({"A": CELLS, "B": []}, {"A": '<autoFilter ref="A1:B2"/>'}, {"xl/vbaProject.bin": w.vba_project({"M": "x"})})
    (tmp_path / "a.xlsm").write_bytes(made)
    with Workbook(spark, str(tmp_path / "a.xlsm")) as book:
        assert book.sheet_names == ["A", "B"] and dict(book.iter_vba_modules()) == {"M": "x"} and col_to_letter(702) == "AAA"
        grids = dict(book.iter_values())
        assert grids["B"] == {} and grids["A"] == {(r, c): v for r, c, v in CELLS}
        assert [f["ref"] for f in book.iter_filters()] == ["A1:B2"] and list(book.iter_pivot_tables()) == [] and dict(book.iter_formulas()) == {"A": {}, "B": {}}


@pytest.mark.parametrize("relation", ["sheets", "cells", "formulas", "auto_filters", "pivot_tables", "vba_modules", "defined_names", "shared_strings", "pivot_links"])
def test_schemas(spark, relation):
    from gridspark import schemas

    got = getattr(relations, relation)(books(spark, a_xlsx=w.xlsx({"S": CELLS})))
    assert got.dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.schema(relation).fields]


def test_followers_find_their_anchor_across_chunks():
    from gridspark.sources.single import link_shared

    anchors = {}
    first = b"<row r='1'><c r='A1'><f t='shared' si='0'/></c><c r='B1'><f t=\"shared\" ref=\"B1:B9\" si=\"0\">A1&amp;&quot;x&quot;</f></c><c r=\"B2\"><f si='0' t='shared'/></c><c r='C1'><f>1+1</f></c></row>"
    out, used = link_shared(first, anchors)
    assert used == [{"n": 0, "cell": "B1", "body": 'A1&"x"'}] and out.count(b" anchor=") == 1 and b"<f anchor=\"0\" si='0'" in out
    again = b"<c r='B3'><f t='shared' si='0'></f></c><c r='D1'><f t='shared' ref='D1:D4' si='0'>A9</f></c><c r='D2'><f t='shared' si='0'/></c><c r='D3'><f t='shared' si='7'/></c>"
    out, used = link_shared(again, anchors)
    assert [(x["cell"], x["body"]) for x in used] == [("B1", 'A1&"x"'), ("D1", "A9")] and out.count(b" anchor=") == 2
    assert link_shared(b"<c r='A1'><f>1</f></c>", anchors) == (b"<c r='A1'><f>1</f></c>", [])


def test_two_streams_on_one_target(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.xlsx").write_bytes(w.xlsx({"S": [(0, 0, name)]}))
        ingest.stream_relation(ingest.workbook_stream(spark, str(tmp_path / name)), "cells", str(tmp_path / "out"), str(tmp_path / f"cp_{name}")).awaitTermination()
    assert {r.v_str for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"one", "two"}


def _source_books(folder):
    import pandas as pd

    from gridspark import workbook_queries as q

    orders = pd.DataFrame({"row_": [0, 1, 5, 250], "o_totalprice": [1.5, 2.0, 3.0, 4.0]})
    nation = pd.DataFrame({"n_name": ["PERU"], "n_nationkey": [17]})
    for form in ("xlsx", "xlsb"):
        made = {"formulas": (q._xlsx_formulas if form == "xlsx" else q._xlsb_formulas)(orders), "filters": q._filter_book(form)(nation), "pivots": q._pivot_book(form)(nation)}
        for name, content in made.items():
            (folder / name).mkdir(exist_ok=True)
            (folder / name / f"{name}.{form}").write_bytes(content)
    (folder / "m.xlsm").write_bytes(w.xlsx({"One": CELLS}, extra={"xl/vbaProject.bin": w.vba_project({"M": "x"})}))
    (folder / "bad.xlsx").write_bytes(b"no package")
    broken = w.xlsx({"S": [(0, 0, 1)]}, {"S": "<open>"})
    (folder / "broken.xlsx").write_bytes(broken)


def test_source_gives_the_rows_of_the_relations(spark, tmp_path):
    _source_books(tmp_path)
    workbook.register(spark)
    corpus = package.workbooks(spark, str(tmp_path))
    plain = lambda df: sorted(str(r.asDict(True)).replace("file://", "").replace("'file:", "'") for r in df.filter("path not like '%broken%'").collect())
    for entity in ("sheets", "cells", "formulas", "auto_filters", "pivot_tables", "vba_modules"):
        for size in ("1", str(workbook.TASK_BYTES)):
            got = spark.read.format("workbook").option("entity", entity).option("task_bytes", size).load(str(tmp_path))
            want = getattr(relations, entity)(corpus).select(*got.columns)
            assert plain(got) == plain(want) and want.count(), entity
    problems = {r.path.rpartition("/")[2] for r in spark.read.format("workbook").option("entity", "problems").load(f"file://{tmp_path}").collect()}
    assert problems == {"bad.xlsx", "broken.xlsx"}
    assert spark.read.format("workbook").option("entity", "cells").load(str(tmp_path)).rdd.getNumPartitions() == 1
