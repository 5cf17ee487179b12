"""Registered queries over workbooks made from the tables: table -> package bytes -> relation -> table.

Only this module needs the writers; the library reads without them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import relations
from .plans import generated, scrub
from .registry import query
from .session import table
from .sources import biff12, formula_tokens, package, vba
from .testing import writers


def _named(spark, root):
    """A key and a name: a workbook for every supplier."""
    return table(spark, root, "supplier").select(F.col("s_suppkey").cast("int").alias("n_nationkey"), F.col("s_name").alias("n_name"))


# ---- table -> workbook bytes -> relation ----


def _values(columns, form):
    def write(rows):
        return getattr(writers, form)({"Data": generated.grid_of(rows, "row_", columns), "Empty": []})

    return write


def _value_roundtrip(form):
    def run(spark, root):
        book, row = generated.row_in_book("s_suppkey")
        columns = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
        made = generated.books(table(spark, root, "supplier").withColumn("row_", row), book, "/made/{0}." + form, _values(columns, form))
        own = relations.cells(made)
        key = F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint") * generated.BOOK_ROWS + F.col("row")
        return own.select(key.alias("s_suppkey"), "sheet", "col", "addr", "kind", "v_int", "v_num", "v_str")

    return run


_VALUE_SQL = "WITH rows_ AS (SELECT *, CAST(s_suppkey % 5000 AS INT) AS row FROM supplier) " + " UNION ALL ".join(
    f"SELECT s_suppkey, 'Data' AS sheet, {k} AS col, chr({65 + k}) || CAST(row + 1 AS VARCHAR) AS addr, "
    + ("'str' AS kind, NULL::BIGINT AS v_int, NULL::DOUBLE AS v_num, s_name AS v_str" if c == "s_name" else f"CASE WHEN {c} = floor({c}) THEN 'int' ELSE 'float' END AS kind, CASE WHEN {c} = floor({c}) THEN CAST({c} AS BIGINT) END AS v_int, CAST({c} AS DOUBLE) AS v_num, NULL AS v_str")
    + f" FROM rows_ WHERE {c} IS NOT NULL" for k, c in enumerate(["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
)
for _form in ("xlsx", "xlsb"):
    query(f"{_form}_value_roundtrip", _VALUE_SQL)(_value_roundtrip(_form))


def _xlsx_formulas(rows):
    out = []
    for r, price in zip(rows["row_"].tolist(), rows["o_totalprice"].tolist()):
        first = r % 100 == 0
        out.append((r, 0, price, f"ROUND(B{r + 1},2)"))
        out.append((r, 2, price, {"t": "shared", "si": r // 100, "ref": f"C{r + 1}:C{r + 100}", "text": f'A{r + 1}*$B$1&"A1"'} if first else {"t": "shared", "si": r // 100}))
        if r % 1000 == 0:
            out.append((r, 3, 1, {"t": "array", "ref": f"D{r + 1}", "text": f"SUM(A{r + 1}:A{r + 2}*2)"}))
    return writers.xlsx({"Orders": out})


def _xlsb_formulas(rows):
    out = []
    for r, price in zip(rows["row_"].tolist(), rows["o_totalprice"].tolist()):
        code = writers.token_ref(r, 1) + writers.token_int(2) + writers.token_func(0x1B)
        out.append((r, 0, price, writers.parsed(code)))
        pending = writers.parsed(b"\x01" + (r - r % 100).to_bytes(4, "little"), (2).to_bytes(4, "little"))
        shared = writers.token_ref(0, -2, 0x4C) + b"\x44" + (0).to_bytes(4, "little") + (1).to_bytes(2, "little") + b"\x05" + writers.token_text("A1") + b"\x08"
        body = writers.record(biff12.SHARED_BODY, b"".join(x.to_bytes(4, "little") for x in (r, r + 99, 2, 2)) + writers.parsed(shared))
        out.append((r, 2, price, (pending, body) if r % 100 == 0 else pending))
        if r % 1000 == 0:
            code = writers.token_area(r, r + 1, 0, 0) + writers.token_int(2) + b"\x05" + writers.token_func(4, 1)
            body = writers.record(biff12.ARRAY_BODY, b"".join(x.to_bytes(4, "little") for x in (r, r, 3, 3)) + writers.parsed(code))
            out.append((r, 3, 1, (writers.parsed(b"\x01" + r.to_bytes(4, "little"), (3).to_bytes(4, "little")), body)))
    return writers.xlsb({"Orders": out})


def _formula_roundtrip(form, write):
    def run(spark, root):
        book, row = generated.row_in_book("o_orderkey")
        rows = table(spark, root, "orders").select("o_orderkey", "o_totalprice").withColumn("row_", row)
        made = generated.books(rows, book, "/made/{0}." + form, write)
        key = F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint") * generated.BOOK_ROWS + F.col("row")
        return relations.formulas(made).select(key.alias("o_orderkey"), "col", "formula", "formula_kind")

    return run


_FORMULA_SQL = """
WITH rows_ AS (SELECT o_orderkey, o_orderkey % 5000 AS r FROM orders), anchors AS (SELECT DISTINCT o_orderkey // 100 AS block FROM orders WHERE o_orderkey % 100 = 0)
SELECT o_orderkey, 0 AS col, '=ROUND(B' || CAST(r + 1 AS VARCHAR) || ',2)' AS formula, 'normal' AS formula_kind FROM rows_
UNION ALL SELECT o_orderkey, 2, '=A' || CAST(r + 1 AS VARCHAR) || '*$B$1&"A1"', 'shared' FROM rows_ WHERE o_orderkey // 100 IN (SELECT block FROM anchors)
UNION ALL SELECT o_orderkey, 2, '={shared_formula}', 'unresolved' FROM rows_ WHERE o_orderkey // 100 NOT IN (SELECT block FROM anchors)
UNION ALL SELECT o_orderkey, 3, '{=SUM(A' || CAST(r + 1 AS VARCHAR) || ':A' || CAST(r + 2 AS VARCHAR) || '*2)}', 'array' FROM rows_ WHERE r % 1000 = 0"""
query("xlsx_formula_roundtrip", _FORMULA_SQL)(_formula_roundtrip("xlsx", _xlsx_formulas))
query("xlsb_formula_roundtrip", _FORMULA_SQL)(_formula_roundtrip("xlsb", _xlsb_formulas))


def _filter_book(form):
    def write(rows):
        name, key = rows["n_name"].iloc[0], int(rows["n_nationkey"].iloc[0])
        if form == "xlsx":
            tail = (
                f'<autoFilter ref="A1:C{key + 2}"><filterColumn colId="0"><filters><filter val="{name}"/></filters></filterColumn>'
                f'<filterColumn colId="2"><customFilters and="1"><customFilter operator="greaterThan" val="{key}"/><customFilter val="x*"/></customFilters></filterColumn></autoFilter>'
            )
        else:
            tail = writers.filter_records((0, key + 1, 0, 2), [{"col_id": 0, "values": [name]}, {"col_id": 2, "logic": "and", "criteria": [(4, float(key)), (2, "x*")]}])
        return getattr(writers, form)({"Other": [], "Filtered": [(0, 0, name)]}, {"Filtered": tail})

    return write


def _filter_roundtrip(form):
    def run(spark, root):
        made = generated.books(_named(spark, root), F.col("n_nationkey"), "/made/{0}." + form, _filter_book(form))
        got = relations.auto_filters(made).select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("int").alias("n_nationkey"), "sheet", "ref", F.explode("columns").alias("c"))
        shown = F.transform("c.conditions", lambda x: F.concat_ws(" ", x["operator"], F.coalesce(x["v_str"], x["v_num"].cast("bigint").cast("string"))))
        return got.select("n_nationkey", "sheet", "ref", F.col("c.col_id").cast("bigint").alias("col_id"), F.col("c.type").alias("type"), F.col("c.logic").alias("logic"),
                          F.array_join(shown, "|").alias("conditions"), F.array_join("c.values", "|").alias("listed"))

    return run


_FILTER_SQL = """
SELECT n_nationkey, 'Filtered' AS sheet, 'A1:C' || CAST(n_nationkey + 2 AS VARCHAR) AS ref, 0::BIGINT AS col_id, 'discrete' AS type, NULL AS logic, NULL AS conditions, n_name AS listed FROM (SELECT CAST(s_suppkey AS INT) AS n_nationkey, s_name AS n_name FROM supplier)
UNION ALL SELECT n_nationkey, 'Filtered', 'A1:C' || CAST(n_nationkey + 2 AS VARCHAR), 2, 'custom', 'and', '> ' || CAST(n_nationkey AS VARCHAR) || '|= x*', NULL FROM (SELECT CAST(s_suppkey AS INT) AS n_nationkey, s_name AS n_name FROM supplier)"""
for _form in ("xlsx", "xlsb"):
    query(f"{_form}_filter_roundtrip", _FILTER_SQL)(_filter_roundtrip(_form))


def _pivot_book(form):
    def write(rows):
        name, key = rows["n_name"].iloc[0], int(rows["n_nationkey"].iloc[0])
        xml = (
            f'<pivotTableDefinition xmlns="{writers.MAIN}" name="{name}" cacheId="{key}" dataCaption="Values"><location ref="A3:D{key + 9}" firstHeaderRow="1" firstDataRow="2" firstDataCol="1" rowPageCount="1" colPageCount="1"/>'
            '<pivotFields count="2"><pivotField axis="axisRow"><items count="2"><item x="0"/><item t="default"/></items></pivotField><pivotField dataField="1"/></pivotFields>'
            f'<rowFields count="1"><field x="0"/></rowFields><colFields count="1"><field x="-2"/></colFields><dataFields count="1"><dataField name="Sum of {name}" fld="1"/></dataFields></pivotTableDefinition>'
        )
        le = lambda *xs: b"".join(x.to_bytes(4, "little") for x in xs)
        raw = writers.record(biff12.SX_VIEW, b"\0" * 28 + le(key) + writers.wide(name) + writers.wide("Values"))
        raw += writers.record(biff12.SX_LOCATION, le(2, key + 8, 0, 3, 0, 1, 1, 1, 1))
        raw += writers.record(biff12.SX_FIELD) + writers.record(biff12.SX_ITEM) * 2 + writers.record(biff12.SX_FIELD)
        end = {"xlsx": "xml", "xlsb": "bin"}[form]
        extra = {
            f"xl/worksheets/_rels/sheet1.{end}.rels": writers.rels_xml({"rId1": f"../pivotTables/p1.{end}"}), f"xl/pivotTables/p1.{end}": xml if form == "xlsx" else raw,
            f"xl/pivotTables/_rels/p1.{end}.rels": writers.rels_xml({"rId1": f"../pivotCache/pivotCacheDefinition1.{end}"}),
        }
        return getattr(writers, form)({"Pivot": [(0, 0, name)]}, extra=extra)

    return write


def _pivot_roundtrip(form):
    def run(spark, root):
        made = generated.books(_named(spark, root), F.col("n_nationkey"), "/made/{0}." + form, _pivot_book(form))
        return relations.pivot_tables(made).select(
            F.col("cache_id").alias("n_nationkey"), "name", "sheet", "data_caption", F.regexp_replace("part", r"\.\w+$", "").alias("part"),
            F.regexp_replace("pivot_cache_definition", r"\.\w+$", "").alias("cache"), "pivot_fields", "pivot_items",
            F.concat_ws(":", "location.rfx_geom.top_left", "location.rfx_geom.bottom_right").alias("body"), F.size("data_fields").alias("n_data"),
        )

    return run


_PIVOT_SQL = """
SELECT n_nationkey, n_name AS name, 'Pivot' AS sheet, 'Values' AS data_caption, 'xl/pivotTables/p1' AS part, 'xl/pivotCache/pivotCacheDefinition1' AS cache, 2 AS pivot_fields, 2 AS pivot_items,
  'A3:D' || CAST(n_nationkey + 9 AS VARCHAR) AS body, {n} AS n_data FROM (SELECT CAST(s_suppkey AS INT) AS n_nationkey, s_name AS n_name FROM supplier)"""
query("pivot_meta_roundtrip", _PIVOT_SQL.format(n=1))(_pivot_roundtrip("xlsx"))
query("pivot_meta_roundtrip_xlsb", _PIVOT_SQL.format(n=0))(_pivot_roundtrip("xlsb"))


@query("defined_names_roundtrip", "SELECT n_nationkey, f AS format, CAST(1 AS INT) AS idx, 'name_' || n_name AS name FROM (SELECT CAST(s_suppkey AS INT) AS n_nationkey, s_name AS n_name FROM supplier), (SELECT unnest(['xlsx', 'xlsb']) AS f)")
def defined_names_roundtrip(spark, root):
    def book(form):
        def write(rows):
            name = f"name_{rows['n_name'].iloc[0]}"
            return getattr(writers, form)({"S": []}, names={name: "S!$A$1"} if form == "xlsx" else [name])

        return generated.books(_named(spark, root), F.col("n_nationkey"), "/made/{0}." + form, write)

    return relations.defined_names(book("xlsx").unionByName(book("xlsb"))).select(
        F.regexp_extract("path", r"/(\d+)\.", 1).cast("int").alias("n_nationkey"), F.element_at(F.split("path", r"\."), -1).alias("format"), "idx", "name"
    )


@query("shared_strings_roundtrip", "SELECT DISTINCT c_nationkey, f AS format, c_name AS text FROM customer, (SELECT unnest(['xlsx', 'xlsb']) AS f)")
def shared_strings_roundtrip(spark, root):
    rows = table(spark, root, "customer").select("c_nationkey", "c_name", F.pmod("c_custkey", F.lit(100000)).cast("int").alias("row_"))

    def book(form):
        return generated.books(rows, F.col("c_nationkey"), "/made/{0}." + form, lambda own: getattr(writers, form)({"S": generated.grid_of(own, "row_", ["c_name"])}))

    return relations.shared_strings(book("xlsx").unionByName(book("xlsb"))).select(
        F.regexp_extract("path", r"/(\d+)\.", 1).cast("int").alias("c_nationkey"), F.element_at(F.split("path", r"\."), -1).alias("format"), "text"
    )


@query("relationships", "SELECT n_nationkey, 'rId1' AS rel_id, 'worksheets/sheet1.xml' AS target, 'xl/worksheets/sheet1.xml' AS resolved FROM (SELECT CAST(s_suppkey AS INT) AS n_nationkey, s_name AS n_name FROM supplier) UNION ALL SELECT n_nationkey, 'p', '../pivotTables/p' || CAST(n_nationkey AS VARCHAR) || '.xml', 'xl/pivotTables/p' || CAST(n_nationkey AS VARCHAR) || '.xml' FROM (SELECT CAST(s_suppkey AS INT) AS n_nationkey, s_name AS n_name FROM supplier)")
def relationships(spark, root):
    def write(rows):
        return writers.xlsx({"S": []}, extra={"xl/worksheets/_rels/sheet1.xml.rels": writers.rels_xml({"p": f"../pivotTables/p{rows['n_nationkey'].iloc[0]}.xml"})})

    made = generated.books(_named(spark, root), F.col("n_nationkey"), "/made/{0}.xlsx", write)
    return package.rels(package.parts(made, r"\.rels$")).select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("int").alias("n_nationkey"), "rel_id", "target", "resolved")


@query("decompile", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '=ROUND(A' || CAST(p_size AS VARCHAR) || ',' || CAST(p_size AS VARCHAR) || ')' WHEN 1 THEN '=IF($B$' || CAST(p_size AS VARCHAR) || '>1,"' || p_brand || '",)'
  WHEN 2 THEN '=-(' || CAST(p_size AS VARCHAR) || '+0.5)%' WHEN 3 THEN '=SUM(C1:D' || CAST(p_size AS VARCHAR) || ')&TRUE' ELSE '=#N/A' END AS formula FROM part""")
def decompile(spark, root):
    @F.udf("string", useArrow=True)
    def text(key, size, brand):
        w = writers
        code = {
            0: lambda: w.token_ref(size - 1, 0) + w.token_int(size) + w.token_func(0x1B),
            1: lambda: w.token_ref(size - 1, 1, relative=False) + w.token_int(1) + b"\x0d" + w.token_text(brand) + b"\x16" + w.token_func(1, 3),
            2: lambda: w.token_int(size) + w.token_number(0.5) + b"\x03\x15\x13\x14", 3: lambda: w.token_area(0, size - 1, 2, 3) + b"\x19\x10\0\0" + b"\x1d\x01\x08", 4: lambda: b"\x1c\x2a",
        }[key % 5]()
        return formula_tokens.decompile(code, b"", 0, 0, formula_tokens.Names())[0]

    return table(spark, root, "part").select("p_partkey", text("p_partkey", "p_size", "p_brand").alias("formula"))


@query("sheet_filter", "SELECT 'region' AS sheet, CAST(r_regionkey AS INT) AS row, r_name AS v_str FROM region")
def sheet_filter(spark, root):
    both = table(spark, root, "nation").select(F.lit("nation").alias("t"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")).unionByName(
        table(spark, root, "region").select(F.lit("region").alias("t"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("n")))

    def write(rows):
        return writers.xlsx({t: generated.grid_of(own, "k", ["n"]) for t, own in rows.groupby("t")})

    return relations.cells(generated.books(both, F.lit(0), "/made/{0}.xlsx", write), "region").select("sheet", "row", "v_str")


@query("vba_modules_roundtrip", "SELECT DISTINCT path, CAST(module_id AS VARCHAR) AS module, vba_source_text AS source FROM vba_modules WHERE vba_source_text IS NOT NULL")
def vba_modules_roundtrip(spark, root):
    rows = table(spark, root, "vba_modules").select("path", "module_id", F.col("vba_source_text").alias("text")).filter("text is not null").distinct()

    def write(own):
        return writers.xlsx({"S": []}, extra={"xl/vbaProject.bin": writers.vba_project({str(m): t for m, t in zip(own["module_id"], own["text"])}, 65001)})

    # modules of a workbook are dealt over workbooks of bounded size
    book = F.concat_ws("#", "path", F.floor(F.col("module_id") / 500))
    made = generated.books(rows, book, "{0}.xlsm", write)
    return relations.vba_modules(made).select(F.element_at(F.split("path", "#"), 1).alias("path"), "module", "source")


@query("ovba_roundtrip", "SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL")
def ovba_roundtrip(spark, root):
    @F.pandas_udf("string")
    def there_and_back(texts):
        return texts.map(lambda t: vba.decompress(writers.compress(t.encode())).decode())

    return table(spark, root, "documents").select("doc_id", "text").filter("text is not null").distinct().select("doc_id", there_and_back("text").alias("text"))


@query("metadata_scrub", "SELECT n_nationkey, '<a><lastModifiedBy></lastModifiedBy><Application></Application><title>' || n_name || '</title></a>' AS core FROM (SELECT CAST(s_suppkey AS INT) AS n_nationkey, s_name AS n_name FROM supplier)")
def metadata_scrub(spark, root):
    def write(rows):
        name = rows["n_name"].iloc[0]
        return writers.xlsx({"S": [(0, 0, name)]}, extra={"docProps/core.xml": f"<a><lastModifiedBy>{name}</lastModifiedBy><Application>x</Application><title>{name}</title></a>"})

    made = generated.books(_named(spark, root), F.col("n_nationkey"), "/made/{0}.xlsx", write)
    found = package.parts(scrub.strip_metadata(made), r"^docprops/core\.xml$")
    return found.select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("int").alias("n_nationkey"), F.col("text").alias("core"))


@query("record_framing", "SELECT p_partkey, CAST(p_size AS INT) AS rec_type, p_name AS payload FROM part")
def record_framing(spark, root):
    book, _ = generated.row_in_book("p_partkey")

    def write(rows):
        parts = {f"xl/p{k}.bin": writers.record(int(t), n.encode()) for k, t, n in zip(rows["p_partkey"], rows["p_size"], rows["p_name"])}
        return writers.package(parts)

    made = generated.books(table(spark, root, "part"), book, "/made/{0}.xlsb", write)
    return biff12.record_table(package.parts(made)).select(F.regexp_extract("part", r"(\d+)", 1).cast("bigint").alias("p_partkey"), "rec_type", F.decode("payload", "UTF-8").alias("payload"))
