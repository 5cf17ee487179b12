"""The registered queries of the core, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import cells
from .operators import evaluate, relations, shred
from .plans import render
from .registry import ORACLES, QUERIES, Query, query  # noqa: F401
from .session import table
from .sources import biff12, ooxml

def _tree(spark: SparkSession, root: str) -> DataFrame:
    return shred.nodes(shred.workbook_records(*(table(spark, root, t) for t in ("auto_filters", "pivot_tables", "raw_records"))))


def _plain(x: str) -> str:
    """SQL of a JSON value, or of what it holds as JSON text."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND left(ltrim({x}->>'$'), 1) IN ('{{', '[') AND json_valid({x}->>'$') THEN CAST({x}->>'$' AS JSON) ELSE {x} END"


def _listed(x: str) -> str:
    """SQL of a JSON value as a list: a lone value is a list of one."""
    p = _plain(x)
    return f"CASE coalesce(json_type({p}), 'NULL') WHEN 'ARRAY' THEN CAST({p} AS JSON[]) WHEN 'NULL' THEN CAST([] AS JSON[]) ELSE [{p}] END"


def _elements(name: str, source: str, keys: str, x: str, objects: bool = True) -> str:
    """SQL of a CTE with the elements of a list, their position ``k`` and value ``e``."""
    e = _plain("l[k + 1]") if objects else "l[k + 1]"
    kept = "json_type(e) = 'OBJECT'" if objects else "e IS NOT NULL AND json_type(e) <> 'NULL'"
    return (
        f"{name} AS (SELECT * FROM (SELECT {keys}, k, {e} AS e FROM (SELECT {keys}, l, unnest(range(len(l))) AS k FROM "
        f"(SELECT {keys}, {_listed(x)} AS l FROM {source}))) WHERE {kept})"
    )


_CHILD_SQL = f"""
WITH r AS (
  SELECT DISTINCT 'auto_filters' AS src, filter_id AS rec_id, CAST(json_object('columns', to_json(columns)) AS JSON) AS p FROM auto_filters
  UNION SELECT DISTINCT 'pivot_tables', pivot_id, CAST(json_object('location', to_json(location), 'data_fields', to_json(data_fields), 'report_filters', to_json(report_filters), 'sx_filters', to_json(sx_filters)) AS JSON) FROM pivot_tables
  UNION SELECT DISTINCT 'raw_records', rec_id, CAST(payload AS JSON) FROM raw_records WHERE json_valid(payload)),
{_elements("c", "r", "src, rec_id", "(p->'columns')")},
cc AS (SELECT src, rec_id, k AS parent, e AS c FROM c),
{_elements("d", "cc", "src, rec_id, parent", "(c->'conditions')")},
cf AS (SELECT src, rec_id, parent, {_plain("(c->'custom_filters')")} AS f FROM cc),
{_elements("u", "cf", "src, rec_id, parent", "(f->'criteria')")},
{_elements("v", "cc", "src, rec_id, parent", "(c->'values')", False)},
{_elements("w", "cc", "src, rec_id, parent", "(c->'filters')", False)},
{_elements("df", "r", "src, rec_id", "(p->'data_fields')")}, {_elements("rf", "r", "src, rec_id", "(p->'report_filters')")}, {_elements("sf", "r", "src, rec_id", "(p->'sx_filters')")},
ss AS (SELECT src, rec_id, k AS parent, e AS c FROM sf), {_elements("sc", "ss", "src, rec_id, parent", "(c->'criteria')")},
lo AS (SELECT src, rec_id, {_plain("(p->'location')")} AS l FROM r), ge AS (SELECT src, rec_id, l, {_plain("(l->'rfx_geom')")} AS g FROM lo),
found AS (
  SELECT src, rec_id, 'column' AS child, -1 AS parent_pos, k AS pos FROM c
  UNION SELECT src, rec_id, 'condition', parent, k FROM d UNION SELECT src, rec_id, 'condition', parent, k FROM u
  UNION SELECT src, rec_id, 'value', parent, k FROM v UNION SELECT src, rec_id, 'value', parent, k FROM w
  UNION SELECT src, rec_id, 'data_field', -1, k FROM df UNION SELECT src, rec_id, 'report_filter', -1, k FROM rf UNION SELECT src, rec_id, 'sx_filter', -1, k FROM sf
  UNION SELECT src, rec_id, 'criterion', parent, k FROM sc
  UNION SELECT src, rec_id, 'location', -1, 0 FROM lo WHERE json_type(l) = 'OBJECT' UNION SELECT src, rec_id, 'rfx_geom', 0, 0 FROM ge WHERE json_type(l) = 'OBJECT' AND json_type(g) = 'OBJECT')
"""


@query("p2_found", _CHILD_SQL + "SELECT src, rec_id, child, CAST(parent_pos AS INT) AS parent_pos, CAST(pos AS INT) AS pos FROM found")
def p2_found(spark, root):
    return shred.children(_tree(spark, root)).select("src", "rec_id", "child", "parent_pos", "pos").distinct()


@query("p2_nodes")
def p2_nodes(spark, root):
    return _tree(spark, root)


#: Entity tables: child -> columns and types.
ENTITIES = {
    "column": {"col_id": "int", "column_index": "int", "type": "string"},
    "condition": {"operator": "string", "kind": "string", "v_num": "double", "v_str": "string", "v_bool": "boolean", "val": "string", "value": "string"},
    "location": {"rw_first_head": "int", "rw_first_data": "int", "col_first_data": "string", "page_rows": "int", "page_cols": "int"},
    "rfx_geom": {"top_left": "string", "bottom_right": "string"},
    "data_field": {"name": "string", "fld": "int", "subtotal": "string"},
    "report_filter": {"fld": "int", "type": "string"},
    "sx_filter": {"field_index": "int", "filter_type": "int"},
    "criterion": {"operator": "string", "kind": "string", "v_num": "double", "v_str": "string", "v_bool": "boolean", "value": "string"},
}


def _entity(child: str) -> Query:
    def run(spark, root):
        return shred.entities(_tree(spark, root), child, ENTITIES[child])

    return run


#: SQL of the elements of an entity: parent's position, own position, object.
_ELEMENTS = {
    "column": "SELECT src, rec_id, -1 AS a, k AS b, e FROM c",
    "condition": "SELECT src, rec_id, parent AS a, k AS b, e FROM d UNION ALL SELECT src, rec_id, parent, k, e FROM u",
    "location": "SELECT src, rec_id, -1 AS a, 0 AS b, l AS e FROM lo WHERE json_type(l) = 'OBJECT'",
    "rfx_geom": "SELECT src, rec_id, 0 AS a, 0 AS b, g AS e FROM ge WHERE json_type(l) = 'OBJECT' AND json_type(g) = 'OBJECT'",
    "data_field": "SELECT src, rec_id, -1 AS a, k AS b, e FROM df", "report_filter": "SELECT src, rec_id, -1 AS a, k AS b, e FROM rf",
    "sx_filter": "SELECT src, rec_id, -1 AS a, k AS b, e FROM sf", "criterion": "SELECT src, rec_id, parent AS a, k AS b, e FROM sc",
}


def _entity_sql(child: str) -> str:
    fields = ", ".join(f"TRY_CAST(e->>'{n}' AS {'VARCHAR' if t == 'string' else t}) AS {n}" for n, t in ENTITIES[child].items())
    return _CHILD_SQL + f"SELECT DISTINCT src, rec_id, CAST(a AS INT) AS parent_pos, CAST(b AS INT) AS pos, {fields} FROM ({_ELEMENTS[child]})"


for _child in ENTITIES:
    query(f"p2_{_child}s", _entity_sql(_child))(_entity(_child))


# ---- addresses, numbers, paths: expressions ----


@query("col_to_letter", """
SELECT o_orderkey, (CASE WHEN c >= 702 THEN chr(CAST(65 + (c - 702) // 676 AS INT)) ELSE '' END) || (CASE WHEN c >= 26 THEN chr(CAST(65 + ((c - 26) // 26) % 26 AS INT)) ELSE '' END)
  || chr(CAST(65 + c % 26 AS INT)) AS letters FROM (SELECT o_orderkey, o_orderkey % 16384 AS c FROM orders)""")
def col_to_letter(spark, root):
    return table(spark, root, "orders").select("o_orderkey", cells.column_letters(F.pmod("o_orderkey", F.lit(16384))).alias("letters"))


@query("letter_to_col", "SELECT o_orderkey, CAST(o_orderkey % 16384 AS BIGINT) AS col FROM orders")
def letter_to_col(spark, root):
    letters = cells.column_letters(F.pmod("o_orderkey", F.lit(16384)))
    return table(spark, root, "orders").select("o_orderkey", cells.column_index(letters).cast("bigint").alias("col"))


@query("cell_address", """
SELECT l_orderkey, l_linenumber, (CASE WHEN c >= 702 THEN chr(CAST(65 + (c - 702) // 676 AS INT)) ELSE '' END) || (CASE WHEN c >= 26 THEN chr(CAST(65 + ((c - 26) // 26) % 26 AS INT)) ELSE '' END)
  || chr(CAST(65 + c % 26 AS INT)) || CAST(l_orderkey % 1048576 + 1 AS VARCHAR) AS addr FROM (SELECT *, l_partkey % 16384 AS c FROM lineitem)""")
def cell_address(spark, root):
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", cells.address(F.pmod("l_orderkey", F.lit(cells.MAX_ROWS)), F.pmod("l_partkey", F.lit(cells.MAX_COLS))).alias("addr")
    )


@query("address_parts", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 1048576 AS BIGINT) AS row, CAST(l_partkey % 16384 AS BIGINT) AS col FROM lineitem")
def address_parts(spark, root):
    named = cell_address(spark, root)
    return named.select("l_orderkey", "l_linenumber", cells.row_of("addr").cast("bigint").alias("row"), cells.col_of("addr").cast("bigint").alias("col"))


@query("rk_decode", """
SELECT l_orderkey, l_linenumber, CAST(l_partkey - 10000 AS DOUBLE) AS whole, CAST(l_partkey - 10000 AS DOUBLE) / 100 AS cents, pow(2::DOUBLE, l_linenumber) AS real FROM lineitem""")
def rk_decode(spark, root):
    n = F.pmod(F.col("l_partkey") - 10000, F.lit(1 << 30)).cast("bigint")
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", cells.rk_number(n * 4 + 2).alias("whole"), cells.rk_number(n * 4 + 3).alias("cents"),
        cells.rk_number((F.col("l_linenumber").cast("bigint") + 1023) * (1 << 20)).alias("real"),
    )


@query("rel_wrap", """
SELECT o_orderkey, CAST(((o_orderkey * 7 + o_custkey % 2000000 - 1000000) % 1048576 + 1048576) % 1048576 AS BIGINT) AS row, CAST(((o_custkey % 16384 - 9000) % 16384 + 16384) % 16384 AS BIGINT) AS col FROM orders""")
def rel_wrap(spark, root):
    return table(spark, root, "orders").select(
        "o_orderkey", cells.wrap_row(F.col("o_orderkey") * 7, F.col("o_custkey") % 2000000 - 1000000).alias("row"), cells.wrap_col(F.col("o_custkey") % 16384, F.lit(-9000)).alias("col")
    )


@query("error_text", """
SELECT event_id, CASE event_id % 64 WHEN 0 THEN '#NULL!' WHEN 7 THEN '#DIV/0!' WHEN 15 THEN '#VALUE!' WHEN 23 THEN '#REF!' WHEN 29 THEN '#NAME?' WHEN 36 THEN '#NUM!' WHEN 42 THEN '#N/A'
  WHEN 43 THEN '#GETTING_DATA' ELSE '#ERR' END AS text FROM events""")
def error_text(spark, root):
    return table(spark, root, "events").select("event_id", cells.error_text(F.col("event_id") % 64).alias("text"))


_NUMBER_TEXT = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_partkey AS {s}) WHEN 2 THEN concat('-', CAST(p_size AS {s}), '.5') WHEN 3 THEN concat(' ', CAST(p_size AS {s}), ' ') WHEN 4 THEN '1e400' ELSE concat(CAST(p_size AS {s}), 'e3') END"


@query("number_typing", """
SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 4) THEN 'str' WHEN p_partkey % 6 = 2 THEN 'float' ELSE 'int' END AS kind,
  CASE p_partkey % 6 WHEN 1 THEN p_partkey WHEN 3 THEN CAST(p_size AS BIGINT) WHEN 5 THEN CAST(p_size AS BIGINT) * 1000 END AS v_int,
  CASE p_partkey % 6 WHEN 1 THEN CAST(p_partkey AS DOUBLE) WHEN 2 THEN -p_size - 0.5::DOUBLE WHEN 3 THEN CAST(p_size AS DOUBLE) WHEN 5 THEN p_size * 1000::DOUBLE END AS v_num FROM part""")
def number_typing(spark, root):
    kind, v_int, v_num = cells.typed_number(F.expr(_NUMBER_TEXT.format(s="STRING")))
    return table(spark, root, "part").select("p_partkey", kind.alias("kind"), v_int.alias("v_int"), v_num.alias("v_num"))


@query("path_resolve", """
SELECT n_nationkey, 'xl/pivotTables/' || n_name || '.xml' AS up, 'xl/worksheets/' || n_name AS beside, 'xl/media/' || n_name AS absolute FROM nation""")
def path_resolve(spark, root):
    sheet = F.concat(F.lit("xl/worksheets/"), "n_name", F.lit(".xml"))
    return table(spark, root, "nation").select(
        "n_nationkey", cells.resolve_path(sheet, F.concat(F.lit("../pivotTables/./"), "n_name", F.lit(".xml"))).alias("up"),
        cells.resolve_path(sheet, F.concat(F.lit("x/../"), "n_name")).alias("beside"), cells.resolve_path(sheet, F.concat(F.lit("/xl/media/"), "n_name")).alias("absolute"),
    )


@query("format_detect", "SELECT DISTINCT path, CASE WHEN lower(path) LIKE '%.xlsx' OR lower(path) LIKE '%.xlsm' THEN 'xlsx' ELSE 'xlsb' END AS format FROM sheets")
def format_detect(spark, root):
    return table(spark, root, "sheets").select("path", cells.package_format("path").alias("format")).distinct()


@query("varint_decode", "SELECT p_partkey, CAST(p_partkey * 37 AS BIGINT) AS value FROM part")
def varint_decode(spark, root):
    v = F.col("p_partkey") * 37
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    raw = F.unhex(F.concat(byte(v.bitwiseAND(127).bitwiseOR(128)), byte(F.shiftright(v, 7).bitwiseAND(127).bitwiseOR(128)), byte(F.shiftright(v, 14).bitwiseAND(127))))
    return table(spark, root, "part").select("p_partkey", cells.varint(raw).alias("value"))


@query("serial_dates", "SELECT o_orderkey, date_diff('microsecond', TIMESTAMP '1899-12-30', o_orderdate) / 86400000000.0::DOUBLE AS serial, CAST(o_orderdate AS VARCHAR) AS back FROM orders")
def serial_dates(spark, root):
    serial = cells.timestamp_to_serial("o_orderdate")
    return table(spark, root, "orders").select("o_orderkey", serial.alias("serial"), F.date_format(cells.serial_to_timestamp(serial), "yyyy-MM-dd HH:mm:ss").alias("back"))


# ---- the sparse grid, and the joins hidden in it ----

_GRID = {"l_orderkey": 0, "l_quantity": 1, "l_extendedprice": 2, "l_returnflag": 3, "l_linestatus": 4}
_GRID_SQL = " UNION ALL ".join(
    f"SELECT row, {k} AS col, chr({65 + k}) || CAST(row + 1 AS VARCHAR) AS addr, "
    + (f"'str' AS kind, NULL::BIGINT AS v_int, NULL::DOUBLE AS v_num, {c} AS v_str" if k > 2 else f"CASE WHEN {c} = floor({c}) THEN 'int' ELSE 'float' END AS kind, CASE WHEN {c} = floor({c}) THEN CAST({c} AS BIGINT) END AS v_int, CAST({c} AS DOUBLE) AS v_num, NULL AS v_str")
    + f" FROM rows_ WHERE {c} IS NOT NULL" for c, k in _GRID.items()
)


@query("grid_to_cells", f"WITH rows_ AS (SELECT *, CAST(l_orderkey * 8 + l_linenumber AS INT) AS row FROM lineitem) {_GRID_SQL}")
def grid_to_cells(spark, root):
    return relations.to_cells(table(spark, root, "lineitem"), "book", "Lines", "l_orderkey * 8 + l_linenumber", _GRID).select("row", "col", "addr", "kind", "v_int", "v_num", "v_str")


@query("cells_to_grid", "SELECT CAST(n_nationkey AS INT) AS row, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def cells_to_grid(spark, root):
    own = relations.to_cells(table(spark, root, "nation"), "book", "Nations", "n_nationkey", {"n_nationkey": 0, "n_name": 1, "n_regionkey": 2})
    return relations.grid(own, {0: "n_nationkey", 1: "n_name", 2: "n_regionkey"}).select("row", "n_nationkey", "n_name", "n_regionkey")


@query("sst_build", "SELECT DISTINCT c_nationkey, c_mktsegment AS text, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS INT) AS idx FROM customer")
def sst_build(spark, root):
    texts = table(spark, root, "customer").select("c_nationkey", F.col("c_mktsegment").alias("text")).distinct()
    return texts.withColumn("idx", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("text")) - 1)


@query("sst_resolve", """
WITH s AS (SELECT DISTINCT c_nationkey, c_mktsegment AS text, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS idx FROM customer)
SELECT c_custkey, coalesce(text, '') AS text FROM customer c LEFT JOIN s ON s.c_nationkey = c.c_nationkey AND s.idx = c.c_custkey % 7""")
def sst_resolve(spark, root):
    rows = table(spark, root, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 7).cast("int").alias("idx"))
    return relations.lookup(rows, sst_build(spark, root), ["c_nationkey", "idx"]).select("c_custkey", "text")


@query("shared_formula_asof", """
SELECT o_orderkey, CASE WHEN a IS NULL THEN '={shared_formula}' ELSE '=A' || CAST(o_orderkey % 1000000 + 1 AS VARCHAR) || '+$B$1*LOG10(' || CAST(a AS VARCHAR) || ')&"A1"' END AS formula,
  CASE WHEN a IS NULL THEN 'unresolved' ELSE 'shared' END AS formula_kind
FROM (SELECT *, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS a FROM orders)""")
def shared_formula_asof(spark, root):
    row = F.pmod("o_orderkey", F.lit(1000000)).cast("int")
    anchor = F.col("o_orderkey") % 3 == 0
    body = F.concat(F.lit("A"), (row + 1).cast("string"), F.lit("+$B$1*LOG10("), F.col("o_orderkey").cast("string"), F.lit(')&"A1"'))
    raw = table(spark, root, "orders").select(
        F.col("o_custkey").cast("string").alias("path"), F.lit(0).alias("sheet_idx"), F.lit("S").alias("sheet"), row.alias("row"), F.lit(2).alias("col"),
        F.col("o_orderkey").alias("seq"), F.lit("shared").alias("t"), F.lit("0").alias("si"), F.when(anchor, "C1:C9").alias("ref"), F.lit(None).cast("string").alias("ca"),
        F.when(anchor, body).alias("body"),
    )
    return ooxml.resolve_shared(raw).select(F.col("seq").alias("o_orderkey"), "formula", "formula_kind")


@query("shared_formula_range", """
WITH c AS (SELECT DISTINCT l_suppkey % 1000 AS book, CAST(l_partkey % 1000 AS INT) AS row, CAST(l_linenumber AS INT) AS col FROM lineitem),
b AS (SELECT p_partkey % 1000 AS book, p_size * 10 AS r1, p_size * 10 + 60 AS r2, p_partkey AS seq, p_name FROM part)
SELECT c.book, c.row, c.col, b.p_name AS body FROM c LEFT JOIN b ON c.book = b.book AND c.row BETWEEN b.r1 AND b.r2 AND c.col BETWEEN 2 AND 5
QUALIFY row_number() OVER (PARTITION BY c.book, c.row, c.col ORDER BY b.seq) = 1""")
def shared_formula_range(spark, root):
    pending = table(spark, root, "lineitem").select(
        (F.col("l_suppkey") % 1000).alias("book"), (F.col("l_partkey") % 1000).cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col")
    ).distinct()
    bodies = table(spark, root, "part").select(
        (F.col("p_partkey") % 1000).alias("book"), (F.col("p_size") * 10).alias("row"), (F.col("p_size") * 10 + 60).alias("last_row"), F.lit(2).alias("col"), F.lit(5).alias("last_col"),
        F.col("p_partkey").alias("seq"), F.encode("p_name", "UTF-8").alias("code"), F.lit(None).cast("binary").alias("extra"), F.lit(False).alias("array"),
    )
    return biff12.resolve_rectangles(pending, bodies, ["book"]).select("book", "row", "col", F.decode("body.code", "UTF-8").alias("body"))


@query("last_write_wins", """
SELECT path, sheet_idx, row_idx, col_idx, kind, v_int, v_num, v_str, v_bool, v_err FROM cells
QUALIFY row_number() OVER (PARTITION BY path, sheet_idx, row_idx, col_idx ORDER BY seq DESC) = 1""")
def last_write_wins(spark, root):
    key, rest = ["path", "sheet_idx", "row_idx", "col_idx"], ["kind", "v_int", "v_num", "v_str", "v_bool", "v_err"]
    return relations.last_write_wins(table(spark, root, "cells").select(*key, *rest, "seq"), key, "seq").drop("seq")


@query("sheet_inventory", "SELECT path, sheet_idx, min(sheet) AS sheet, max(lower(part)) AS part, CAST(count(DISTINCT part) AS BIGINT) AS n_names FROM sheets GROUP BY path, sheet_idx")
def sheet_inventory(spark, root):
    return table(spark, root, "sheets").groupBy("path", "sheet_idx").agg(F.min("sheet").alias("sheet"), F.max(F.lower("part")).alias("part"), F.count_distinct("part").alias("n_names"))


@query("cell_profile", """
SELECT sheet, kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT path) AS BIGINT) AS books, CAST(sum(v_int) AS BIGINT) AS total, min(v_num) AS low, max(v_num) AS high FROM
(SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY path, sheet_idx, row_idx, col_idx ORDER BY seq DESC) = 1) GROUP BY sheet, kind""")
def cell_profile(spark, root):
    key = ["path", "sheet_idx", "row_idx", "col_idx"]
    own = relations.last_write_wins(table(spark, root, "cells").select(*key, "sheet", "kind", "v_int", "v_num", "seq"), key, "seq")
    return own.groupBy("sheet", "kind").agg(F.count("*").alias("n"), F.count_distinct("path").alias("books"), F.sum("v_int").alias("total"), F.min("v_num").alias("low"), F.max("v_num").alias("high"))


@query("link_traversal", """
SELECT n_name, c_custkey, o_orderkey AS first_order, o_orderstatus FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) = 1""")
def link_traversal(spark, root):
    first = table(spark, root, "orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("o"))
    linked = table(spark, root, "customer").join(first, F.col("c_custkey") == F.col("o_custkey")).join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return linked.select("n_name", "c_custkey", F.col("o.o_orderkey").alias("first_order"), "o.o_orderstatus")


# ---- filters and pivots, evaluated ----


_LIKE = "replace(replace(replace(replace(replace(lower({p}), '\\', '\\\\'), '%', '\\%'), '_', '\\_'), '*', '%'), '?', '_')"
_VISIBLE_SQL = rf"""
WITH v AS (
  SELECT path, sheet_idx, row_idx AS r, col_idx AS c, v_num, v_str, v_bool, coalesce(v_str, v_err, CAST(v_int AS VARCHAR), upper(CAST(v_bool AS VARCHAR))) AS shown,
    (v_num IS NULL AND v_bool IS NULL AND v_err IS NULL AND coalesce(v_str, '') = '') AS empty
  FROM cells QUALIFY row_number() OVER (PARTITION BY path, sheet_idx, row_idx, col_idx ORDER BY seq DESC) = 1),
a AS (
  SELECT filter_id, path, sheet_idx, columns, CAST(regexp_extract(top_left, '[0-9]+') AS INT) - 1 AS r1, CAST(regexp_extract(bottom_right, '[0-9]+') AS INT) - 1 AS r2,
    list_reduce(list_transform(string_split(regexp_extract(top_left, '[A-Z]+'), ''), lambda x: ascii(x) - 64), lambda x, y: x * 26 + y) - 1 AS c1,
    list_reduce(list_transform(string_split(regexp_extract(bottom_right, '[A-Z]+'), ''), lambda x: ascii(x) - 64), lambda x, y: x * 26 + y) - 1 AS c2
  FROM (SELECT DISTINCT ON (filter_id) * FROM auto_filters)),
w AS (SELECT DISTINCT filter_id, a.path, a.sheet_idx, c1, r FROM a JOIN v ON v.path = a.path AND v.sheet_idx = a.sheet_idx AND r BETWEEN r1 + 1 AND r2 AND c BETWEEN c1 AND c2),
s AS (SELECT filter_id, k, columns[k] AS f FROM (SELECT filter_id, columns, unnest(range(1, len(columns) + 1)) AS k FROM a)),
x AS (
  SELECT w.filter_id, w.r, k, f, v_num, v_str, v_bool, shown, coalesce(empty, true) AS empty, f.attrs['val'] AS n, coalesce(f.attrs['percent'], '0') IN ('1', 'true') AS share,
    coalesce(f.attrs['top'], '1') NOT IN ('0', 'false') AS top
  FROM w JOIN s USING (filter_id) LEFT JOIN v ON v.path = w.path AND v.sheet_idx = w.sheet_idx AND v.r = w.r AND v.c = c1 + f.col_id),
y AS (
  SELECT *, avg(v_num) OVER g AS mean, count(v_num) OVER g AS numbers, rank() OVER (PARTITION BY filter_id, k ORDER BY CASE WHEN top THEN -v_num ELSE v_num END NULLS LAST) AS rk
  FROM x WINDOW g AS (PARTITION BY filter_id, k)),
t AS (
  SELECT filter_id, r, CASE f.type
    WHEN 'custom' THEN (SELECT CASE WHEN count(*) = 0 THEN true WHEN coalesce(f.logic, 'or') = 'and' THEN bool_and(ok) ELSE bool_or(ok) END FROM (
      SELECT CASE q.kind WHEN 'blank' THEN empty WHEN 'nonblank' THEN NOT empty
        WHEN 'number' THEN coalesce(CASE o WHEN '=' THEN v_num = q.v_num WHEN '<>' THEN v_num <> q.v_num WHEN '<' THEN v_num < q.v_num WHEN '<=' THEN v_num <= q.v_num WHEN '>' THEN v_num > q.v_num ELSE v_num >= q.v_num END, o = '<>')
        WHEN 'bool' THEN coalesce(CASE o WHEN '=' THEN v_bool = q.v_bool WHEN '<>' THEN v_bool <> q.v_bool WHEN '<' THEN v_bool < q.v_bool WHEN '<=' THEN v_bool <= q.v_bool WHEN '>' THEN v_bool > q.v_bool ELSE v_bool >= q.v_bool END, o = '<>')
        ELSE coalesce(CASE o WHEN '=' THEN lower(v_str) LIKE {_LIKE.format(p="q.v_str")} ESCAPE '' WHEN '<>' THEN NOT lower(v_str) LIKE {_LIKE.format(p="q.v_str")} ESCAPE ''
          WHEN '<' THEN lower(v_str) < lower(q.v_str) WHEN '<=' THEN lower(v_str) <= lower(q.v_str) WHEN '>' THEN lower(v_str) > lower(q.v_str) ELSE lower(v_str) >= lower(q.v_str) END, o = '<>') END AS ok
      FROM (SELECT q, coalesce(q.operator, '=') AS o FROM (SELECT unnest(f.conditions) AS q) WHERE q.kind IS NOT NULL)))
    WHEN 'discrete' THEN coalesce(list_contains(list_transform(f.values, lambda z: lower(z)), lower(shown)), false) OR empty AND coalesce(list_contains(f.values, ''), false)
    WHEN 'top10' THEN v_num IS NOT NULL AND rk <= CASE WHEN share THEN greatest(1, floor(numbers * CAST(coalesce(n, '10') AS DOUBLE) / 100)) ELSE CAST(coalesce(n, '10') AS DOUBLE) END
    WHEN 'dynamic' THEN CASE f.attrs['type'] WHEN 'aboveAverage' THEN coalesce(v_num > mean, false) WHEN 'belowAverage' THEN coalesce(v_num < mean, false) ELSE true END
    ELSE true END AS pass FROM y)
SELECT filter_id, r AS row_idx FROM w EXCEPT SELECT filter_id, r FROM t WHERE NOT pass"""


@query("visible_rows", _VISIBLE_SQL)
def visible_rows(spark, root):
    key = ["path", "sheet_idx", "row_idx", "col_idx"]
    own = relations.last_write_wins(table(spark, root, "cells").select(*key, "v_int", "v_num", "v_str", "v_bool", "v_err", "seq"), key, "seq")
    return evaluate.visible_rows(own.withColumnsRenamed({"row_idx": "row", "col_idx": "col"}), table(spark, root, "auto_filters"), "filter_id").withColumnRenamed("row", "row_idx")


def _custom(logic, *conditions):
    kinds = {str: ("text", "v_str"), float: ("number", "v_num"), bool: ("bool", "v_bool")}
    return {"type": "custom", "logic": logic, "conditions": [{"operator": o, "kind": kinds[type(v)][0], "v_num": None, "v_str": None, "v_bool": None, kinds[type(v)][1]: v} for o, v in conditions]}


@query("filter_custom_and", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 40")
def filter_custom_and(spark, root):
    return evaluate.apply_filter_column(table(spark, root, "lineitem"), "l_quantity", _custom("and", (">", 10.0), ("<=", 40.0))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_custom_or", "SELECT c_custkey, c_mktsegment FROM customer WHERE upper(c_mktsegment) LIKE 'BU%' OR upper(c_mktsegment) = 'MACHINERY'")
def filter_custom_or(spark, root):
    return evaluate.apply_filter_column(table(spark, root, "customer"), "c_mktsegment", _custom("or", ("=", "bu*"), ("=", "machinery"))).select("c_custkey", "c_mktsegment")


@query("filter_discrete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_discrete(spark, root):
    return evaluate.apply_filter_column(table(spark, root, "orders"), "o_orderstatus", {"type": "discrete", "values": ["f", "P", None]}).select("o_orderkey", "o_orderstatus")


@query("filter_top10", "SELECT o_orderkey, o_totalprice FROM orders QUALIFY rank() OVER (ORDER BY o_totalprice DESC) <= 25")
def filter_top10(spark, root):
    return evaluate.apply_filter_column(table(spark, root, "orders"), "o_totalprice", {"type": "top10", "attrs": {"val": "25", "top": "1"}}).select("o_orderkey", "o_totalprice")


@query("filter_dynamic_above_avg", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def filter_dynamic_above_avg(spark, root):
    return evaluate.apply_filter_column(table(spark, root, "customer"), "c_acctbal", {"type": "dynamic", "attrs": {"type": "aboveAverage"}}).select("c_custkey", "c_acctbal")


@query("pivot_eval", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, CAST(count(l_orderkey) AS BIGINT) AS lines, max(l_discount) AS top, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY ALL""")
def pivot_eval(spark, root):
    rows = table(spark, root, "lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)"))
    return evaluate.pivot_eval(rows, ["l_returnflag"], ["l_linestatus"], [("l_quantity", "sum", "qty"), ("l_orderkey", "count", "lines"), ("l_discount", "max", "top"), ("price", "sum", "price")]).withColumn(
        "price", F.col("price").cast("double"))


@query("pivot_eval_totals", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS is_total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def pivot_eval_totals(spark, root):
    return evaluate.pivot_eval(table(spark, root, "lineitem"), ["l_returnflag"], ["l_linestatus"], [("l_quantity", "sum", "qty")], totals=True)


@query("pivot_grid", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS F, sum(l_quantity) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def pivot_grid(spark, root):
    return evaluate.pivot_grid(table(spark, root, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], ("l_quantity", "sum"))


@query("pivot_counts", """
SELECT l_suppkey, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS fields, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS items FROM lineitem GROUP BY l_suppkey""")
def pivot_counts(spark, root):
    return table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("fields"), F.count_if(F.col("l_returnflag") == "R").alias("items"))


# ---- rendering ----


_LAST_SQL = "(SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY path, sheet_idx, row_idx, col_idx ORDER BY seq DESC) = 1)"


def _last_cells(spark, root):
    key = ["path", "sheet_idx", "row_idx", "col_idx"]
    own = relations.last_write_wins(table(spark, root, "cells").select(*key, "sheet", "addr", "kind", "v_int", "v_num", "v_str", "v_bool", "v_err", "seq"), key, "seq")
    return own.withColumnsRenamed({"row_idx": "row", "col_idx": "col"})


@query("cellmap_json", f"""
SELECT path, sheet_idx, '{{' || string_agg(to_json(addr) || ':' || to_json(coalesce(v_str, '')), ',' ORDER BY row_idx, col_idx) || '}}' AS cells FROM {_LAST_SQL} WHERE kind = 'str' GROUP BY path, sheet_idx""")
def cellmap_json(spark, root):
    """The texts of every sheet as a JSON object by address."""
    pairs = render.cell_map(_last_cells(spark, root).filter("kind = 'str'"), F.coalesce("v_str", F.lit("")))
    return pairs.select("path", "sheet_idx", F.to_json(F.map_from_entries("cells")).alias("cells"))


@query("sheet_markdown", f"""
SELECT path, sheet_idx, sheet, string_agg('- ' || addr || ': ' || coalesce(v_str, v_err, CAST(v_int AS VARCHAR), CAST(v_bool AS VARCHAR), CAST(CAST(floor(v_num) AS BIGINT) AS VARCHAR), ''), chr(10) ORDER BY row_idx, col_idx) AS markdown
FROM {_LAST_SQL} GROUP BY path, sheet_idx, sheet""")
def sheet_markdown(spark, root):
    """Every sheet as lines; numbers that are not whole are cut, for two engines write them in two ways."""
    shown = F.coalesce("v_str", "v_err", F.col("v_int").cast("string"), F.col("v_bool").cast("string"), F.floor("v_num").cast("string"), F.lit(""))
    return render.sheet_markdown(_last_cells(spark, root), shown).select("path", "sheet_idx", "sheet", "markdown")


@query("cell_values_shown", """
SELECT path, sheet_idx, row_idx, col_idx, seq, kind, CASE kind WHEN 'int' THEN CAST(v_int AS DOUBLE) WHEN 'float' THEN v_num END AS number,
  CASE WHEN kind = 'bool' THEN CAST(v_bool AS VARCHAR) WHEN kind NOT IN ('int', 'float') THEN coalesce(v_str, v_err) END AS text FROM cells""")
def cell_values_shown(spark, root):
    shown = render.shown_value()
    numeric = F.col("kind").isin("int", "float")
    text = F.when(F.col("kind") == "bool", shown).when(~numeric, F.get(F.from_json(shown, "array<string>"), F.lit(0)))
    return table(spark, root, "cells").select("path", "sheet_idx", "row_idx", "col_idx", "seq", "kind", F.when(numeric, shown.cast("double")).alias("number"), text.alias("text"))


@query("filter_top_percent", "SELECT o_orderkey, o_totalprice FROM orders QUALIFY rank() OVER (ORDER BY o_totalprice DESC) <= greatest(1, floor(count(*) OVER () * 0.07))")
def filter_top_percent(spark, root):
    return evaluate.apply_filter_column(table(spark, root, "orders"), "o_totalprice", {"type": "top10", "attrs": {"val": "7", "percent": "1", "top": "1"}}).select("o_orderkey", "o_totalprice")


@query("references_unmoved", "SELECT DISTINCT formula, formula AS again FROM formulas WHERE formula IS NOT NULL")
def references_unmoved(spark, root):
    texts = table(spark, root, "formulas").select("formula").filter("formula is not null").distinct()
    return texts.select("formula", cells.shift_references("formula", F.lit(0), F.lit(0)).alias("again"))
