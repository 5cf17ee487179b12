"""Nested records into flat related tables, by adjacency-table shredding.

Every value of a record becomes a node: ``node`` (its number in document order), ``parent``,
``label`` (the key it stands under), ``ordinal`` (its position in a list, else 0), ``kind`` and
``scalar``. A list is no node of its own: its elements stand under the list's key. Beside them
stand the label and ordinal of the parent (``up``) and of the parent's parent (``top``), so the
links between entities are a selection. Entity tables come from joining the object nodes of one
label with their scalar children, pivoted: both sides come from one reading of the records and
meet in one aggregate by object.

Deliveries differ in shape; the shredder evens that out. A lone value in place of a list is
a list of one; JSON text in place of an object or list stands for what it holds; null elements
give no node but take a position. A payload that is not valid JSON gives no rows.

Defined results: nulls in any column give no nodes; repeated rows (same id, same content) give
the same nodes once; records of one id with different contents are kept apart by ``variant``;
an empty table gives no rows; other columns are ignored. A record is shredded in one task and
costs time and memory in proportion to its length.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "src string, rec_id bigint, variant bigint, node int, parent int, label string, ordinal int, kind string, scalar string, up string, up_pos int, top string, top_pos int"
KEY = ["src", "rec_id", "variant"]
#: Keys whose value is a list.
LISTS = frozenset((
    "columns", "conditions", "values", "filters", "criteria", "data_fields", "report_filters", "sx_filters", "row_fields", "col_fields",
))
#: Keys whose value, or whose list's elements, are objects.
OBJECTS = frozenset((
    "columns", "conditions", "criteria", "data_fields", "report_filters", "sx_filters", "location", "rfx_geom", "custom_filters", "range", "attrs",
))


_TOKEN = re.compile(r'[ \t\r\n]*([{}\[\],:]|"(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)')


def _loads(text: str) -> object:
    """Strict JSON of any depth; ValueError if it is none."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _loads_deep(text)


def _loads_deep(text: str) -> object:
    """The same without recursion, for nesting beyond the interpreter's stack."""
    open_: list = []  # containers around the place that is read
    keys: list = []  # for each of them the key that waits for its value
    root: list = []
    at, wanted = 0, "value"
    while wanted != "end":
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        token, at = m[1], m.end()
        if token in "}]" and wanted in ("first", "more"):
            if (token == "}") != isinstance(open_[-1], dict):
                raise ValueError(f"unbalanced at {at}")
            open_.pop()
            keys.pop()
            wanted = "more" if open_ else "end"
        elif token == "," and wanted == "more":
            wanted = "key" if isinstance(open_[-1], dict) else "value"
        elif token == ":" and wanted == "colon":
            wanted = "value"
        elif token[0] == '"' and (wanted == "key" or wanted == "first" and isinstance(open_[-1], dict)):
            keys[-1], wanted = json.loads(token), "colon"
        elif token[0] not in "}],:" and (wanted == "value" or wanted == "first" and isinstance(open_[-1], list)):
            value = {} if token == "{" else [] if token == "[" else json.loads(token)
            if not open_:
                root.append(value)
            elif isinstance(open_[-1], dict):
                open_[-1][keys[-1]] = value
            else:
                open_[-1].append(value)
            if token in "{[":
                open_.append(value)
                keys.append(None)
                wanted = "first"
            else:
                wanted = "more" if open_ else "end"
        else:
            raise ValueError(f"unexpected {token} at {at}")
    if text[at:].strip(" \t\r\n"):
        raise ValueError("text behind the value")
    return root[0]


def _text(value: object) -> object:
    """What JSON text in place of an object or list holds; the value itself if it is none."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = _loads(value)
        except ValueError:
            return value
    return value


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _kind(value: object) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, str):
        return "string"
    return "int" if isinstance(value, int) else "float"


def _scalar(value: object) -> str | None:
    if isinstance(value, dict):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def shred(payload: str | None) -> list[tuple]:
    """``node, parent, label, ordinal, kind, scalar, up, up_pos, top, top_pos`` of one record; its root is node 0."""
    try:
        root = _text(_loads(payload)) if payload else None
    except ValueError:
        return []
    if not isinstance(root, dict):
        return []
    rows: list[tuple] = []
    todo: list[tuple[int, str, int, object]] = [(-1, "", 0, root)]
    while todo:  # a stack, not recursion: depth is the data's
        parent, label, ordinal, value = todo.pop()
        node = len(rows)
        up = rows[parent] if parent >= 0 else None
        top = rows[up[1]] if up and up[1] >= 0 else None
        rows.append((node, parent, label, ordinal, _kind(value), _scalar(value), *(up[2:4] if up else (None, None)), *(top[2:4] if top else (None, None))))
        if not isinstance(value, dict):
            continue
        children = []
        for key, child in value.items():
            if key in LISTS or key in OBJECTS:
                child = _text(child)
            elements = child if isinstance(child, list) else [child]
            for k, element in enumerate(_flat(elements)):
                if key in OBJECTS:
                    element = _text(element)
                if element is not None and not isinstance(element, list):
                    children.append((node, key, k, element))
        todo.extend(reversed(children))
    return rows


def _flat(elements: list) -> list:
    """Lists directly within a list are taken apart; an element that is no list stays one element."""
    return [y for x in elements for y in (x if isinstance(x, list) else [x])] if any(isinstance(x, list) for x in elements) else elements


def nodes(records: DataFrame) -> DataFrame:
    """The adjacency table of ``records`` (src, rec_id, payload)."""
    schema = pa.schema([
        ("src", pa.string()), ("rec_id", pa.int64()), ("variant", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()),
        ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()),
        ("up", pa.string()), ("up_pos", pa.int32()), ("top", pa.string()), ("top_pos", pa.int32()),
    ])

    def run(batches):
        for batch in batches:
            rows = [
                (src, rec, variant, *row)
                for src, rec, variant, payload in zip(*(batch.column(k).to_pylist() for k in range(4)))
                for row in shred(payload)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    once = records.select("src", F.col("rec_id").cast("bigint").alias("rec_id"), "payload").distinct()
    return once.select("src", "rec_id", F.xxhash64("payload").alias("variant"), "payload").mapInArrow(run, NODES)


#: Columns of the typed tables that make up a record.
FILTER_FIELDS = ("sheet", "sheet_idx", "ref", "top_left", "bottom_right", "columns")
PIVOT_FIELDS = (
    "sheet", "part", "name", "cache_id", "data_caption", "pivot_cache_definition", "pivot_fields", "pivot_items", "location", "row_fields", "col_fields",
    "data_fields", "report_filters", "sx_filters",
)


def as_records(table: DataFrame, src: str, key: str, fields: tuple[str, ...]) -> DataFrame:
    """A typed nested table as records: the fields it has become the payload."""
    nested = [f for f in fields if f in table.columns]
    return table.select(
        F.lit(src).alias("src"), F.col(key).cast("bigint").alias("rec_id"),
        F.to_json(F.struct(*nested), {"ignoreNullFields": "false"}).alias("payload"),
    )


def workbook_records(auto_filters: DataFrame, pivot_tables: DataFrame, raw_records: DataFrame) -> DataFrame:
    """The three deliveries of filter and pivot records in one shape."""
    raw = raw_records.select(F.lit("raw_records").alias("src"), F.col("rec_id").cast("bigint").alias("rec_id"), "payload")
    return (
        as_records(auto_filters, "auto_filters", "filter_id", FILTER_FIELDS)
        .unionByName(as_records(pivot_tables, "pivot_tables", "pivot_id", PIVOT_FIELDS))
        .unionByName(raw)
    )


def _linked(tree: DataFrame) -> DataFrame:
    """The adjacency table with ``child`` (null where a node is no entity), ``parent_pos`` and ``pos``."""
    label, at_root, under_column = F.col("label"), F.col("parent") == 0, F.col("up") == "columns"
    entity = F.col("kind") == "object"
    named = (
        F.when(at_root & entity & (label == "columns"), "column")
        .when(at_root & entity & (label == "data_fields"), "data_field")
        .when(at_root & entity & (label == "report_filters"), "report_filter")
        .when(at_root & entity & (label == "sx_filters"), "sx_filter")
        .when(at_root & entity & (label == "location"), "location")
        .when(entity & (label == "rfx_geom") & (F.col("up") == "location"), "rfx_geom")
        .when(under_column & entity & (label == "conditions"), "condition")
        .when(under_column & label.isin("values", "filters"), "value")
        .when((F.col("up") == "custom_filters") & (F.col("top") == "columns") & entity & (label == "criteria"), "condition")
        .when((F.col("up") == "sx_filters") & entity & (label == "criteria"), "criterion")
    )
    parent_pos = (
        F.when(F.col("child").isin("column", "data_field", "report_filter", "sx_filter", "location"), -1)
        .when(F.col("child") == "rfx_geom", 0)
        .when(F.col("up") == "custom_filters", F.col("top_pos"))
        .otherwise(F.col("up_pos"))
    )
    pos = F.when(F.col("child").isin("location", "rfx_geom"), 0).otherwise(F.col("ordinal"))
    return tree.withColumn("child", named).withColumn("parent_pos", parent_pos.cast("int")).withColumn("pos", pos.cast("int"))


def children(tree: DataFrame) -> DataFrame:
    """The related table of all children: ``src, rec_id, variant, child, parent_pos, pos, node, kind, scalar``.

    A selection of the adjacency table: no join and no exchange.
    """
    return _linked(tree).filter("child is not null").select(*KEY, "child", "parent_pos", "pos", "node", "kind", "scalar")


def entities(tree: DataFrame, child: str, fields: dict[str, str]) -> DataFrame:
    """One row per object node of ``child``, its scalar children pivoted into typed columns.

    ``fields`` maps a key of the object to a type; values of another type become null. Objects and
    scalars meet by the object's node in one aggregate, so the records are read once.
    """
    own = (F.col("kind") == "object") & F.coalesce(F.col("child") == child, F.lit(False))
    part = F.col("label").isin(*fields) & (F.col("kind") != "object")
    rows = _linked(tree).withColumn("own", own).filter(own | part)
    value = lambda name, kind: F.first(F.when(~F.col("own") & (F.col("label") == name), _typed(F.col("scalar"), F.col("kind"), kind)), True).alias(name)
    return (
        rows.groupBy(*KEY, F.when(F.col("own"), F.col("node")).otherwise(F.col("parent")).alias("object"))
        .agg(F.max("own").alias("own"), *(F.first(F.when(F.col("own"), F.col(c)), True).alias(c) for c in ("parent_pos", "pos")), *(value(n, k) for n, k in fields.items()))
        .filter("own").select("src", "rec_id", "parent_pos", "pos", *fields).distinct()
    )


def _typed(scalar: Column, kind: Column, wanted: str) -> Column:
    return scalar if wanted == "string" else F.expr("scalar").try_cast(wanted)
