import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.operators import shred

from .conftest import DATA


def _found(spark, payloads):
    df = spark.createDataFrame([("raw_records", i, p, "clash") for i, p in payloads], "src string, rec_id bigint, payload string, node string")
    return sorted(tuple(r) for r in shred.children(shred.nodes(df)).select("rec_id", "child", "parent_pos", "pos").distinct().collect())


def test_both_schemas_and_shapes(spark):
    filters = {"columns": [{"column_index": 1, "filters": ["a", None, ""], "custom_filters": {"logic": "and", "criteria": [{"operator": ">", "value": 1}, None]}}, None]}
    other = {"columns": json.dumps({"col_id": 0, "conditions": json.dumps([{"val": "x"}]), "values": "lone"})}
    pivot = {"location": {"rfx_geom": json.dumps({"top_left": "A1"})}, "data_fields": {"name": "n"}, "sx_filters": [None, {"criteria": {"operator": "<"}}]}
    got = _found(spark, [(1, json.dumps(filters)), (1, json.dumps(filters)), (2, json.dumps(other)), (3, json.dumps(pivot)), (4, "{\"columns\": [{"), (5, None), (6, "[]"), (7, "")])
    assert got == sorted([
        (1, "column", -1, 0), (1, "value", 0, 0), (1, "value", 0, 2), (1, "condition", 0, 0),
        (2, "column", -1, 0), (2, "condition", 0, 0), (2, "value", 0, 0),
        (3, "location", -1, 0), (3, "rfx_geom", 0, 0), (3, "data_field", -1, 0), (3, "sx_filter", -1, 1), (3, "criterion", 1, 0),
    ])


def test_empty_table_and_deep_payload(spark):
    assert _found(spark, []) == []
    deep = '{"columns": [' + '{"x": ' * 300 + "1" + "}" * 300 + "]}"
    assert _found(spark, [(1, deep)]) == [(1, "column", -1, 0)]


def test_entities_join_their_scalars(spark):
    payload = json.dumps({"data_fields": [{"name": "a", "fld": 1}, {"name": None, "fld": "x"}]})
    tree = shred.nodes(spark.createDataFrame([("s", 1, payload)], "src string, rec_id bigint, payload string"))
    rows = shred.entities(tree, "data_field", {"name": "string", "fld": "int"}).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("s", 1, -1, 0, "a", 1), ("s", 1, -1, 1, None, None)]


def _walk(src, rec, payload):
    """A plain recursive reading of the definition."""
    def text(v):
        try:
            return json.loads(v) if isinstance(v, str) else v
        except ValueError:
            return v

    def many(v):
        v = text(v)
        return v if isinstance(v, list) else [] if v is None else [v]

    def objects(v):
        return [(k, x) for k, x in ((k, text(x)) for k, x in enumerate(many(v))) if isinstance(x, dict)]

    try:
        d = json.loads(payload)
    except (ValueError, TypeError):
        return
    for k, c in objects(d.get("columns")):
        yield src, rec, "column", -1, k
        custom = text(c.get("custom_filters")) or {}
        for conditions in (c.get("conditions"), custom.get("criteria")):
            yield from ((src, rec, "condition", k, j) for j, _ in objects(conditions))
        for vs in (c.get("values"), c.get("filters")):
            yield from ((src, rec, "value", k, j) for j, v in enumerate(many(vs)) if v is not None)
    for key, child in (("data_fields", "data_field"), ("report_filters", "report_filter"), ("sx_filters", "sx_filter")):
        for k, x in objects(d.get(key)):
            yield src, rec, child, -1, k
            if key == "sx_filters":
                yield from ((src, rec, "criterion", k, j) for j, _ in objects(x.get("criteria")))
    location = text(d.get("location"))
    if isinstance(location, dict):
        yield src, rec, "location", -1, 0
        if isinstance(text(location.get("rfx_geom")), dict):
            yield src, rec, "rfx_geom", 0, 0


def test_against_recursive_reading(spark):
    tables = [spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("auto_filters", "pivot_tables", "raw_records")]
    records = shred.workbook_records(*tables)
    want = {row for r in records.collect() for row in _walk(r.src, r.rec_id, r.payload)}
    got = {tuple(r) for r in shred.children(shred.nodes(records)).select("src", "rec_id", "child", "parent_pos", "pos").distinct().collect()}
    assert got == want and len(want) > 500


@pytest.mark.parametrize("value, kept", [("[not json", "[not json"), ('["a"]', None)])
def test_text_that_only_looks_like_json(value, kept):
    rows = shred.shred(json.dumps({"columns": [{"values": value}]}))
    assert [r[5] for r in rows if r[2] == "values"] == [kept or "a"]


def test_any_depth():
    deep = lambda n: '{"columns": [' + '{"x": ' * n + "1" + "}" * n + "]}"
    assert len(shred.shred(deep(30_000))) == 30_002
    assert shred.shred(deep(30_000)[:-1]) == [] and shred.shred(deep(30_000) + "]") == []


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)), st.integers(0, 60))
def test_both_readers_agree(value, cut):
    text = json.dumps(value)
    assert shred._loads_deep(text) == value
    for part in (text[:cut], text + text[:cut]):
        try:
            want = json.loads(part)
        except ValueError:
            with pytest.raises(ValueError):
                shred._loads_deep(part)
        else:
            assert shred._loads_deep(part) == want


def test_clashing_columns_of_typed_tables(spark):
    from pyspark.sql import functions as F

    filters, pivots, raw = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("auto_filters", "pivot_tables", "raw_records"))
    found = lambda *ts: {tuple(r) for r in shred.children(shred.nodes(shred.workbook_records(*ts))).select("src", "rec_id", "child", "parent_pos", "pos").collect()}
    more = lambda t: t.withColumns({c: F.lit('{"columns": [{}]}') for c in ("payload2", "src", "variant", "label", "sx_filters" if "columns" in t.columns else "conditions")})
    assert found(more(filters), more(pivots), raw.withColumns({c: F.lit("x") for c in ("src", "columns", "node")})) == found(filters, pivots, raw)
    assert found(filters.limit(0), pivots.limit(0), raw.limit(0)) == set()
