import duckdb
import pytest
from pyspark.sql import functions as F

from gridspark import literal_queries, workbook_queries  # noqa: F401
from gridspark.operators import evaluate
from gridspark.queries import ORACLES, QUERIES

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "sheets", "cells", "formulas", "auto_filters", "pivot_tables", "raw_records", "vba_modules"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return c


def _shown(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, duck, name):
    want = duck.sql(ORACLES[name])
    got = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert set(got.columns) == set(want.columns)
    assert _shown(got.select(*want.columns).collect()) == _shown(want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_edges(spark):
    df = spark.createDataFrame([(1, "Apple", 5.0), (2, "apricot", 7.0), (3, None, None), (4, "", 7.0), (5, "b*d", 1.0)], "id int, s string, x double")
    ids = lambda spec, name: sorted(r.id for r in evaluate.apply_filter_column(df, name, spec).collect())
    text = lambda op, v, kind="text": {"type": "custom", "logic": "or", "conditions": [{"operator": op, "kind": kind, "v_str": v, "v_num": None, "v_bool": None}, None]}
    assert ids(text("=", "ap*"), "s") == [1, 2] and ids(text("<>", "ap*"), "s") == [3, 4, 5] and ids(text("=", "b~*d"), "s") == [5]
    assert ids(text("=", None, "blank"), "s") == [3, 4] and ids(text("<>", None, "nonblank"), "s") == [1, 2, 5]
    assert ids({"type": "discrete", "values": ["APPLE", ""]}, "s") == [1, 3, 4] and ids({"type": "discrete", "values": []}, "s") == []
    assert ids({"type": "top10", "attrs": {"val": "1"}}, "x") == [2, 4] and ids({"type": "top10", "attrs": {"val": "1", "top": "0"}}, "x") == [5]
    assert ids({"type": "top10", "attrs": {"val": "50", "percent": "1"}}, "x") == [2, 4]
    assert ids({"type": "dynamic", "attrs": {"type": "belowAverage"}}, "x") == [5] and ids({"type": None}, "x") == [1, 2, 3, 4, 5]
    assert evaluate.apply_autofilter(df, {0: "s", 1: "x"}, [{"col_id": 0, **text("=", "ap*")}, {"col_id": 1, "type": "top10", "attrs": {"val": "2"}}, None]).count() == 1
    many = spark.range(1, 20001).select(F.col("id").cast("int"), (F.pmod(F.col("id") * 7919, F.lit(20011))).cast("double").alias("x"))
    for share, top in (("0.5", "1"), ("12.5", "1"), ("37", "0"), ("100", "0")):
        got = evaluate.apply_filter_column(many, "x", {"type": "top10", "attrs": {"val": share, "percent": "1", "top": top}})
        assert got.count() == max(1, int(20000 * float(share) / 100))
    ties = spark.range(1000).select(F.when(F.col("id") < 990, 5.0).otherwise(9.0).alias("x"))
    assert evaluate.apply_filter_column(ties, "x", {"type": "top10", "attrs": {"val": "1", "percent": "1"}}).count() == 10
    assert evaluate.apply_filter_column(ties, "x", {"type": "top10", "attrs": {"val": "2", "percent": "1"}}).count() == 1000
    empty = df.limit(0)
    for spec in ({"type": "top10", "attrs": {"val": "3"}}, {"type": "dynamic", "attrs": {"type": "aboveAverage"}}):
        assert evaluate.apply_filter_column(empty, "x", spec).count() == 0
