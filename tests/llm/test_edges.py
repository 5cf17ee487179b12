"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from pyspark.sql import functions as F

from gridspark.llm import code_language, encoding_repair, leakage, near_dup, packing, secrets, splitting, term_frequency

MODULES = "module_id bigint, name string, vba_source_text string, path string, id string, text string, word string, field string"
DOCS = "doc_id bigint, text string, piece string, digest string, item_id string"
FORMULAS = "path string, sheet_idx int, row_idx int, col_idx int, seq bigint, formula string, term string, block string"


def modules(spark, rows):
    return spark.createDataFrame([(i, n, t, None, "x", "y", "z", "f") for i, n, t in rows], MODULES)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "p", "d", "q") for i, t in rows], DOCS)


RUNS = {
    "language": lambda s, rows: code_language.natural_language(modules(s, rows)),
    "garbled": lambda s, rows: encoding_repair.garbled_units(modules(s, rows)),
    "restored": lambda s, rows: encoding_repair.restore_fields(modules(s, rows), encoding_repair.garbled_units(modules(s, rows))),
    "secrets": lambda s, rows: secrets.find_credentials(modules(s, rows)),
    "masked": lambda s, rows: secrets.mask_credentials(modules(s, rows), secrets.find_credentials(modules(s, rows))),
    "pairs": lambda s, rows: near_dup.near_duplicate_pairs(modules(s, rows).drop("id", "text").withColumnsRenamed({"module_id": "id", "vba_source_text": "text"}), 0.6, 3, 5),
    "groups": lambda s, rows: near_dup.near_duplicate_groups(modules(s, rows).drop("id", "text").withColumnsRenamed({"module_id": "id", "vba_source_text": "text"}), 0.6, 3, 5),
    "pack": lambda s, rows: packing.pack_documents(docs(s, [(i, t) for i, _, t in rows])),
    "split": lambda s, rows: splitting.split_documents(docs(s, [(i, t) for i, _, t in rows])),
    "leak": lambda s, rows: leakage.leaked_passages(docs(s, [(i, t) for i, _, t in rows]), s.createDataFrame([(1, "a b c " * 9), (2, None), (2, None), (3, "")], "item_id int, text string")),
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, []).count() == 0


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_do_not_fail(spark, name):
    rows = [(None, None, None), (1, None, ""), (2, "", "x"), (2, "", "x"), (3, "é퟿?", "\r\n\t ' \" \x00 ?" * 50), (4, "n", "word " * 60_000), (5, "n", "語" * 30_000), (None, "m", "one two three four five six")]
    got = RUNS[name](spark, rows)
    assert got.count() == got.distinct().count()


def test_term_frequency_edges(spark):
    rows = [
        ("a", 0, 0, 0, 1, "=SUM(A1)"), ("a", 0, 0, 0, 2, '=@_xlfn.Max(sum(1),"SUM(x)")'), ("a", 0, 0, 0, 2, '=@_xlfn.Max(sum(1),"SUM(x)")'),
        ("a", 0, 64, 0, 1, None), ("a", 0, 1, 0, 1, "=<parse_error:SUM(1)>"), (None, None, None, None, None, "=[1]!f.x(1)+'It''s MAX(1)'!A1"),
        ("a", 0, 2, 0, 5, "=MAX(1)"), ("a", 0, 3, 0, 5, "=_xlfn._xlws.max(1)+tbl[[#All],[SUM(x)]]"),
    ]
    df = spark.createDataFrame([(*r, "t", "b") for r in rows], FORMULAS)
    got = {r.term: tuple(r)[1:] for r in term_frequency.term_frequency(df, common_above=0.4).collect()}
    assert got == {"MAX": (3, 3, 6, "common"), "SUM": (1, 1, 6, "rare"), "F.X": (1, 1, 6, "rare")}
    assert term_frequency.term_frequency(df.limit(0)).count() == 0


def test_bitmaps_of_deliveries_merge(spark):
    from ..conftest import DATA

    formulas = spark.read.parquet(f"{DATA}/sf0.01/formulas.parquet")
    want = sorted(map(tuple, term_frequency.term_frequency(formulas).collect()))
    even = F.pmod(F.hash("path", "sheet_idx"), F.lit(2)) == 0
    parts = term_frequency.term_bitmaps(formulas.filter(even)).unionByName(term_frequency.term_bitmaps(formulas.filter(~even)))
    assert sorted(map(tuple, term_frequency.frequencies(term_frequency.union(parts)).collect())) == want
    kept = term_frequency.containers(term_frequency.union(parts)).groupBy("term").agg(F.sum("n_records").alias("n")).filter("term <> ''").collect()
    assert {(r.term, r.n) for r in kept} == {(t, n) for t, _, n, *_ in want}


def test_one_id_with_a_long_and_a_short_text(spark):
    words = " ".join(f"w{k}" for k in range(80))
    df = spark.createDataFrame([(1, words), (1, "too short"), (1, None), (2, words + " more"), (3, ""), (None, words)], "id bigint, text string")
    assert [tuple(r) for r in near_dup.near_duplicate_pairs(df, 0.6, 3, 40).collect()] == [(1, 2)]
    assert {(r.id, r.group_id) for r in near_dup.near_duplicate_groups(df, 0.6, 3, 40).collect()} == {(1, 1), (2, 1)}
