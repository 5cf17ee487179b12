"""The relations' schemas, as DDL. What ``operators.relations`` returns conforms to them."""

from __future__ import annotations

from pyspark.sql.types import StructType

CRITERION = "STRUCT<operator: STRING, kind: STRING, v_num: DOUBLE, v_str: STRING, v_bool: BOOLEAN>"
RELATIONS = {
    "sheets": "path STRING, format STRING, sheet_idx INT, sheet STRING, rel_id STRING, part STRING",
    "cells": "path STRING, sheet_idx INT, sheet STRING, row INT, col INT, addr STRING, kind STRING, v_int BIGINT, v_num DOUBLE, v_str STRING, v_bool BOOLEAN, v_err STRING, from_formula BOOLEAN",
    "formulas": "path STRING, sheet_idx INT, sheet STRING, row INT, col INT, addr STRING, formula STRING, formula_kind STRING, parse_error STRING",
    "auto_filters": (
        "path STRING, sheet_idx INT, sheet STRING, ref STRING, top_left STRING, bottom_right STRING, columns ARRAY<STRUCT<col_id: INT, type: STRING, logic: STRING, "
        f"conditions: ARRAY<{CRITERION}>, values: ARRAY<STRING>, attrs: MAP<STRING, STRING>>>"
    ),
    "pivot_tables": (
        "path STRING, sheet STRING, part STRING, name STRING, cache_id INT, data_caption STRING, pivot_cache_definition STRING, pivot_fields INT, pivot_items INT, "
        "location STRUCT<rfx_geom: STRUCT<top_left: STRING, bottom_right: STRING>, rw_first_head: INT, rw_first_data: INT, col_first_data: STRING, page_rows: INT, page_cols: INT>, "
        "row_fields ARRAY<INT>, col_fields ARRAY<INT>, data_fields ARRAY<STRUCT<name: STRING, fld: INT, subtotal: STRING>>, report_filters ARRAY<STRUCT<fld: INT, type: STRING>>, "
        f"sx_filters ARRAY<STRUCT<field_index: INT, filter_type: INT, criteria: ARRAY<{CRITERION}>>>"
    ),
    "vba_modules": "path STRING, module STRING, module_type STRING, stream_name STRING, code_page INT, source STRING",
    "defined_names": "path STRING, idx INT, name STRING, refers_to STRING",
    "shared_strings": "path STRING, idx INT, text STRING",
    "pivot_links": "path STRING, sheet_idx INT, sheet STRING, pivot_part STRING, cache STRING",
}


def schema(relation: str) -> StructType:
    return StructType.fromDDL(RELATIONS[relation])
