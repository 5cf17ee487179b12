"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from . import code_language, encoding_repair, leakage, near_dup, packing, secrets, splitting, term_frequency

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_TERMS_SQL = r"""
WITH last AS (
  SELECT path, sheet_idx, row_idx, col_idx, formula FROM formulas
  QUALIFY row_number() OVER (PARTITION BY path, sheet_idx, row_idx, col_idx ORDER BY seq DESC NULLS LAST, formula DESC NULLS LAST) = 1),
numbered AS (SELECT row_number() OVER () AS cell, formula FROM last),
bare AS (
  SELECT cell, regexp_replace(formula, '("(?:[^"]|"")*"|''(?:[^'']|'''')*''|\[(?:[^\[\]]|\[[^\[\]]*\])*\])', '"', 'g') AS f
  FROM numbered WHERE formula IS NOT NULL AND NOT starts_with(formula, '=<parse_error:')),
calls AS (
  SELECT cell, regexp_replace(upper(t), '^(?:@|_XLFN\.|_XLWS\.|_XLUDF\.)+', '') AS term
  FROM (SELECT cell, unnest(regexp_extract_all(f, '([\pL\pM\pN_.]+)\(', 1)) AS t FROM bare)),
terms AS (
  SELECT term, CAST(count(*) AS BIGINT) AS n_calls, CAST(count(DISTINCT cell) AS BIGINT) AS n_records
  FROM calls WHERE regexp_matches(term, '[\pL_]') GROUP BY term),
marked AS (
  SELECT term, n_calls, n_records, CAST(total AS BIGINT) AS total_records,
    CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > total * 0.15 THEN 'common' ELSE 'kept' END AS mark
  FROM terms, (SELECT count(*) AS total FROM last))
"""


@query("p1_found", _TERMS_SQL + "SELECT term, mark FROM marked WHERE mark <> 'kept'")
def p1_found(spark, root):
    return term_frequency.term_frequency(table(spark, root, "formulas")).filter("mark <> 'kept'").select("term", "mark")


@query("p1_terms", _TERMS_SQL + "SELECT term, n_calls, n_records, total_records, mark FROM marked")
def p1_terms(spark, root):
    return term_frequency.term_frequency(table(spark, root, "formulas"))


def _modules(spark, root):
    return table(spark, root, "vba_modules").select(F.col("module_id").alias("id"), F.col("vba_source_text").alias("text"))


@query("p3_found")
def p3_found(spark, root):
    return encoding_repair.garbled_units(table(spark, root, "vba_modules")).select("module_id", "field").distinct()


@query("p3_restored")
def p3_restored(spark, root):
    modules = table(spark, root, "vba_modules")
    return encoding_repair.restore_fields(modules, encoding_repair.garbled_units(modules))


@query("p4_found")
def p4_found(spark, root):
    found = secrets.find_credentials(table(spark, root, "vba_modules"))
    return found.filter("part = 0").select("module_id", "line_no").distinct()


@query("p4_masked")
def p4_masked(spark, root):
    modules = table(spark, root, "vba_modules")
    return secrets.mask_credentials(modules, secrets.find_credentials(modules))


@query("p5_found")
def p5_found(spark, root):
    modules = table(spark, root, "vba_modules")
    garbled = encoding_repair.garbled_units(modules).filter("field = 'vba_source_text'").select("module_id").distinct()
    return code_language.natural_language(modules).select("module_id", "lang").distinct().join(garbled, "module_id", "left_anti")


@query("p5_languages")
def p5_languages(spark, root):
    return code_language.natural_language(table(spark, root, "vba_modules"))


_PAIRS_SQL = r"""
WITH m AS (SELECT DISTINCT module_id, regexp_extract_all(lower(vba_source_text), '[^ \t\r\n]+') AS w FROM vba_modules WHERE vba_source_text IS NOT NULL),
s AS (SELECT DISTINCT module_id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g FROM m WHERE len(w) >= 40),
n AS (SELECT module_id, count(*) AS n FROM s GROUP BY module_id),
c AS (SELECT a.module_id AS x, b.module_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.module_id < b.module_id GROUP BY ALL)
SELECT x AS module_id_a, y AS module_id_b FROM c JOIN n p ON p.module_id = x JOIN n q ON q.module_id = y WHERE 10 * c >= 6 * (p.n + q.n - c)"""


@query("p6_found", _PAIRS_SQL)
def p6_found(spark, root):
    return near_dup.near_duplicate_pairs(_modules(spark, root), 0.6, 3, 40).select(F.col("a").alias("module_id_a"), F.col("b").alias("module_id_b"))


_GROUPS_SQL = r"""
WITH RECURSIVE m AS (SELECT DISTINCT module_id, regexp_extract_all(lower(vba_source_text), '[^ \t\r\n]+') AS w FROM vba_modules WHERE vba_source_text IS NOT NULL),
k AS (SELECT * FROM m WHERE len(w) >= 40), rep AS (SELECT w, min(module_id) AS r, count(*) AS n_copies FROM k GROUP BY w),
s AS (SELECT DISTINCT r, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g FROM rep),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 10 * c >= 6 * (p.n + q.n - c)),
reach AS (SELECT r AS v, r AS u FROM rep UNION SELECT reach.v, e.y FROM reach JOIN e ON reach.u = e.x),
g AS (SELECT v, min(u) AS group_id FROM reach GROUP BY v), d AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT module_id, group_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(n_copies AS BIGINT) AS n_copies
FROM k JOIN rep USING (w) JOIN g ON g.v = rep.r LEFT JOIN d ON d.x = rep.r"""


@query("p6_groups", _GROUPS_SQL)
def p6_groups(spark, root):
    return near_dup.near_duplicate_groups(_modules(spark, root), 0.6, 3, 40).withColumnRenamed("id", "module_id")


@query("p7_pack")
def p7_pack(spark, root):
    return packing.pack_documents(table(spark, root, "documents"))


_LEAKS_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM eval_items),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(w[k:k + 12]))) AS h FROM d),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(w[k:k + 12]))) AS h FROM i)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (h)"""


@query("p8_found", _LEAKS_SQL)
def p8_found(spark, root):
    return leakage.leaked_passages(table(spark, root, "documents"), table(spark, root, "eval_items")).filter("exact_run >= 13").select("doc_id", "item_id").distinct()


@query("p8_overlaps")
def p8_overlaps(spark, root):
    return leakage.leaked_passages(table(spark, root, "documents"), table(spark, root, "eval_items"))


#: Runs of equal 13-grams along a diagonal.
_RUNS_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM eval_items),
dw AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(w[k:k + 12]))) AS h, hash(w) AS v FROM d),
iw AS (SELECT item_id, unnest(range(1, len(w) - 11)) AS q, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(w[k:k + 12]))) AS h FROM i),
m AS (SELECT DISTINCT doc_id, v, item_id, p, p - q AS diagonal FROM dw JOIN iw USING (h)),
r AS (SELECT doc_id, item_id, count(*) + 12 AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, v, item_id, diagonal ORDER BY p) AS island FROM m) GROUP BY doc_id, v, item_id, diagonal, island)
SELECT doc_id, item_id, CAST(max(n) AS INT) AS exact_run FROM r GROUP BY doc_id, item_id"""


@query("p8_runs", _RUNS_SQL)
def p8_runs(spark, root):
    found = leakage.leaked_passages(table(spark, root, "documents"), table(spark, root, "eval_items")).filter("exact_run >= 13")
    return found.groupBy("doc_id", "item_id").agg(F.max("exact_run").alias("exact_run"))


@query("p8_runs_by_join", _RUNS_SQL)
def p8_runs_by_join(spark, root):
    """The way beyond one block of items, over the whole tables."""
    found = leakage.leaked_passages(table(spark, root, "documents"), table(spark, root, "eval_items"), block_chars=1).filter("exact_run >= 13")
    return found.groupBy("doc_id", "item_id").agg(F.max("exact_run").alias("exact_run"))


_TOKENS_SQL = r"regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\pZ\t\n\f\r\x0B\x1c-\x1f\x{85}]+')"


@query("p9_found", f"SELECT DISTINCT doc_id FROM documents WHERE len({_TOKENS_SQL}) > 1024")
def p9_found(spark, root):
    return splitting.split_documents(table(spark, root, "documents")).select("doc_id").distinct()


@query("p9_pieces")
def p9_pieces(spark, root):
    return splitting.split_documents(table(spark, root, "documents")).distinct()


# ---- what must hold of results that no SQL can compute ----

_DOCS_SQL = f"WITH t AS (SELECT DISTINCT doc_id, text FROM documents), n AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len({_TOKENS_SQL}) END AS n FROM t) "


@query("p7_kept", _DOCS_SQL + "SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tokens, true AS fits, true AS whole FROM n GROUP BY doc_id")
def p7_kept(spark, root):
    """Every token of every document is packed once, no container overflows, and only what is larger than a container is split."""
    packed = packing.pack_documents(table(spark, root, "documents"))
    fills = packed.groupBy("container").agg((F.sum("n_tokens") <= 2048).alias("fits"))
    own = packed.join(fills, "container").withColumn("whole", (F.col("first_token") == F.col("part") * 2048) & ((F.col("part") == 0) | (F.col("n_tokens") <= 2048)))
    return own.groupBy("doc_id").agg(F.sum("n_tokens").cast("bigint").alias("n_tokens"), F.bool_and("fits").alias("fits"), F.bool_and("whole").alias("whole"))


@query("p7_containers", _DOCS_SQL + "SELECT CAST(sum(n // 2048) + ceil(sum(n % 2048) / 2048.0) AS BIGINT) AS least, true AS near FROM n")
def p7_containers(spark, root):
    """The containers are at most one in a thousand, and two, more than the least possible number."""
    documents = table(spark, root, "documents")
    sizes = packing.document_sizes(documents).agg((F.sum(F.floor(F.col("n_tokens") / 2048)) + F.ceil(F.sum(F.col("n_tokens") % 2048) / 2048)).cast("bigint").alias("least"))
    used = packing.pack_documents(documents).agg(F.count_distinct("container"))
    return sizes.withColumn("near", used.scalar() <= F.col("least") * 1.001 + 2)


@query("p9_kept", _DOCS_SQL + "SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, true AS small, true AS overlap FROM (SELECT DISTINCT doc_id, n FROM n) WHERE n > 1024")
def p9_kept(spark, root):
    """Every token is in a piece, no piece has over 1,024, and each after the first repeats the 64 before it."""
    pieces = splitting.split_documents(table(spark, root, "documents")).distinct()
    end = F.col("first_token") + F.col("n_tokens")
    before = F.lag(end).over(Window.partitionBy("doc_id").orderBy("piece"))
    own = pieces.withColumn("overlap", F.when(F.col("piece") == 0, F.col("first_token") == 0).otherwise(F.col("first_token") == before - 64)).withColumn("end", end)
    return own.groupBy("doc_id").agg(F.max("end").cast("bigint").alias("n_tokens"), F.bool_and(F.col("n_tokens") <= 1024).alias("small"), F.bool_and("overlap").alias("overlap"))


# ---- cases planted by SQL in modules made of whole tables ----


def _made(spark, root, lines):
    """A module for every customer: some code of its own and a line made by SQL."""
    code = "concat_ws('\n', concat('Sub Work', c_custkey, '()'), concat('    total', c_custkey, ' = amount', c_nationkey, ' * ', c_custkey % 977), concat('    Cells(', c_custkey % 99 + 1, ', 2).Value = total', c_custkey), " + lines + ", 'End Sub')"
    return table(spark, root, "customer").select(
        F.col("c_custkey").alias("module_id"), F.concat(F.lit("/made/"), "c_custkey", F.lit(".xlsm")).alias("path"), F.concat(F.lit("Work"), "c_custkey").alias("name"), F.expr(code).alias("vba_source_text"),
    )


@query("p3_planted", "SELECT c_custkey AS module_id FROM customer WHERE c_custkey % 11 = 3")
def p3_planted(spark, root):
    clean = "concat(\"    ' Die Prüfung der Bestellung \", c_custkey, ' wählt die täglichen Beträge für die Übersicht')"
    wrong = f"decode(encode({clean}, 'UTF-8'), 'ISO-8859-1')"
    made = _made(spark, root, f"CASE WHEN c_custkey % 11 = 3 THEN {wrong} ELSE {clean} END")
    return encoding_repair.garbled_units(made).filter("field = 'vba_source_text'").select("module_id").distinct()


@query("p4_planted", "SELECT c_custkey AS module_id, 4 AS line_no FROM customer WHERE c_custkey % 7 = 2 OR c_custkey % 7 = 4")
def p4_planted(spark, root):
    """A password of its own in a seventh of the modules, one in a connection in another; one that all of a third seventh share is a placeholder."""
    own = "substr(md5(CAST(c_custkey AS STRING)), 1, 6)"
    made = _made(spark, root, f"""CASE c_custkey % 7 WHEN 2 THEN concat('    strPwd = "', upper({own}), '#q', c_custkey, '"') WHEN 4 THEN concat('    cn.Open "Server=s1;Uid=web;Pwd=', {own}, 'X!', c_custkey, ';"')
      WHEN 5 THEN '    strPwd = "Welcome123"' ELSE concat('    caption = "Order ', c_custkey, '"') END""")
    return secrets.find_credentials(made).filter("part = 0").select("module_id", "line_no").distinct()


@query("p5_planted", "SELECT c_custkey AS module_id, ['en', 'de', 'fr', 'ru'][c_custkey % 8 + 1] AS lang FROM customer WHERE c_custkey % 8 < 4")
def p5_planted(spark, root):
    made = _made(spark, root, """CASE c_custkey % 8 WHEN 0 THEN "    ' The harbour was quiet when the last boat came home." WHEN 1 THEN "    ' Der Hafen war still, als das letzte Boot nach Hause kam."
      WHEN 2 THEN "    ' Le port était calme quand le dernier bateau est rentré." WHEN 3 THEN "    ' В гавани было тихо, когда вернулась последняя лодка."
      ELSE concat("    ' x = Range(A", c_custkey % 50 + 1, ").Value") END""")
    return code_language.natural_language(made).select("module_id", "lang").distinct()
