"""Frequency of every function name called in a corpus of formulas.

Vertical layout: the identifier of a record (a cell) is its coordinate, so a bitmap of
records is addressed without numbering them. 64 consecutive rows of one column share a
word; a term's bitmap is the set of its non-zero words, each with a parallel counter of
calls. Words merge by bitwise or, and the document frequency is the sum of their
cardinalities. Everything is a hash aggregate on longs; the formulas themselves are moved
once, partitioned by word, and the word aggregate needs no second exchange. The vocabulary is
written once and read for the total and for the marks.

Defined results: of the rows of one cell the one with the highest ``seq`` counts (ties: the
greatest formula); null coordinates form a coordinate of their own; a null formula and a
parse error hold no terms but count as records; an empty table gives no rows; columns beyond
the ones named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Quoted text, quoted sheet names, bracketed references (nested once); read left to right.
HIDDEN = r"""("(?:[^"]|"")*"|'(?:[^']|'')*'|\[(?:[^\[\]]|\[[^\[\]]*\])*\])"""
NAME = r"([\p{L}\p{M}\p{N}_.]+)\("
PREFIX = r"^(?:@|_XLFN\.|_XLWS\.|_XLUDF\.)+"
PARSE_ERROR = "=<parse_error:"
WORD = 64
#: Where a word of a bitmap lies.
WORDS = ["path", "sheet_idx", "col_idx", "block"]


def called_names(formula: Column) -> Column:
    """Array of the function names called in a formula, upper case, with repeats."""
    bare = F.regexp_replace(formula, HIDDEN, '"')
    found = F.regexp_extract_all(bare, F.lit(NAME), F.lit(1))
    names = F.transform(found, lambda x: F.regexp_replace(F.upper(x), PREFIX, ""))
    return F.when(
        formula.isNull() | formula.startswith(PARSE_ERROR), F.array().cast("array<string>")
    ).otherwise(F.filter(names, lambda x: x.rlike(r"[\p{L}_]")))


def term_bitmaps(formulas: DataFrame) -> DataFrame:
    """The vertical layout: ``term, path, sheet_idx, col_idx, block, bits, calls``, only words that are not 0.

    The empty term stands in every record.
    """
    word = WORDS
    cells = (
        formulas.select(
            "path", "sheet_idx", "col_idx",
            F.floor(F.col("row_idx") / WORD).alias("block"), "row_idx", "seq", "formula",
        )
        .repartition(*word)
        .groupBy(*word, "row_idx")
        .agg(F.max_by("formula", F.struct("seq", "formula")).alias("formula"))
    )
    bit = F.expr(f"shiftleft(1L, CAST(coalesce(pmod(row_idx, {WORD}), 0) AS INT))")
    return (
        cells.select(*word, bit.alias("bit"), F.explode(F.concat(F.array(F.lit("")), called_names(F.col("formula")))).alias("term"))
        .groupBy(*word, "term")
        .agg(F.bit_or("bit").alias("bits"), F.count("*").alias("calls"))
    )


def union(bitmaps: DataFrame) -> DataFrame:
    """Bitmaps of several deliveries in one: words of one place merge by bitwise or, counters add up.

    The counters are those of calls, so deliveries must not repeat a record with another formula.
    """
    return bitmaps.groupBy("term", *WORDS).agg(F.bit_or("bits").alias("bits"), F.sum("calls").alias("calls"))


def containers(bitmaps: DataFrame) -> DataFrame:
    """Compressed for keeping: per term and column the sorted blocks with their words, ``term, path, sheet_idx, col_idx, words, n_records, n_calls``."""
    own = F.sort_array(F.collect_list(F.struct("block", "bits")))
    return bitmaps.groupBy("term", "path", "sheet_idx", "col_idx").agg(
        own.alias("words"), F.sum(F.bit_count("bits").cast("bigint")).alias("n_records"), F.sum("calls").alias("n_calls")
    )


def term_frequency(formulas: DataFrame, rare_below: int = 3, common_above: float = 0.15) -> DataFrame:
    """One row per term: ``term, n_calls, n_records, total_records, mark``.

    ``mark`` is 'rare' below ``rare_below`` records, else 'common' above the share
    ``common_above`` of all records, else 'kept'.
    """
    return frequencies(term_bitmaps(formulas), rare_below, common_above)


def frequencies(words: DataFrame, rare_below: int = 3, common_above: float = 0.15) -> DataFrame:
    """The same from bitmaps: cardinalities of a term's words, summed."""
    # the vocabulary, written once: its empty term, which every record holds, has the total
    terms = cut(words.groupBy("term").agg(F.sum("calls").alias("n_calls"), F.sum(F.bit_count("bits").cast("bigint")).alias("n_records")))
    total = terms.filter("term = ''").select(F.max("n_records")).scalar()
    mark = (
        F.when(F.col("n_records") < rare_below, "rare")
        .when(F.col("n_records") > F.col("total_records") * common_above, "common")
        .otherwise("kept")
    )
    return terms.filter("term <> ''").withColumn("total_records", total).select("term", "n_calls", "n_records", "total_records", mark.alias("mark"))
