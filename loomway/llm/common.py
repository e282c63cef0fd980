"""Expressions and small helpers shared by the text operators.

A null text has no words and, where characters are counted, a null count. A null id is never among given ids unless
these hold a null themselves; then it may be. Rows travel as one struct, so their columns may have any names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: The white space that separates words; nothing else does.
SPACES = " \t\n\x0b\x0c\r"
#: Rows up to which a checked small table is broadcast.
BROADCAST_ROWS = 50_000


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Python workers get whole texts in batches of at most so many rows, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank texts."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1)))
    return F.filter(F.split(flat, " +"), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def chars_in(text: Column, chars: str) -> Column:
    """How many of a text's code points are among ``chars``."""
    return F.length(text) - F.length(without(text, chars))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


#: Bits of the filter made by ``flag_perhaps``, at most; beyond that many ids it lets more through.
FILTER_BITS = 1 << 26
_PAGE = 1 << 15


def flag_perhaps(rows: DataFrame, key: Column, ids: DataFrame, hashed: bool = False) -> DataFrame:
    """``row`` (each row as a struct) and ``perhaps``, whether ``key`` may be among ``ids`` (one column of its type): true for all that
    are, and for some that are not. The bitmaps that are broadcast hold 8 MB at most, whatever the number of ids; a later
    join then need not move the rest. hashed: ``ids`` are hashes (``xxhash64``) already."""
    pages, n = 1, ids.count()
    while pages * _PAGE < min(16 * n, FILTER_BITS):
        pages *= 2
    bit = lambda h: F.pmod(h, F.lit(pages * _PAGE))
    mark = F.col(ids.columns[0])
    marks = ids.select(bit(mark if hashed else F.xxhash64(mark)).alias("b")).groupBy(F.floor(F.col("b") / _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("b") % _PAGE).alias("map"))
    out = rows.select(F.struct("*").alias("row"), bit(F.xxhash64(key)).alias("bit")).join(F.broadcast(materialize(marks)), F.floor(F.col("bit") / _PAGE) == F.col("page"), "left")
    byte = f"cast(conv(hex(substring(map, cast(bit % {_PAGE} div 8 + 1 as int), 1)), 16, 10) as int)"
    return out.select("row", F.expr(f"coalesce(shiftright({byte}, cast(bit % 8 as int)) & 1 = 1, false)").alias("perhaps"))


def with_new_text(found: DataFrame, columns: list[str], text_col: str, size_col: str | None) -> DataFrame:
    """``row`` with ``text`` in place of its own and, if the row has it, its size counted anew; the same columns."""
    new = {text_col: F.col("text")} | ({size_col: F.length("text").cast("long")} if size_col in columns else {})
    return found.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns))

