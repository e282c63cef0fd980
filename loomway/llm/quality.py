"""Line-first quality cleaning, with DataFrame functions only.

Every line is judged by itself (punctuation, symbols, navigation, boilerplate, no letter or digit); lines that fail
are removed, and a document that loses more than half of its word characters is rejected. A few document statistics
reject on their own: too few words, or too many words in repeated five-word windows.

Defined results: a null text has no words and is rejected; lines without a word are neither judged nor counted;
repeated rows are judged alike; an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import table
from .common import SPACES, chars_in, with_new_text, without, words_of

SYMBOLS = "#*$%&|<>"
MARKS, LINE_SYMBOLS, SEPARATORS = "!?", "#*$%&<>=~^_", "|»«•·›"
BOILERPLATE = r"(?i)(all rights reserved|cookie policy|terms of (use|service)|privacy policy|enable javascript|lorem ipsum|click here|subscribe to our|skip to (main )?content)"
WINDOW = 5
#: Percent of a line's word characters beyond which marks, symbols and separators fail it, and the least number of each.
MARK_PCT, SYMBOL_PCT, SEPARATOR_PCT = 15, 15, 5
LEAST_MARKS, LEAST_SYMBOLS, LEAST_SEPARATORS, BOILER_CHARS = 4, 4, 2, 120


def word_chars(c: Column) -> Column:
    return F.length(without(c, SPACES))


def line_fails(line: Column) -> Column:
    """Whether a line that has words is to be removed."""
    n = word_chars(line)

    def many(chars: str, least: int, pct: int) -> Column:
        k = chars_in(line, chars)
        return (k >= least) & (k * 100 > n * pct)

    return (
        many(MARKS, LEAST_MARKS, MARK_PCT)
        | many(LINE_SYMBOLS, LEAST_SYMBOLS, SYMBOL_PCT)
        | many(SEPARATORS, LEAST_SEPARATORS, SEPARATOR_PCT)
        | ~line.rlike(r"[\p{L}\p{N}]")
        | ((n <= BOILER_CHARS) & line.rlike(BOILERPLATE))
    )


def _repeats(df: DataFrame) -> DataFrame:
    """Adds ``_rep``, the number of words in windows found twice or more; ``_words`` must be there."""
    at = lambda i, k: F.get(F.col("_words"), i + k)
    spans = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW)).otherwise(F.expr("array()").cast("array<int>"))
    df = df.withColumn("_h", F.transform(spans, lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    # only texts with some repeated window are sorted; there equal windows become neighbours
    df = df.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, k: F.coalesce(F.get(F.col("_s"), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("_s"), k + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_pos", F.sort_array(F.transform(F.filter("_s", near), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    total = F.aggregate("_pos", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return df.withColumn("_rep", F.coalesce(total, F.lit(0))).drop("_h", "_s", "_pos")


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the input row as a struct), the statistics, ``lines`` (those that pass, in order), ``base_failed`` and ``kept``."""
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.withColumn("_words", words_of(F.col("_t")))
    df = _repeats(df).withColumn("_n", F.size("_words")).drop("_words")
    has_word = lambda x: F.length(F.trim(F.translate(x, SPACES[1:], " " * 5))) > 0
    df = df.withColumn("_lines", F.split("_t", "\n"))
    df = df.withColumn("_full", F.filter("_lines", has_word))
    df = df.withColumn("_good", F.filter("_full", lambda x: ~line_fails(x)))
    total = word_chars(F.col("_t"))
    left = F.aggregate("_good", F.lit(0), lambda a, x: a + word_chars(x))
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    df = df.select(
        "row",
        F.col("_n").cast("long").alias("n_words"),
        total.cast("long").alias("word_chars"),
        chars_in(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.col("_rep").cast("long").alias("n_repeat_words"),
        left.cast("long").alias("left_chars"),
        F.col("_good").alias("lines"),
    )
    # the partition's number (never below 0) keeps later filters from being pushed below and computing all of this again
    verdict = ~F.col("base_failed") & (F.col("left_chars") * 2 >= F.col("word_chars")) & (F.spark_partition_id() >= 0)
    return df.withColumn("base_failed", base).withColumn("kept", verdict)


def clean(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents that pass, without the lines that failed; same columns. ``size_col``, if there, is counted anew."""
    good = judge(docs, text_col).filter("kept").select("row", F.array_join("lines", "\n").alias("text"))
    return with_new_text(good, docs.columns, text_col, size_col)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _count(c: str, chars: str) -> str:
    return f"(length({c}) - length(translate({c}, '{chars}', '')))"


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_N = f"length(translate(l, {_WS}, ''))"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS k FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) u(i)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, sum(least(5, coalesce(i - prev, 5))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS prev FROM p) GROUP BY r),
l AS (SELECT r, l FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE length(translate(l, {_WS}, '')) > 0),
ll AS (SELECT r, l, {_N} AS n FROM l),
lf AS (SELECT r, l, n,
    ({_count("l", MARKS)} >= {LEAST_MARKS} AND {_count("l", MARKS)} * 100 > n * {MARK_PCT})
    OR ({_count("l", LINE_SYMBOLS)} >= {LEAST_SYMBOLS} AND {_count("l", LINE_SYMBOLS)} * 100 > n * {SYMBOL_PCT})
    OR ({_count("l", SEPARATORS)} >= {LEAST_SEPARATORS} AND {_count("l", SEPARATORS)} * 100 > n * {SEPARATOR_PCT})
    OR NOT regexp_matches(l, '[\p{{L}}\p{{N}}]')
    OR (n <= {BOILER_CHARS} AND regexp_matches(l, '{BOILERPLATE}')) AS bad FROM ll),
ls AS (SELECT r, count(*) - count(DISTINCT l) AS dups, sum(n) FILTER (NOT bad) AS good FROM lf GROUP BY r),
s AS (SELECT doc_id, len(ws) AS n_words, length(translate(t, {_WS}, '')) AS word_chars, {_count("t", SYMBOLS)} AS n_symbols,
    coalesce(dups, 0) AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(good, 0) AS good
    FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN ls USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND good * 2 >= word_chars AS kept FROM s
"""
