"""Exact duplicates by content sort, with DataFrame functions only.

Sampled splitters range-partition the rows on the head of their normalised bytes, an external sort places equal
texts side by side, and neighbours are compared in full. A text with very many copies is cut into several runs
that may lie in different partitions; what the runs found is then summed.

Defined results: a null text counts as empty; rows with a null id never stay while a copy has an id; of rows that
repeat an id and a text, one stays; an empty table gives an empty result. Columns other than id and text are not
looked at, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import materialize, table
from .common import ascii_lower, small

#: Code points of a text that the splitters look at; texts alike beyond it are told apart by a hash and then in full.
HEAD = 48


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", run_rows: int = 1000) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    keep: which id of a group stays, ``smallest`` or ``largest``. run_rows: copies of one text that a run holds, about.
    """
    best = F.max if keep == "largest" else F.min
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("body")).withColumn("h", F.xxhash64("body"))
    hot = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > run_rows).select("h", F.ceil(F.col("n") / run_rows).alias("runs")))
    rows = rows.join(small(hot), "h", "left")
    rows = rows.select("id", "body", "h", F.substring("body", 1, HEAD).alias("head"), F.coalesce(F.pmod(F.xxhash64("id"), F.col("runs")), F.lit(0)).alias("run"), F.col("runs").isNotNull().alias("cut"))
    run = Window.partitionBy("head", "h", "run", "body")
    first = run.orderBy(F.desc_nulls_last("id") if keep == "largest" else F.asc_nulls_last("id"))
    runs = rows.repartitionByRange("head", "h", "run").select(
        "id", "cut", F.row_number().over(first).alias("place"), F.count("*").over(run).alias("size"), best("id").over(run).alias("top"), F.sha2("body", 256).alias("digest")
    )
    runs = materialize(runs)
    heads = runs.filter("cut and place = 1").groupBy("digest").agg(best("top").alias("all_top"), F.sum("size").alias("all_size"))
    keep_id, size = F.coalesce("all_top", "top"), F.coalesce("all_size", "size")
    return runs.join(small(materialize(heads)), "digest", "left").select(
        F.col("id").alias("doc_id"),
        keep_id.alias("keep_id"),
        size.cast("long").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM d WINDOW g AS (PARTITION BY body)
"""
