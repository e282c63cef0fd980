"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; a mask marks the assistant's messages, the ones to learn from. A participant is a distinct role.

Long conversations come in parts of at most ``part_turns`` turn numbers, so that no row or task holds an unbounded
dialogue: the parts of a perspective, one after the other, are the whole dialogue.

Tags are ``<|...|>``. In texts and roles a backslash is put between ``<`` and ``|``, after any that are there already,
and in roles between ``|`` and ``>`` too; so nothing said or named can open or end a message, and taking one backslash
away from each such place gives back what was there.

Defined results: turns are ordered by number, then role, then text; a null turn number comes first, in part -1; a null
role is the speaker ``unknown``; a null text is an empty message; repeated rows are repeated messages; a very long text
is one message; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import table

UNKNOWN = "unknown"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def escaped_name(c: Column) -> Column:
    return F.regexp_replace(escaped(c), r"\|(\\*)>", r"|$1\\>")


def rotate(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = 512) -> DataFrame:
    """``conv_id, part, speaker, n_messages, n_target, mask, messages, rendered, target_chars``, one row per part and participant."""
    t = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(UNKNOWN)).alias("role"),
        escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long"))
    parts = t.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    speakers = t.groupBy("conv_id", "role").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker"))
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    mine = lambda m: m["role"] == F.col("speaker")
    seen = seen.withColumn(
        "messages",
        F.transform("said", lambda m: F.struct(F.when(mine(m), "assistant").otherwise("user").alias("role"), m["role"].alias("name"), m["text"].alias("content"), F.when(mine(m), 1).otherwise(0).alias("target"))),
    )
    head = lambda m: F.when(m["target"] == 1, F.lit("<|assistant|>")).otherwise(F.concat(F.lit("<|user name="), escaped_name(m["name"]), F.lit("|>")))
    return seen.select(
        "conv_id",
        "part",
        "speaker",
        F.size("messages").cast("long").alias("n_messages"),
        F.size(F.filter("messages", lambda m: m["target"] == 1)).cast("long").alias("n_target"),
        F.array_join(F.transform("messages", lambda m: m["target"].cast("string")), "").alias("mask"),
        "messages",
        F.array_join(F.transform("messages", lambda m: F.concat(head(m), F.lit("\n"), m["content"], F.lit("<|end|>\n"))), "").alias("rendered"),
        F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + m["target"] * F.length(m["content"])).alias("target_chars"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations")).drop("messages")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS text,
    coalesce(floor(turn / 512), -1)::BIGINT AS part FROM conversations),
s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t)
SELECT conv_id, part, speaker, count(*) AS n_messages, count(*) FILTER (role = speaker) AS n_target,
    string_agg(CASE WHEN role = speaker THEN '1' ELSE '0' END, '' ORDER BY turn NULLS FIRST, role, text) AS mask,
    string_agg(CASE WHEN role = speaker THEN '<|assistant|>' ELSE '<|user name=' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') || '|>' END || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
    coalesce(sum(length(text)) FILTER (role = speaker), 0)::BIGINT AS target_chars
FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.c GROUP BY ALL
"""
