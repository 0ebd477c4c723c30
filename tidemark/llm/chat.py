"""Chat formatting by multi-party perspective rotation (operator 2, native).

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, the others
as users with their names, and system turns as they are; only the assistant's contents are to be trained on.
Speaker ``system`` is no participant. A dialogue is rendered in segments of at most ``segment_turns`` turns, so
that no row or task holds a conversation without bound; one of usual length is a single row.

Turns are ordered by (turn, role, text). A turn's place is found without a sort by conversation: rows are
range-partitioned by that order and numbered within (conversation, partition); partitions' counts give the rest.

Defined cases: rows repeated exactly are turns of their own, next to each other; a null text is an empty content;
a null role is a speaker named ``unknown``; null conv_id and turn are values of their own (nulls first);
a conversation of system turns only has no participant and no row; turns that tie in (turn, role, text) are equal rows; a
text of any length stays whole in its segment; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_hot, stored

START, END = "<|im_start|>", "<|im_end|>\n"


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """_conv, _turn, _role, _text and ``_at``, the turn's place in its conversation from 0; repeated rows expanded."""
    named = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit("unknown")).alias("_role"), F.coalesce(text, F.lit("")).alias("_text"))
    once = named.groupBy("_conv", "_turn", "_role", "_text").agg(F.count("*").alias("_copies"))
    order = ["_conv", "_turn", "_role", "_text"]
    dealt = stored(once.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "turns")
    here = Window.partitionBy("_conv", "_part").orderBy("_turn", "_role", "_text")
    inside = F.coalesce(F.sum("_copies").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A conversation has a row for each partition that it spans.
    parts = dealt.groupBy("_conv", "_part").agg(F.sum("_copies").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("_conv").alias("c"), F.col("_part").alias("p"), before.alias("_before"))
    placed = dealt.withColumn("_first", inside).join(parts, F.col("_conv").eqNullSafe(F.col("c")) & (F.col("_part") == F.col("p")))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    return placed.withColumn("_copy", copy).select("_conv", "_turn", "_role", "_text", (F.col("_before") + F.col("_first") + F.col("_copy")).alias("_at"))


def rotated(turns: DataFrame, segment_turns: int = 64, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation, participant and segment: the messages, the rendered text, and the spans to train on."""
    placed = numbered(turns, conv, turn, role, text).withColumn("_segment", F.floor(F.col("_at") / segment_turns))
    # A key that tells a null conversation from all others.
    key = F.coalesce(F.concat(F.lit("c"), F.col("_conv").cast("string")), F.lit("null"))
    segments = stored(placed.groupBy("_conv", "_segment").agg(F.sort_array(F.collect_list(F.struct("_at", "_turn", "_role", "_text"))).alias("_turns")).withColumn("_key", key), "segments")
    # The participants of a conversation are few; its segments need not be, and then do not meet in one task.
    talks = segments.select("_key", F.explode("_turns._role").alias("_as")).filter("_as != 'system'").distinct().groupBy("_key").agg(F.collect_set("_as").alias("_all"))
    talks = stored(talks.join(segments.groupBy("_key").agg(F.count("*").alias("_n")), "_key"), "talks")
    each = join_hot(segments, talks, "_key", "_n").withColumn("_as", F.explode("_all"))

    def message(t: Column) -> Column:
        kind = F.when(t["_role"] == "system", F.lit("system")).when(t["_role"] == F.col("_as"), F.lit("assistant")).otherwise(F.lit("user"))
        return F.struct(kind.alias("role"), F.when(kind == "user", t["_role"]).alias("name"), t["_text"].alias("content"), (kind == "assistant").alias("train"))

    each = each.withColumn("messages", F.transform("_turns", message))
    head = lambda m: F.concat(F.lit(START), m["role"], F.coalesce(F.concat(F.lit(" name="), m["name"]), F.lit("")), F.lit("\n"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def walk(s: Column, m: Column) -> Column:
        start = s["at"] + F.length(head(m))
        end = start + F.length(m["content"])
        return F.struct((end + len(END)).alias("at"), F.when(m["train"], F.concat(s["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["spans"]).alias("spans"))

    return each.select(
        F.col("_conv").alias("conv_id"),
        F.col("_as").alias("perspective"),
        F.col("_segment").alias("segment"),
        F.size("messages").alias("n_turns"),
        "messages",
        F.array_join(F.transform("messages", lambda m: F.concat(head(m), m["content"], F.lit(END))), "").alias("text"),
        F.aggregate("messages", nothing, walk)["spans"].alias("mask"),
    )


def rotation_report(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, segment, n_turns, the rendered text, and the mask as text: start-end pairs."""
    spans = F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return rotated(turns).select("conv_id", "perspective", "segment", "n_turns", "text", spans.alias("mask"))


#: The same rows in DuckDB.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS content,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
rendered AS (
  SELECT t.conv_id, perspective, t.pos // 64 AS segment, t.pos, content, role = perspective AS train,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(content) + 11) OVER (PARTITION BY conv_id, perspective, segment ORDER BY pos) - length(content) - 11 AS begins
  FROM rendered)
SELECT conv_id, perspective, segment, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg(head || content || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg(CASE WHEN train THEN CAST(CAST(begins AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + length(content) AS BIGINT) AS VARCHAR) END, ',' ORDER BY pos), '') AS mask
FROM placed GROUP BY conv_id, perspective, segment
"""
