"""Chat formatting: the dialogue once from every participant's side.

For each participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as users named by their roles; the mask
gives the assistant's stretches, which alone are trained on. Turns of fixed
roles (``system``) keep their role and have no side of their own.

Dialogues are rendered in parts of ``PART`` turns, so that a conversation of
any length is spread over tasks. Turns are numbered without gathering a
conversation anywhere: rows are sorted by range over all tasks and written,
each task's rows are counted by conversation, and the counts of the tasks
before give a task's first number.

Only DataFrame functions are used.

Defined cases: rows equal in conversation, turn, role and text are one turn;
turns are in order of turn (nulls last), role, text; a null conversation id is
a conversation; a null role is ``unknown``; a null text is empty; the opening
mark ``<|`` inside a text or role is written ``< |``, and line ends in roles
become spaces; a conversation of fixed roles only has no sides; columns beyond
the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import shared_folder

PART = 64
FIXED = ("system",)


def numbered(turns: DataFrame) -> DataFrame:
    """Distinct turns (conv_id, turn, role, text) with their place in the conversation."""
    spark = turns.sparkSession
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    folder = shared_folder(spark, "turns")
    # the id holds the task in its high bits and the row's place within the task in its low 33 bits
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder).withColumn("task", F.shiftright("id", 33))
    counts = rows.groupBy("conv_id", "task").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks
    counts = counts.select(F.col("conv_id").alias("c"), F.col("task").alias("t"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(counts, rows.conv_id.eqNullSafe(counts.c) & (rows.task == counts.t)).select("conv_id", "turn", "role", "text", (F.col("id") + F.col("shift")).alias("place"))


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _turn(t: Column, speaker: Column) -> tuple[Column, Column]:
    """Head of a turn, and the stretch from its text to its end mark."""
    role = _safe(F.translate(t["role"], "\r\n", "  "))
    head = (
        F.when(t["role"] == speaker, F.lit("assistant"))
        .when(t["role"].isin(*FIXED), role)
        .otherwise(F.concat(F.lit("user name="), role))
    )
    return F.concat(F.lit("<|im_start|>"), head, F.lit("\n")), F.concat(_safe(t["text"]), F.lit("<|im_end|>\n"))


def perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, speaker, part, n_turns, text, mask) with mask an array of (start, end) in characters of the part's text."""
    own = numbered(turns)
    parts = own.groupBy("conv_id", F.floor(F.col("place") / part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    sides = own.where(~F.col("role").isin(*FIXED)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    both = parts.join(sides, parts.conv_id.eqNullSafe(sides.c))

    def step(acc: Column, t: Column) -> Column:
        head, body = _turn(t, F.col("speaker"))
        start = acc["n"] + F.char_length(head)
        end = start + F.char_length(body)
        mine = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))  # without the line end
        return F.struct(end.alias("n"), F.when(t["role"] == F.col("speaker"), F.concat(acc["mask"], mine)).otherwise(acc["mask"]).alias("mask"))

    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    return both.select(
        "conv_id", "speaker", F.col("part").cast("long").alias("part"), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(*_turn(t, F.col("speaker")))), "").alias("text"),
        F.aggregate("turns", none, step, lambda acc: acc["mask"]).alias("mask"),
    )


def report(turns: DataFrame) -> DataFrame:
    """The rendered sides, with the mask as text."""
    told = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return perspectives(turns).select("conv_id", "speaker", "part", "n_turns", F.size("mask").cast("long").alias("n_masked"), "text", told.alias("mask"))


SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS place FROM turns),
sides AS (SELECT DISTINCT conv_id, role AS speaker FROM placed WHERE role <> 'system'),
said AS (
  SELECT p.conv_id, speaker, place // 64 AS part, place, role = speaker AS mine,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN role
      ELSE 'user name=' || replace(replace(replace(role, chr(13), ' '), chr(10), ' '), '<|', '< |') END || chr(10) AS head,
    replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS body
  FROM placed p JOIN sides s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
measured AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY place) AS past FROM said)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (WHERE mine) AS n_masked, string_agg(head || body, '' ORDER BY place) AS text,
  coalesce(string_agg((past - length(body))::BIGINT || ':' || (past - 1)::BIGINT, ',' ORDER BY place) FILTER (WHERE mine), '') AS mask
FROM measured GROUP BY conv_id, speaker, part
"""
