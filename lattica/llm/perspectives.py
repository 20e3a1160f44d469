"""Chat formatting with the perspective rotated over all participants.

For every participant (each role but ``system``) the whole dialogue is rendered with that speaker as the assistant and
the others as named users; only what the assistant says is trained on, without its header. The rendering is a row for
each turn with its place in the text, so that a conversation of any length needs no single large value: joined in order
of char_start, the segments are the text, and the characters from train_start to train_end are its loss mask.

Defined cases: marks (``<|``) in names and texts are written ``<\\|``, so that none can be forged; a null role is a
participant of its own, whose perspective is null and whose name is empty; a null text is empty; a null turn comes first;
turns with the same number follow by role and text, and repeated rows are turns of their own; each row without conv_id is
a conversation of one turn; a conversation of system turns alone has no participant and no row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm._common import table

SYSTEM = "system"


def rotated(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, trained, char_start, train_start, train_end, segment)."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    # a seat is told from every other, also a null role from an empty one
    seat = F.when(F.col("role").isNull(), "").otherwise(F.concat(F.lit("="), "role"))
    said = turns.select("conv_id", "turn", "role", seat.alias("seat"), safe(F.coalesce("text", F.lit(""))).alias("text"))
    system = F.lit(f"={SYSTEM}")
    known = said.filter("conv_id is not null")
    seats = known.filter(F.col("seat") != system).select(F.col("conv_id").alias("seat_conv"), F.col("role").alias("perspective"), F.col("seat").alias("own")).distinct()
    both = known.join(seats, F.col("conv_id") == F.col("seat_conv")).drop("seat_conv")
    alone = said.filter(F.col("conv_id").isNull() & (F.col("seat") != system)).withColumns({"perspective": F.col("role"), "own": F.col("seat")})
    trained = F.col("seat") == F.col("own")
    head = F.when(trained, F.lit("<|assistant|>")).when(F.col("seat") == system, F.lit("<|system|>")).otherwise(F.concat(F.lit("<|user name="), safe(F.coalesce("role", F.lit(""))), F.lit("|>")))
    shown = lambda df: df.withColumns({"trained": trained, "head": head}).withColumn("segment", F.concat("head", F.lit("\n"), "text", F.lit("<|end|>\n")))
    order = Window.partitionBy("conv_id", "own").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    start = F.coalesce(F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shown(both).withColumn("char_start", start).unionByName(shown(alone).withColumn("char_start", F.lit(0).cast("long")))
    begin = F.when(F.col("trained"), F.col("char_start") + F.length("head") + 1)
    end = F.when(F.col("trained"), F.col("char_start") + F.length("segment") - 1)
    return placed.select("conv_id", "perspective", "turn", "trained", "char_start", begin.alias("train_start"), end.alias("train_end"), "segment")


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH said AS (SELECT conv_id, turn, role, CASE WHEN role IS NULL THEN '' ELSE '=' || role END AS seat, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations),
seats AS (SELECT DISTINCT conv_id, role AS perspective, seat AS own FROM said WHERE seat <> '=system' AND conv_id IS NOT NULL),
both_sides AS (
  SELECT s.*, p.perspective, p.own, false AS alone FROM said s JOIN seats p ON s.conv_id = p.conv_id
  UNION ALL SELECT s.*, s.role, s.seat, true FROM said s WHERE conv_id IS NULL AND seat <> '=system'),
headed AS (
  SELECT *, seat = own AS trained,
    CASE WHEN seat = own THEN '<|assistant|>' WHEN seat = '=system' THEN '<|system|>'
         ELSE '<|user name=' || replace(coalesce(role, ''), '<|', '<\|') || '|>' END AS head FROM both_sides),
shown AS (SELECT *, head || chr(10) || text || '<|end|>' || chr(10) AS segment FROM headed),
placed AS (SELECT *, CASE WHEN alone THEN 0 ELSE coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, own, alone ORDER BY turn NULLS FIRST, role NULLS FIRST, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS char_start FROM shown)
SELECT conv_id, perspective, turn, trained, CAST(char_start AS BIGINT) AS char_start,
  CAST(CASE WHEN trained THEN char_start + length(head) + 1 END AS BIGINT) AS train_start,
  CAST(CASE WHEN trained THEN char_start + length(segment) - 1 END AS BIGINT) AS train_end, segment
FROM placed
"""
