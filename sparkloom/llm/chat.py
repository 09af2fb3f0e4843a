"""Chat formatting: each dialogue from the perspective of each of its speakers, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cut


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: tuple[str, ...] = ("system",)) -> DataFrame:
    """Each conversation once for every participant, as turns in order: conv_id, perspective, turn, seq, role, name,
    rendered, start, mask_start, mask_end.

    A participant is a distinct speaker that isn't a system role. From a participant's perspective its own turns are the
    assistant's, those of others are a user's with their names, and system turns stay. `rendered` is a turn with its
    markers, and a rendering is its turns' `rendered` in the order of seq, `start` (code points) being the turn's place in
    it. The mask, mask_start to mask_end (end exclusive, code points of the rendering), is what the perspective's model
    learns: its own texts and their end markers; it is null for other turns. "<|" in a text becomes "< |", so that no text
    makes a marker.

    Order: turn (null first), then speaker, then text; rows alike stay, in any order. A null text is empty; a null speaker
    is a user named "unknown", and no participant; a null conv_id is a conversation of its own. A conversation without
    participants has no perspective and gives no rows, nor does an empty table; other columns are left out.

    A conversation may hold any share of all rows: turns are dealt by range, and a turn's place is the sum before it in its
    partition and that of earlier partitions, so no task holds a whole conversation.
    """
    picked = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("by"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    fixed = F.coalesce(F.col("by").isin(*system), F.lit(False))
    speakers = cut(picked.where(F.col("by").isNotNull() & ~fixed).select(F.col("conv_id").alias("_conv"), F.col("by").alias("perspective")).distinct())
    each = picked.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.coalesce(F.col("by") == F.col("perspective"), F.lit(False))
    name = F.coalesce("by", F.lit("unknown"))
    safe = F.replace("text", F.lit("<|"), F.lit("< |"))
    head = F.when(own, F.lit("<|im_start|>assistant\n")).when(fixed, F.lit("<|im_start|>system\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), F.replace(name, F.lit("<|"), F.lit("< |")), F.lit("\n")))
    each = each.select("conv_id", "perspective", "turn", F.when(own, "assistant").when(fixed, "system").otherwise("user").alias("role"), name.alias("name"), own.alias("_own"), F.length(head).alias("_head"), F.concat(head, safe, F.lit("<|im_end|>\n")).alias("rendered"))
    order = [F.col("turn").asc_nulls_first(), F.col("name"), F.col("rendered")]
    dealt = cut(each.repartitionByRange(F.col("conv_id"), F.col("perspective"), *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("conv_id", "perspective", "_part").agg(F.sum(F.length("rendered")).alias("_chars"), F.count("*").alias("_rows"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    first = sums.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_part").alias("_q"), F.coalesce(F.sum("_chars").over(before), zero).alias("_chars"), F.coalesce(F.sum("_rows").over(before), zero).alias("_rows"))
    within = Window.partitionBy("conv_id", "perspective", "_part").orderBy(*order)
    ranked = dealt.withColumn("_seq", F.row_number().over(within) - 1).withColumn("_at", F.coalesce(F.sum(F.length("rendered")).over(within.rowsBetween(Window.unboundedPreceding, -1)), zero))
    placed = ranked.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("_part") == F.col("_q")))
    start = F.col("_chars") + F.col("_at")
    return placed.select(
        "conv_id", "perspective", "turn", (F.col("_rows") + F.col("_seq")).alias("seq"), "role", "name", "rendered", start.alias("start"),
        F.when(F.col("_own"), start + F.col("_head")).alias("mask_start"), F.when(F.col("_own"), start + F.length("rendered") - 1).alias("mask_end"))


#: What `rotate` gives on the table conversations.
SQL = """
WITH speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
turns AS (
  SELECT c.conv_id, s.perspective, c.turn, coalesce(c.role = s.perspective, false) AS own, coalesce(c.role = 'system', false) AS fixed,
    coalesce(c.role, 'unknown') AS name, replace(coalesce(c.text, ''), '<|', '< |') AS body
  FROM conversations c JOIN speakers s ON c.conv_id IS NOT DISTINCT FROM s.conv_id),
heads AS (
  SELECT *, CASE WHEN own THEN '<|im_start|>assistant' WHEN fixed THEN '<|im_start|>system' ELSE '<|im_start|>user name=' || replace(name, '<|', '< |') END || chr(10) AS head FROM turns),
rows_ AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM heads),
placed AS (
  SELECT *, row_number() OVER w - 1 AS seq, coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM rows_ WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, rendered))
SELECT conv_id, perspective, turn, seq::BIGINT AS seq, CASE WHEN own THEN 'assistant' WHEN fixed THEN 'system' ELSE 'user' END AS role, name, rendered,
  pos::BIGINT AS start, CASE WHEN own THEN (pos + length(head))::BIGINT END AS mask_start, CASE WHEN own THEN (pos + length(rendered) - 1)::BIGINT END AS mask_end
FROM placed
"""
