"""Multi-party perspective rotation of dialogues.

For each participant of a conversation the dialogue is rendered with that speaker as
``assistant``, the others as users with their names, and a loss mask over the speaker's
own words. Roles in ``context`` (system turns) are no participants and keep their role.

A conversation may hold any share of all rows, so a rendering is a sequence of segments
of at most ``SEGMENT`` turns. Turns get their number from a range sort: each range
numbers its own turns and adds the numbers of turns in the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import dealt, durable, table

SEGMENT = 64
CONTEXT = ("system",)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text, at): turns with their 0-based place, ordered by turn, role and text.

    Nulls come first; equal turns keep one place each.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = turns.repartitionByRange(partitions, *order).withColumn("range", F.spark_partition_id())
    # The ranges must not be drawn anew, so they are written once.
    ranged = durable(ranged, "turns")
    inside = Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text")
    counts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("conv_id").alias("c"), F.col("range").alias("r"), "before")
    numbered = ranged.withColumn("own", F.row_number().over(inside))
    return numbered.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).select("conv_id", "role", "text", (F.col("own") - 1 + F.col("before")).alias("at"))


def rotate_perspectives(conversations: DataFrame, context: tuple[str, ...] = CONTEXT, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, speaker, segment, n_turns, n_own, rendered, mask) for each participant of each conversation.

    ``rendered`` is one ``<|role|>`` line and the text for each turn; ``mask`` lists
    start:end of the speaker's own texts in it as code points, end exclusive, joined by
    commas. A segment without a turn of the speaker has an empty mask. A null text is an
    empty turn, a null role a participant named ``unknown``; turns without a conv_id are
    one conversation. A conversation of context turns only has no rows. ``segment`` above
    the longest conversation gives whole renderings, each of which must then fit a task. Repeated rows are
    repeated turns. Other columns are ignored.
    """
    turns = numbered_turns(conversations).withColumn("segment", F.floor(F.col("at") / segment).cast("long"))
    blocks = turns.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    speakers = turns.filter(~F.col("role").isin(*context)).select("conv_id", F.col("role").alias("speaker")).distinct()
    # Segments of one conversation are dealt over tasks; conversations without an id are joined under a name of their own.
    named = {"c": F.coalesce("conv_id", F.lit(0)), "unnamed": F.col("conv_id").isNull()}
    pairs = dealt(blocks.withColumns(named), speakers.withColumns(named).drop("conv_id"), ["c", "unnamed"], ["segment"])
    own = lambda t: t["role"] == F.col("speaker")
    head = lambda t: F.when(own(t), F.lit("<|assistant|>\n")).when(t["role"].isin(*context), F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), own(t).alias("own")))
    pairs = pairs.withColumn("parts", parts)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def span(a, p):
        begin = a["at"] + F.length(p["head"])
        end = begin + F.length(p["text"])
        added = F.when(p["own"], F.concat(a["spans"], F.array(F.concat_ws(":", begin.cast("string"), end.cast("string"))))).otherwise(a["spans"])
        return F.struct((end + 1).alias("at"), added.alias("spans"))

    mask = F.aggregate("parts", start, span, lambda a: F.array_join(a["spans"], ","))
    rendered = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit("\n"))), "")
    return pairs.select("conv_id", "speaker", "segment", F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"), rendered.alias("rendered"), mask.alias("mask"))


def op1_perspectives(spark, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (
  SELECT t.conv_id, speaker, CAST(floor(place / {SEGMENT}) AS BIGINT) AS segment, place, text, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
m AS (SELECT *, sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, speaker, segment ORDER BY place) - length(text) - 1 AS begin FROM p)
SELECT conv_id, speaker, segment, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(head || text || chr(10), '' ORDER BY place) AS rendered,
       coalesce(string_agg(CAST(CAST(begin AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begin + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (own), '') AS mask
FROM m GROUP BY conv_id, speaker, segment"""
