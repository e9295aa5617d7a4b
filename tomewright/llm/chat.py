"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation again and again, each time a few turns longer. Every turn gets a hash of the turns up
to it (position, role and text, summed by exclusive or, 128 bits); a conversation whose whole hash is that of a proper
prefix of another is dropped by an anti-join; the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.llm.common import only, read_table, stage_table

#: Turns that are ordered and hashed in one task at a time, and turns of a rendered part.
SPAN, PART = 1024, 256


def prefix_hashes(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """``conv, pos, role, text, h1, h2``: position of each turn and hash of the conversation up to it.

    Turns are ordered by number (null first), then role and text. A long conversation is cut by turn number into
    spans; positions and hashes run inside a span, and what precedes it is added from the spans' totals.
    """
    turns = turns.withColumn("span", F.coalesce(F.floor(F.col("turn") / span), F.lit(-1 << 62)))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    counts = turns.groupBy("conv", "span").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv").alias("conv2"), F.col("span").alias("span2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    same = turns.conv.eqNullSafe(counts.conv2) & (turns.span == counts.span2)
    inside = Window.partitionBy("conv", "span").orderBy(*order)
    placed = turns.join(counts, same).withColumn("pos", F.col("before") + F.row_number().over(inside))
    cell = [F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text") for seed in (11, 23)]
    placed = placed.withColumns({"c1": cell[0], "c2": cell[1]})
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumns({f"r{k}": F.bit_xor(f"c{k}").over(running) for k in (1, 2)})
    sums = placed.groupBy("conv", "span").agg(F.bit_xor("c1").alias("s1"), F.bit_xor("c2").alias("s2"))
    sums = sums.select(F.col("conv").alias("conv2"), F.col("span").alias("span2"), *[F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    placed = placed.drop("conv2", "span2")
    same = placed.conv.eqNullSafe(sums.conv2) & (placed.span == sums.span2)
    return placed.join(sums, same).select("conv", "pos", "role", "text", *[F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in (1, 2)])


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """``conv, turns, copies``: conversations that are no proper prefix of another; of equal ones the least id."""
    last = hashed.groupBy("conv").agg(F.max("pos").alias("turns"))
    held = last.withColumnRenamed("conv", "conv2")
    rows = stage_table(hashed.join(held, hashed.conv.eqNullSafe(held.conv2)).select("conv", "pos", "h1", "h2", "turns"), "turn-prefixes")
    whole = rows.where("pos = turns").groupBy("turns", "h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    proper = rows.where("pos < turns").select(F.col("pos").alias("turns"), "h1", "h2").distinct()
    return whole.join(proper, ["turns", "h1", "h2"], "left_anti").select("conv", "turns", "copies")


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", span: int = SPAN, part: int = PART) -> DataFrame:
    """Maximal conversations, rendered: ``conv_col, part, turns, copies, rendered``.

    A turn is ``<|role|>``, a line break, its text and a line break; ``<|`` in a role or a text reads ``<\\|``, so that no
    text can pass for a turn. ``part`` turns make a row, so that no conversation
    need fit one row; its parts in order, concatenated, are the whole. ``turns`` are those of the conversation,
    ``copies`` the conversations equal to it. Null roles read ``unknown`` and null texts are empty, but neither equals
    a turn that says so; rows with a null id are one conversation; repeated rows are turns of their own; an empty table
    gives an empty result; further columns are dropped.
    """
    kind = conversations.schema[conv_col].dataType.simpleString()
    turns = only(conversations, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text")
    hashed = stage_table(prefix_hashes(turns, span), "turn-hashes")
    kept = maximal_conversations(hashed).withColumnRenamed("conv", "conv2")
    rows = hashed.join(kept, hashed.conv.eqNullSafe(kept.conv2))
    plain = lambda c, other: F.replace(F.coalesce(c, F.lit(other)), F.lit("<|"), F.lit("<\\|"))
    line = F.concat(F.lit("<|"), plain("role", "unknown"), F.lit("|>\n"), plain("text", ""), F.lit("\n"))
    groups = rows.groupBy("conv", F.floor((F.col("pos") - 1) / part).alias("part"), "turns", "copies")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x.line)
    return groups.agg(F.array_join(texts, "").alias("rendered")).select(F.col("conv").cast(kind).alias(conv_col), "part", "turns", "copies", "rendered")


def op6_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


OP6_SQL = rf"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos,
             role, text from conversations),
c as (select conv_id, list(struct_pack(r := role, t := text) order by pos) as turns from t group by conv_id),
p as (select distinct turns[1:k] as prefix from c, unnest(range(1, len(turns))) as u(k)),
m as (select min(conv_id) as conv_id, turns, count(*) as copies from c where turns not in (select prefix from p) group by turns)
select t.conv_id, (t.pos - 1) // {PART} as part, len(m.turns)::bigint as turns, m.copies,
  string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '<\|') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<\|') || chr(10), '' order by pos) as rendered
from t join m using (conv_id) group by t.conv_id, (t.pos - 1) // {PART}, m.turns, m.copies"""
