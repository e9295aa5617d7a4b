"""Mixing of sources to target weights: fixed-length token blocks dealt by pseudorandom permutations. DataFrames only.

The words of a source, document after document, are cut into blocks of ``block`` words. A source with a target of t
words gets t / block slots: slot j of epoch e takes block P(j), where P is a permutation of the source's block numbers
(swap-or-not: a keyed involution a round, defined on any range). How many slots of a source each output shard has is
drawn first: a count vector by shard, multinomial given that the source's total is its target to within a block (a draw
of each shard by itself would miss the targets by the root of their slots). The sums of a source's counts are the
shards' ranges of its slots, whose blocks the permutation tells. Blocks and slots meet in a join on (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.llm.common import WORD, only, read_table, stage_table

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK, SHARD_SLOTS, ROUNDS, SEED = 64, 4096, 12, 20250131
#: Documents of a source whose offsets are summed in one task; slots that one row is unfolded to, and rows a task.
BUCKET_DOCS, CHUNK, TASK_CHUNKS = 4096, 4096, 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row a source: number ``sid`` in code point order (null last), size, documents, weight and target.

    Targets are in proportion to the weights, add up to ``share`` times all sizes and stop at ``most`` times a
    source's size; what is over goes to the other sources by weight. In the order of size / weight the sources that
    stop come first, so one running sum finds the level. The windows see one row a source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("sid", F.row_number().over(by_name) - 1)
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    level = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("source_size") * F.lit(most)
    before = F.coalesce(F.sum(limit).over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - before) / rest)
    each = each.withColumn("stops", F.col("level") * F.col("weight") >= limit)
    final = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    return each.withColumn("target", F.when(F.col("stops"), limit).otherwise(final * F.col("weight"))).drop("level", "stops")


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """Image of x in a pseudorandom permutation of 0..n-1 (Hoang, Morris, Rogaway: swap-or-not)."""

    # the round's hash is halved, so that taking x from it can't overflow
    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.shiftright(F.xxhash64(*key, r), 1) - x, n)
        high = F.greatest(x, partner)
        return F.when(F.xxhash64(*key, r, high).bitwiseAND(F.lit(1).cast("long")) == 1, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), x.cast("long"), turn)


def drawn_counts(chunks: DataFrame, seed: int) -> DataFrame:
    """``n``, how many of a source's slots each shard draws, and ``start``, the first of them: a multinomial draw by source.

    As many draws as the source has slots are counted by shard. Sums of the counts in the order of the shards are the
    shards' ranges of slots, and the last range ends where the target does.
    """
    last = F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1
    draws = chunks.select("*", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("draw"))
    shard = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "sid", "draw"), F.col("shards"))
    counts = draws.groupBy("sid", "blocks", "rest", "slots", shard.alias("shard")).agg(F.count("*").alias("n"))
    return counts.withColumn("start", F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n"))


def mixture_slots(sources: DataFrame, block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``sid, slot, shard, block, take``: which block each slot takes, and how many of its words (the last: a part).

    There are as many slots as words in the mix / block, so joins with them are marked as merge joins: the planner
    sees a row a source only and would broadcast them.
    """
    plan = sources.where("source_size > 0")
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("epochs", F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST).cast("long")))
    plan = plan.withColumn("rest", F.greatest(F.floor(F.col("target") - F.col("epochs") * F.col("source_size")), F.lit(0).cast("long")))
    plan = plan.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block)).where("slots > 0")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plan = plan.withColumn("shards", F.greatest(F.ceil(F.sum("slots").over(everything) / shard_slots), F.lit(1).cast("long")))
    chunks = plan.select("sid", "blocks", "rest", "slots", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
    tasks = max(1, -(-(plan.agg(F.sum(F.ceil(F.col("slots") / CHUNK))).first()[0] or 0) // TASK_CHUNKS))
    ranges = drawn_counts(chunks.repartition(tasks, "sid", "chunk"), seed)
    ranges = ranges.repartition(tasks, "sid", "shard")
    slots = ranges.select("*", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("slot"))
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks"))).withColumn("x", F.col("slot") % F.col("blocks"))
    part = (F.col("slot") == F.col("slots") - 1) & (F.col("rest") % block > 0)
    return slots.select(
        "sid",
        "slot",
        "shard",
        permuted(F.col("x"), F.col("blocks"), F.lit(seed), F.col("sid"), F.col("epoch")).alias("block"),
        F.when(part, F.col("rest") % block).otherwise(F.lit(block)).cast("int").alias("take"),
    )


def document_offsets(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with the source's row and the document's first word number in its source's stream.

    Documents are dealt to buckets of some thousand by a hash of their id; bucket totals are summed first, then
    each bucket by itself, so that no source, however large, is summed in one task.
    """
    named = sources.withColumnRenamed("source", "source2")
    docs = sizes.join(named, sizes.source.eqNullSafe(named.source2)).drop("source2")
    # with the size, as null ids may be many
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n_docs") / BUCKET_DOCS)))
    totals = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("total"))
    base = F.sum("total").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("total")
    totals = totals.select("sid", "bucket", base.alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return docs.join(totals, ["sid", "bucket"]).withColumn("first", F.col("base") + F.sum("size").over(inside) - F.col("size")).drop("bucket", "base")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document's words, and to how many output shards they go.

    Returns ``id_col, size, source_size, target, taken, n_shards``. Sizes are numbers of words; a null text has none,
    and neither has an empty one: nothing is taken of them. A null source is a source of its own, the last in order.
    Repeated rows are documents of their own; ties are broken by id and size; an empty table gives an empty result;
    further columns are dropped. The same input and seed give the same mix.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sizes = stage_table(only(docs, id_col, source_col, text_col).toDF("doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources = stage_table(source_targets(sizes), "sources")
    placed = document_offsets(sizes, sources)
    full = F.count(F.when(F.col("take") == block, 1)).alias("full")
    part = F.coalesce(F.max(F.when(F.col("take") < block, F.col("take"))), F.lit(0)).alias("part")
    # a block has a slot an epoch, and one more at the most
    by_slot = F.collect_list(F.struct("shard", "take")).alias("slots")
    takes = mixture_slots(sources, block, seed).groupBy("sid", "block").agg(full, part, by_slot)
    key = ["doc_id", "sid", "first", "size", "source_size", "target"]
    whole = placed.where("size > 0")
    spread = whole.select(*key, F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))).alias("block"))
    lo = F.greatest(F.col("first") - F.col("block") * block, F.lit(0).cast("long"))
    hi = F.least(F.col("first") + F.col("size") - F.col("block") * block, F.lit(block).cast("long"))
    spread = spread.withColumn("lo", lo).withColumn("hi", hi).join(takes.hint("merge"), ["sid", "block"], "left")
    got = F.coalesce(F.col("full") * (F.col("hi") - F.col("lo")) + F.greatest(F.least("hi", F.col("part").cast("long")) - F.col("lo"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    reached = F.transform(F.filter("slots", lambda x: x["take"] > F.col("lo")), lambda x: x["shard"])
    taken = spread.groupBy(*key).agg(F.sum(got).alias("taken"), F.array_distinct(F.flatten(F.collect_list(reached))).alias("shards"))
    taken = taken.withColumn("n_shards", F.size("shards").cast("long")).drop("shards")
    none = F.lit(0).cast("long")
    out = taken.unionByName(placed.where("size = 0").select(*key, none.alias("taken"), none.alias("n_shards")))
    return out.select(F.col("doc_id").cast(kind).alias(id_col), "size", "source_size", "target", "taken", "n_shards")


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself: ``shard, sid, slot, part, doc_id, words``; a slot's parts in order make its block of words."""
    texts = only(docs, id_col, source_col, text_col).toDF("doc_id", "source", "text").withColumn("size", word_count(F.col("text")))
    sources = stage_table(source_targets(texts.select("source", "size")), "sources")
    placed = document_offsets(texts, sources).where("size > 0")
    words = placed.select("doc_id", "sid", "first", "size", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("all"))
    spread = words.select("*", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))).alias("block"))
    lo = F.greatest(F.col("block") * block - F.col("first"), F.lit(0).cast("long"))
    at = F.greatest(F.col("first") - F.col("block") * block, F.lit(0).cast("long"))
    hi = F.least((F.col("block") + 1) * block - F.col("first"), F.col("size"))
    parts = spread.select("sid", "block", "doc_id", at.alias("part"), "all", lo.alias("lo"), hi.alias("hi"))
    parts = parts.select("sid", "block", "doc_id", "part", F.slice("all", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("words"))
    met = parts.join(mixture_slots(sources, block, seed).hint("merge"), ["sid", "block"]).where("part < take")
    return met.select("shard", "sid", "slot", "part", "doc_id", F.slice("words", F.lit(1), (F.col("take") - F.col("part")).cast("int")).alias("words"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))
