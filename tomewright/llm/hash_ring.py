"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of points. A row's key (its id and text) hashes to a point, each shard to many points (its
virtual nodes), and a row's home is the first node at its point or clockwise of it. No shard takes more than its share:
rows that a full shard can't take continue clockwise to the next node, round by round, and home rows go before
visitors. Spark counts the rows of each point; how much of a point goes where follows from these counts alone, a table
of the ring's size; and rows find their place in it by their rank in their point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.llm import textnum as tn
from tomewright.llm.common import only, read_table, stage_table

SHARDS, NODES, POINTS = 40, 256, 1 << 16
#: Equal rows beyond so many count as a key of their own, and more of them as further ones.
COPIES = 1024


def ring_nodes(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Positions (64 bits, ascending) of all virtual nodes, and their shards. A further shard adds nodes and moves none."""
    shard = np.repeat(np.arange(shards), nodes)
    key = (shard.astype(np.uint64) << np.uint64(32)) + np.tile(np.arange(nodes), shards).astype(np.uint64)
    at = tn.mix(tn.mix(key + np.uint64(tn.BASE)))
    order = np.argsort(at, kind="stable")
    return at[order], shard[order]


def place_points(counts: np.ndarray, shards: int, nodes: int = NODES, slack: float = 0.0) -> pd.DataFrame:
    """``point, lo, hi, shard, slot, home, steps``: ranks lo to hi - 1 of a point's rows go to a shard, from a slot on.

    ``counts`` has the rows of each point. A shard takes (1 + slack) times the mean at most; without slack shares differ
    by one row and are all filled. In a round, points offer what is left to the next node, in ring order. There are at
    most as many rows as points, and one more for each shard and round.
    """
    total, points = int(counts.sum()), len(counts)
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    if slack:
        room[:] = -(-total * (1 + slack) // shards)
    at, owner = ring_nodes(shards, nodes)
    # a node stands at the start of its point, so that its own point's rows are at home with it
    home = np.searchsorted((at >> np.uint64(32)).astype(np.int64) * points >> 32, np.arange(points)) % len(at)
    done, load, found = np.zeros(points, np.int64), np.zeros(shards, np.int64), []
    for step in range(len(at)):
        p = np.flatnonzero(done < counts)
        if not len(p):
            break
        to = owner[(home[p] + step) % len(at)]
        p = p[order := np.argsort(to, kind="stable")]
        to, left = to[order], (counts - done)[p]
        before = np.cumsum(left) - left
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        before -= np.repeat(before[starts], np.diff(np.r_[starts, len(to)]))
        got = np.clip(room[to] - load[to] - before, 0, left)
        p, to, before, got = (x[got > 0] for x in (p, to, before, got))
        found.append(np.stack([p, done[p], done[p] + got, to, load[to] + before, owner[home[p]], np.full(len(p), step)]))
        done[p] += got
        np.add.at(load, to, got)
    rows = np.concatenate(found, axis=1) if found else np.zeros((7, 0), np.int64)
    return pd.DataFrame(dict(zip(("point", "lo", "hi", "shard", "slot", "home", "steps"), rows.astype(np.int64))))


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, slack: float = 0.0, points: int = POINTS, copies: int = COPIES) -> DataFrame:
    """Each row's shard and slot: ``id_col, size, text_crc32, shard, slot, home, steps``.

    Without slack the shards' row counts differ by one at most. ``size`` is the text's UTF-8 bytes plus 16, a null text
    having none, and the crc of no bytes; ``slot`` numbers a shard's rows from 0; ``home`` is the shard of the row's
    point, from which it went ``steps`` nodes on. The key is id and text, so rows of one id, or of none, are spread;
    equal rows are counted, not sorted, and every 1,024 of them are a key of their own. What goes to the driver and
    is broadcast is bounded by ``points``. An empty table gives an empty result; further columns are dropped; the same
    rows give the same shards, whatever their order.
    """
    if not 0 < shards * nodes <= points:
        raise ValueError("there have to be as many points as virtual nodes")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    rows = only(docs, id_col, text_col).toDF("id", "text")
    rows = rows.select("id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.xxhash64("id", "text").alias("h"))
    rows = rows.groupBy("h", "id", "size", "crc").agg(F.count("*").alias("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / copies))).alias("part"))
    n = F.least(F.col("n") - F.col("part") * copies, F.lit(copies).cast("long")).alias("n")
    point = F.pmod(F.xxhash64("h", "part", F.lit("ring")), F.lit(points)).alias("point")
    keys = stage_table(rows.select(point, "h", "part", "id", "size", "crc", n), "ring-keys")
    counts = np.zeros(points, np.int64)
    for p, total in keys.groupBy("point").agg(F.sum("n")).collect():
        counts[p] = total
    plan = F.broadcast(spark.createDataFrame(place_points(counts, shards, nodes, slack), "point long, lo long, hi long, shard long, first long, home long, steps long"))
    before = Window.partitionBy("point").orderBy("h", "part", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, 0)
    ranked = keys.withColumn("at", F.sum("n").over(before) - F.col("n"))
    met = ranked.join(plan, "point").where("at < hi and at + n > lo")
    lo, hi = F.greatest("at", "lo") - F.col("lo") + F.col("first"), F.least(F.col("at") + F.col("n"), F.col("hi")) - F.col("lo") + F.col("first")
    out = met.select("id", "size", "crc", "shard", "home", "steps", F.explode(F.sequence(lo, hi - 1)).alias("slot"))
    return out.select(F.col("id").cast(kind).alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot", F.col("home").cast("int").alias("home"), "steps")


def op13_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards under the law ``rows``: counts differ by one at most, as shares have no slack."""
    out = assign_shards(read_table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "home", "steps")
