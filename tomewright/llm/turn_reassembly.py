"""Reassembly of conversation turns that arrive late, out of order and twice: keyed state in Structured Streaming.

A stateful query is started anew for each batch of arrivals, on one checkpoint. A group's state is a serialized min-heap
of kept turns that aren't released, and the set of kept turns with their roles. Arrivals are kept once; while the heap's
top is the next turn it is popped and released. Open groups time out in every batch, and the batch's number, which the
function closed over when the query started, tells whether they have been silent for long enough to close.

A group is a conversation's turns in a span of turn numbers, so that a conversation of any length is many groups. Each
group is told when any turn of its conversation arrives, so all of them open and close together; what a group releases
waits, after the stream, for the spans before it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tomewright.llm.common import read_table, stage_table
from tomewright.sources.shared import new_path

#: Turn numbers of a group, as a power of two; batches without an arrival that close a conversation.
SPAN_BITS, SILENT = 12, 2
BATCHES = 10
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"

KEY = ["conv", "span"]
#: ``turn`` is null in a row that only tells of an arrival elsewhere in the conversation, ``span`` in a batch's mark.
ARRIVALS = "conv string, span long, first long, turn long, role string, digest string"
#: ``detail`` is empty but for a group's close, where it has ``CLOSED`` as JSON.
EVENTS = "event string, conv string, span long, first long, turn long, digest string, batch int, detail string"
CLOSED = "left string, next long, kept long, top long, breaks long, low_role string, high_role string, complete int"
STATE = "heap string, roles string, next long, first long, last int, complete int, open boolean"


def _take_turns(batch: int, last: bool, bits: int, silent: int, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One group in one batch: keep and release its arrivals, or reject them; close it when its silence is long enough."""
    conv, span = key
    if span is None or pd.isna(span):
        return  # the mark that keeps an empty batch from being skipped
    span, out = int(span), []
    heap, roles, nxt, first, seen, complete, is_open = state.get if state.exists else ("[]", "{}", None, None, batch, None, True)
    heap, roles = [tuple(x) for x in json.loads(heap)], json.loads(roles)
    end = (span + 1) << bits
    arrived = [] if state.hasTimedOut else [r for f in frames for r in zip(f["first"], f["turn"], f["role"], f["digest"])]

    def event(name: str, turn: int, digest: str, detail: str = "") -> None:
        out.append((name, conv, span, first, turn, digest, batch, detail))

    if arrived:
        first = int(arrived[0][0])
        nxt = max(first, span << bits) if nxt is None else nxt
    for _, turn, role, digest in arrived:
        if turn is None or pd.isna(turn):
            continue
        turn = int(turn)
        if not is_open:
            event("reject", turn, digest)
        elif str(turn) not in roles:
            roles[str(turn)] = role
            heapq.heappush(heap, (turn, digest))
    if arrived and is_open:
        seen = batch
    while heap and heap[0][0] == nxt:
        turn, digest = heapq.heappop(heap)
        event("release", turn, digest)
        nxt += 1
    if nxt == end and complete is None:
        complete = batch
    if is_open and (last or batch - seen >= silent):
        is_open = False
        # the numbers that are left stay in the heap's order of size
        left = ",".join(str(t) for t, _ in sorted(heap))
        breaks = sum(roles.get(str(int(t) - 1)) == r for t, r in roles.items())
        top = max(map(int, roles), default=None)
        closed = {"left": left, "next": nxt, "kept": len(roles), "top": top, "breaks": breaks, "complete": complete}
        closed |= {"low_role": roles.get(str(span << bits)), "high_role": roles.get(str(end - 1))}
        event("close", -1, "", json.dumps(closed))
        heap, roles = [], {}
    state.update((json.dumps(heap), json.dumps(roles), nxt, first, seen, complete, is_open))
    if is_open:
        state.setTimeoutDuration(1)
    if out:
        yield pd.DataFrame(out, columns=[x.split()[0] for x in EVENTS.split(", ")])


def batched_arrivals(rows: DataFrame, bits: int = SPAN_BITS) -> DataFrame:
    """Rows ``batch, conv, turn, role, payload`` as arrivals of ``ARRIVALS``, with their batch.

    In a batch only a turn's smallest payload (by its bytes) arrives. ``first`` is the conversation's smallest turn. In
    a conversation of several spans each batch with an arrival tells all of them.
    """
    rows = stage_table(rows.where("turn is not null"), "turn-rows")
    least = rows.groupBy("batch", "conv", "turn").agg(F.min(F.struct("payload", "role")).alias("x"))
    span = F.shiftright("turn", bits)
    held = least.select("batch", "conv", span.alias("span"), "turn", F.col("x.role").alias("role"), F.sha2(F.encode("x.payload", "UTF-8"), 256).alias("digest"))
    held = stage_table(held, "arrivals")
    each = held.groupBy("conv").agg(F.min("turn").alias("first"), F.max("span").alias("high"), F.min("span").alias("low"))
    each = stage_table(each, "first-turns")
    arrivals = held.join(each.select("conv", "first"), "conv").select("batch", "conv", "span", "first", "turn", "role", "digest")
    many = each.where("high > low").select("conv", "first")
    spans = held.join(many, "conv", "left_semi").select("conv", "span").distinct()
    active = held.select("conv", "batch").distinct().join(many, "conv")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "string"))]
    told = active.join(spans, "conv").select("batch", "conv", "span", "first", *none)
    return arrivals.unionByName(told)


def reassemble(arrivals: DataFrame, batches: int, bits: int = SPAN_BITS, silent: int = SILENT) -> DataFrame:
    """Events of the groups, as ``EVENTS``: the arrivals of batch 0, 1, ... go through a stateful query that is started
    anew for each of them, empty ones included, and once more for the end, which closes what is open.

    All files lie in a new folder of the shared one, which goes when the driver ends. The file sink and the checkpoint
    make a batch's events count once, whatever is lost or started again.
    """
    spark = arrivals.sparkSession
    at = new_path(spark, "turns")
    marks = spark.range(batches + 1).select(F.col("id").cast("int").alias("batch"))
    every = arrivals.withColumn("batch", F.col("batch").cast("int")).unionByName(marks, allowMissingColumns=True)
    every.write.partitionBy("batch").parquet(f"{at}/waiting")
    spark.createDataFrame([], ARRIVALS).write.parquet(f"{at}/fed")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for batch in range(batches + 1):
        fs.rename(path(f"{at}/waiting/batch={batch}"), path(f"{at}/fed/batch-{batch:04d}"))
        feed = spark.readStream.schema(ARRIVALS).option("recursiveFileLookup", "true").parquet(f"{at}/fed")
        step = partial(_take_turns, batch, batch == batches, bits, silent)
        events = feed.groupBy(*KEY).applyInPandasWithState(_named(step), EVENTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
        writer = events.writeStream.format("parquet").outputMode("append").option("path", f"{at}/events").option("checkpointLocation", f"{at}/checkpoint")
        before = spark.conf.get(IDLE, None)
        spark.conf.set(IDLE, "false")  # a start copies the settings; idle batches, which timeouts ask for, would never end
        try:
            run = writer.trigger(availableNow=True).start()
        finally:
            spark.conf.unset(IDLE) if before is None else spark.conf.set(IDLE, before)
        run.awaitTermination()
    return spark.read.schema(EVENTS).parquet(f"{at}/events")


def _named(step: partial) -> Callable:
    def take_turns(key, frames, state):
        return step(key, frames, state)

    return take_turns


def _closed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups in the order of their conversations and spans to one row a conversation; a digest grows span by span."""

    def numbers(lo: int, hi: int) -> Iterator[str]:
        for at in range(lo, hi, 4096):
            yield ",".join(map(str, range(at, min(hi, at + 4096))))

    conv = None
    out: list[dict] = []

    def flush() -> None:
        if conv is not None:
            missing = top - first + 1 - kept
            out.append({"conv": conv, "batch": batch, "digest": sha.hexdigest(), "n_missing": missing, "n_breaks": breaks})

    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.conv != conv:
                flush()
                conv, sha, empty, whole, top, kept, breaks, role, then = r.conv, hashlib.sha256(), True, True, None, 0, 0, None, None
                first, batch = int(r.first), int(r.batch)
                then = int(r.span)
            # a released turn counts as released if all spans before it were
            parts = [] if whole and r.span == then else numbers(int(r.lowest), int(r.next))
            for text in [*parts, r.left] if r.left else parts:
                sha.update((text if empty else "," + text).encode())
                empty = False
            breaks += int(r.breaks) + (r.span == then and role is not None and r.low_role == role)
            kept, role = kept + int(r.kept), r.high_role
            top = top if pd.isna(r.top) else int(r.top)
            whole, then = whole and r.span == then and not pd.isna(r.complete), int(r.span) + 1
        if len(out) >= 4096:
            yield pd.DataFrame(out)
            out.clear()
    flush()
    if out:
        yield pd.DataFrame(out)


def conversation_events(events: DataFrame, bits: int = SPAN_BITS) -> DataFrame:
    """The groups' events as the conversations': ``event, conv, turn, batch, digest, n_missing, n_breaks``.

    A span's releases wait for all spans before it: for the latest batch in which one of them was complete, and for
    ever if one is missing. A conversation's groups meet as one narrow row a span.
    """
    groups = events.where("event = 'close'").select("conv", "span", "first", "batch", F.from_json("detail", CLOSED).alias("x"))
    lowest = F.greatest("first", F.shiftleft("span", bits)).alias("lowest")
    groups = stage_table(groups.select("conv", "span", "first", "batch", lowest, "x.*"), "turn-groups")
    order = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.count("complete").over(order) == F.col("span") - F.shiftright("first", bits)
    gates = groups.where(F.col("span") > F.shiftright("first", bits)).select("conv").distinct()
    gates = groups.join(gates, "conv", "left_semi").withColumns({"behind": behind, "gate": F.max("complete").over(order)})
    gates = stage_table(gates.where("behind and gate is not null").select("conv", "span", "gate"), "turn-gates")
    single = F.col("span") == F.shiftright("first", bits)
    names = ["event", "conv", "turn", "batch", "digest"]
    at_once = events.where("event = 'reject'").unionByName(events.where((F.col("event") == "release") & single)).select(names)
    waited = events.where((F.col("event") == "release") & ~single).join(gates, KEY)
    waited = waited.withColumn("batch", F.greatest("batch", "gate")).select(names)
    closed = groups.repartition("conv").sortWithinPartitions("conv", "span").mapInPandas(_closed, "conv string, batch int, digest string, n_missing long, n_breaks long")
    closed = closed.withColumns({"event": F.lit("close"), "turn": F.lit(-1).cast("long")})
    return at_once.unionByName(waited).unionByName(closed, allowMissingColumns=True)


def turn_batches(conversations: DataFrame, batches: int = BATCHES, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, payload, batch``: conversations as late and repeated arrivals, by a hash of id and turn.

    ``conv`` is the id as text, null as ``null``; null turns are dropped, null roles and texts are empty.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    conv = F.coalesce(F.col(conv_col).cast("string"), F.lit("null"))
    rows = conversations.where(F.col(turn_col).isNotNull()).select(conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    rows = rows.withColumn("h", F.conv(F.substring(F.sha2(F.concat_ws(":", "conv", "turn"), 256), 1, 8), 16, 10).cast("long"))
    again = F.when(F.col("h") % 7 < 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("again", F.explode(again))
    role = F.when(F.col("again") == 1, "user").otherwise(F.col("role"))
    batch = F.when(F.col("again") == 1, (F.col("h") + 5) % batches).otherwise(F.col("h") % batches).cast("int")
    return rows.select("conv", "turn", role.alias("role"), F.concat(role, F.lit("|"), "text").alias("payload"), batch.alias("batch"))


def reassemble_conversations(rows: DataFrame, batches: int = BATCHES, bits: int = SPAN_BITS, silent: int = SILENT) -> DataFrame:
    """Events of ``rows`` (batch, conv, turn, role, payload): ``event, conv, turn, batch, digest, n_missing, n_breaks``.

    Turns are kept by their earliest arrival; each batch releases the gapless run from the conversation's first turn;
    ``silent`` successive batches without an arrival close a conversation in their last, the end closes the others as
    batch ``batches``; arrivals after that are rejected. ``digest`` is the payload's SHA-256, or on closing that of the
    kept turns that weren't released. Rows with a null turn are dropped, roles and payloads have to be given. Repeated rows
    arrive once a batch. An empty table gives an empty result. State, and what is sent to one task, is bounded by a span
    of turn numbers (4,096); of a longer conversation a row a span meets in one task at the end.
    """
    return conversation_events(reassemble(batched_arrivals(rows, bits), batches, bits, silent), bits)


def op12_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in ten batches; a null id gives null ids."""
    out = reassemble_conversations(turn_batches(read_table(spark, sf_dir, "conversations")))
    conv = F.when(F.col("conv") != "null", F.col("conv")).cast("long")
    return out.select("event", F.col("digest").alias("sha256"), conv.alias("conv_id"), "turn", F.col("batch").cast("long").alias("batch"), "n_missing", "n_breaks")


OP12_SQL = """
with h as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    ('0x' || substr(sha256(coalesce(conv_id::varchar, 'null') || ':' || turn), 1, 8))::bigint as h
  from conversations where turn is not null),
r as (select conv_id, turn, role, role || '|' || text as payload, h % 10 as batch from h
  union all select conv_id, turn, 'user', 'user|' || text, (h + 5) % 10 from h where h % 7 < 2),
a as (select coalesce(conv_id, -1::bigint << 62) as conv, conv_id, turn, batch, min(payload) as payload,
    arg_min(role, payload) as role from r group by all),
act as (select distinct conv, batch from a),
gaps as (select conv, batch, lead(batch) over (partition by conv order by batch) as after from act),
closing as (select conv, coalesce(min(batch + 2) filter (where batch + 2 <= 9 and coalesce(after, 99) > batch + 2), 10) as closes
  from gaps group by conv),
firsts as (select conv, min(turn) as first from a group by conv),
kept as (select a.conv, any_value(a.conv_id) as conv_id, a.turn, min(a.batch) as batch, arg_min(a.payload, a.batch) as payload,
    arg_min(a.role, a.batch) as role from a join closing c on a.conv = c.conv and a.batch < c.closes group by a.conv, a.turn),
ranked as (select k.*, f.first, row_number() over w = k.turn - f.first + 1 as run, max(k.batch) over w as ready,
    lag(k.turn) over w = k.turn - 1 and lag(k.role) over w = k.role as again
  from kept k join firsts f using (conv) window w as (partition by k.conv order by k.turn))
select 'release' as event, sha256(payload) as sha256, conv_id, turn, ready::bigint as batch, null::bigint as n_missing,
  null::bigint as n_breaks from ranked where run
union all select 'reject', sha256(a.payload), a.conv_id, a.turn, a.batch::bigint, null, null
  from a join closing c on a.conv = c.conv and a.batch > c.closes
union all select 'close', sha256(coalesce(string_agg(turn::varchar, ',' order by turn) filter (where not run), '')), any_value(conv_id),
  -1, any_value(closes)::bigint, (max(turn) - any_value(first) + 1 - count(*))::bigint, count(*) filter (where again)
  from ranked join closing using (conv) group by conv"""
