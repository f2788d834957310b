"""Tool spans that client and server of one call both recorded: the server's stays.

A client and a server span of one tool are twins if one lies above the other or both lie below one span of the protocol.
Clients take the first free server in order of start; what is left over is matched in sequence, a client that doesn't
match the next server being passed over. It is one rule at every size:

1. *Ancestors.* Doubling over the parents of the traces that hold both kinds gives each span whether a server or a
   session lies above it, and its ``top``, the uppermost span of the protocol above it. Two spans have a protocol span
   above both just if their tops are the same.
2. *Same top.* All clients of a top and tool are twins of all its servers, so the nth client takes the nth server, and
   a client has a twin if its rank is within the number of servers. Ranks are counted in two levels.
3. *Calls outside the protocol.* A client without a top can only have its twin below itself. Clients and servers below
   the uppermost such call are settled together, in order: one call's own spans, whatever the size of the trace.
4. *In sequence.* Of what is left in a trace the servers, then the clients are read as a stream in order; a client that
   has the next server's tool takes it. The memory is one 64-bit code for each server left.

Defined results: spans on or below a circle of parents have no top. Without a trace that holds both kinds there is
nothing to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attrs as A
from ..joins import lookup
from ..storage import Scratch

GONE = "trace_id string, span_id string"


def protocol_marks() -> tuple[Column, Column, Column]:
    """Whether a span is of a server, is a client's call by itself, opens a client's session."""
    name = F.coalesce(F.col("name"), F.lit(""))
    server = (F.col("kind") == "server") | name.contains("mcp.server")
    call = (name == "tools/call.tool") | (F.coalesce(A.first_attr("attrs", "mcp.method.name"), F.lit("")) == "tools/call")
    session = (F.col("kind") == "session") | name.contains("mcp.client.session")
    return server, call, session


def _with_ancestors(t: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``server_above``, ``session_above``, ``top`` and ``caller``, the uppermost call among the span and those above.

    After k rounds a span knows the 2^k spans above it; a round that leaves as many open as before leaves circles only.
    """
    s = t.withColumn("jump", F.col("up")).withColumn("server_above", F.lit(False)).withColumn("session_above", F.lit(False)).withColumn("top", F.lit(None).cast("string"))
    s = s.withColumn("caller", F.when(F.col("call") & F.col("tool").isNotNull(), F.col("span_id")))
    s, before = scratch.cut(s, "up"), -1
    while (n := s.filter("jump is not null").count()) not in (0, before):
        before = n
        above = s.select("trace_id", F.col("span_id").alias("jump"), F.col("jump").alias("j2"), (F.col("server_above") | F.col("server")).alias("v2"), (F.col("session_above") | F.col("session")).alias("s2"), F.coalesce("top", F.when(F.col("shared"), F.col("span_id"))).alias("t2"), F.col("caller").alias("c2"))
        m = lookup(s.filter("jump is not null"), above, ["trace_id", "jump"])
        flag = lambda c, d: F.col(c) | F.coalesce(F.col(d), F.lit(False))
        m = m.withColumn("server_above", flag("server_above", "v2")).withColumn("session_above", flag("session_above", "s2")).withColumn("top", F.coalesce("t2", "top")).withColumn("caller", F.coalesce("c2", "caller")).withColumn("jump", F.col("j2"))
        s = scratch.cut(s.filter("jump is null").unionByName(m.select(s.columns)), "up")
    circle = F.col("jump").isNotNull()
    return s.withColumn("top", F.when(~circle, F.col("top"))).withColumn("caller", F.when(~circle, F.col("caller"))).drop("jump")


def _ranks(df: DataFrame, group: list[str], scratch: Scratch) -> DataFrame:
    """Adds ``rank`` from 1 within the group by start and id: within ranges, then over the ranges' counts."""
    parts = scratch.cut(df.repartitionByRange(*group, "start", "span_id").withColumn("_part", F.spark_partition_id()), "ranks")
    within = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("start", "span_id"))
    counts = parts.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.withColumn("_ahead", F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).filter("_ahead is not null")
    ahead = F.broadcast(ahead.drop("_n"))  # at most one row per border of two ranges
    return parts.withColumn("rank", within).join(ahead, [*group, "_part"], "left").withColumn("rank", F.col("rank") + F.coalesce("_ahead", F.lit(0))).drop("_part", "_ahead")


def _settle_call(table: pa.Table) -> pa.Table:
    """Clients and servers around one call: each client takes the first free server below it or of its top."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["start"], r["span_id"]))
    up = {r["span_id"]: r["up"] for r in rows}

    def above(i: str) -> set[str]:
        out: set[str] = set()
        while (i := up.get(i)) is not None and i not in out:
            out.add(i)
        return out

    free: dict[str, list] = {}
    for r in rows:
        if r["side"] == "server":
            free.setdefault(r["tool"], []).append((r["span_id"], r["top"], above(r["span_id"])))
    ids: list[str] = []
    for c in rows:
        if c["side"] == "client":
            queue = free.get(c["tool"], [])
            at = next((i for i, (_, top, chain) in enumerate(queue) if c["span_id"] in chain or (c["top"] is not None and c["top"] == top)), None)
            if at is not None:
                ids += [c["span_id"], queue.pop(at)[0]]
    return pa.table([pa.array([rows[0]["trace_id"]] * len(ids), pa.string()), pa.array(ids, pa.string())], names=["trace_id", "span_id"])


def _sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by trace, servers before clients, in order → the clients that take the next server."""
    trace, servers, next_server = None, [], 0
    for rb in batches:
        out_t, out_s = [], []
        for t, side, tool, span in zip(*(rb.column(c).to_pylist() for c in ("trace_id", "is_client", "tool_code", "span_id"))):
            if t != trace:
                trace, servers, next_server = t, [], 0
            if not side:
                servers.append(np.int64(tool))
            elif next_server < len(servers) and servers[next_server] == tool:
                next_server += 1
                out_t.append(t), out_s.append(span)
        yield pa.record_batch([pa.array(out_t, pa.string()), pa.array(out_s, pa.string())], names=["trace_id", "span_id"])


def client_twins(spans: DataFrame) -> DataFrame | None:
    """(trace_id, span_id) of the client spans to leave out; None where no trace holds both kinds."""
    server, call, session = protocol_marks()
    name = F.coalesce(F.col("name"), F.lit(""))
    t = spans.select("trace_id", "span_id", F.col("parent_span_id").alias("up"), "start", "tool", server.alias("server"), call.alias("call"), session.alias("session"), (server | session | name.contains("mcp.")).alias("shared"))
    both = t.groupBy("trace_id").agg(F.max("server").alias("s"), F.max(F.col("call") | F.col("session")).alias("c")).filter("s and c").select("trace_id")
    scratch = Scratch(spans.sparkSession, "twins")
    both = scratch.cut(both, "both")
    if both.isEmpty():
        return None
    t = _with_ancestors(scratch.cut(t.join(both, "trace_id", "left_semi"), "spans"), scratch)
    is_server = F.col("server") | F.col("server_above")
    side = F.when(is_server, "server").when(F.col("call") | F.col("session_above"), "client")
    t = scratch.cut(t.withColumn("side", F.when(F.col("tool").isNotNull(), side)), "sides")
    sides = t.filter("side is not null")

    # calls outside the protocol, with all that lies below the uppermost of them; only ids and parents
    callers = t.filter("side = 'client' and top is null").select("trace_id", F.col("span_id").alias("caller")).withColumn("outside", F.lit(True))
    marked = t.join(callers, ["trace_id", "caller"], "left")
    below = marked.filter("outside").select("trace_id", "caller", "span_id", "up", "start", "tool", "side", "top")
    done = scratch.cut(below.groupBy("trace_id", "caller").applyInArrow(_settle_call, GONE), "called")

    # one top: ranks of clients against the number of servers, and the other way round
    one = marked.filter("side is not null and outside is null and top is not null").select("trace_id", "top", "tool", "side", "start", "span_id")
    ranks = _ranks(one, ["trace_id", "top", "tool", "side"], scratch)
    n = one.groupBy("trace_id", "top", "tool").agg(F.sum((F.col("side") == "server").cast("long")).alias("n_server"), F.sum((F.col("side") == "client").cast("long")).alias("n_client"))
    paired = lookup(ranks, n, ["trace_id", "top", "tool"]).filter(F.col("rank") <= F.when(F.col("side") == "client", F.col("n_server")).otherwise(F.col("n_client")))
    done = scratch.cut(done.unionByName(paired.select("trace_id", "span_id")), "done")

    left = sides.join(done, ["trace_id", "span_id"], "left_anti").select("trace_id", (F.col("side") == "client").alias("is_client"), "start", "span_id", F.xxhash64("tool").alias("tool_code"))
    rest = left.repartition("trace_id").sortWithinPartitions("trace_id", "is_client", "start", "span_id").mapInArrow(_sequence, GONE)
    clients = done.join(sides.filter("side = 'client'").select("trace_id", "span_id"), ["trace_id", "span_id"], "left_semi")
    return clients.unionByName(rest)
