"""Traces assembled from a stream of spans, with keyed state per trace, and on to trajectories.

A trace is complete, in this order of precedence: ``settle_s`` after its last task span came (while it waits, the other
rules don't fire), after an idle gap of ``idle_s``, or at an age of ``max_age_s``. Spans of a trace that is closed are late
and come out as such for ``remember_s``; then the trace is forgotten, its state removed, and further spans begin anew. A
trace keeps at most ``max_spans`` spans; a task span evicts one of the least important role if there is no room. So the
state of a trace is bounded, and so is the number of traces that have any.

The clock is processing time in production, where a trace's spans are taken batch by batch. With ``event_time`` it is the
watermark of ``received_at``, which makes runs over stored data repeatable: a trace's part of a micro-batch is then put in
order first; limit the source's ``maxBytesPerTrigger`` to bound it.

``run`` projects, gates and writes what is complete, once for each micro-batch: a batch that is repeated after a failure
overwrites its own folder. ``flush`` closes what is still open, from the state store. A cap on the number of traces in
flight is no keyed state: limit the source's rate instead; ``stats`` shows how many there are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config, RuntimeConfig
from ..functions import attrs as A
from ..functions.ids import canonical_id
from ..operators import corpus, traces
from ..sources import sinks

STATE = "first_seen bigint, last_seen bigint, root_at bigint, closed_at bigint, dropped int, spans string"
OUT = "trace_id string, complete_reason string, n_spans int, n_dropped int, first_seen bigint, closed_at bigint, spans array<string>"
#: Members of a span, as JSON, on its way through the state.
SPAN = "struct<delivery_id:bigint,received_at:timestamp,span_id:string,parent_span_id:string,name:string,start_time_unix_nano:bigint,end_time_unix_nano:bigint,status_code:string,attributes:string,resource:string,events:array<string>>"
#: Roles that a task span may evict, least important first (fixed values).
EVICTION = ("skip", "other", "llm", "tool")


@dataclass
class Inflight:
    """One trace's state and rules, free of Spark; times in milliseconds."""

    config: RuntimeConfig
    first_seen: int | None = None
    last_seen: int = 0
    root_at: int | None = None
    closed_at: int | None = None
    spans: list[tuple[str, str]] = field(default_factory=list)  # (role, span as JSON)
    dropped: int = 0

    def due(self) -> tuple[int, str]:
        """When the trace is complete unless something comes, and why."""
        ms = lambda s: int(s * 1000)
        if self.root_at is not None:
            return self.root_at + ms(self.config.settle_s), "explicit"
        idle, old = self.last_seen + ms(self.config.idle_s), self.first_seen + ms(self.config.max_age_s)
        return (idle, "idle") if idle <= old else (old, "max_age")

    def forgotten_at(self) -> int:
        return self.closed_at + int(self.config.remember_s * 1000)

    def add(self, role: str, span: str, now: int) -> None:
        self.first_seen = now if self.first_seen is None else self.first_seen
        self.last_seen = max(self.last_seen, now)
        if role == "root":
            self.root_at = now
        if len(self.spans) >= self.config.max_spans:
            self.dropped += 1
            if role != "root":
                return
            at = next((i for weak in EVICTION for i, (r, _) in enumerate(self.spans) if r == weak), None)
            if at is None:
                self.dropped -= 1  # nothing may go: the trace grows by its task span
            else:
                del self.spans[at]
        self.spans.append((role, span))

    def close(self, at: int) -> None:
        self.closed_at, self.spans, self.root_at = at, [], None

    def row(self, trace_id: str, reason: str, at: int) -> dict:
        return {"trace_id": trace_id, "complete_reason": reason, "n_spans": len(self.spans), "n_dropped": self.dropped, "first_seen": self.first_seen or 0, "closed_at": at, "spans": [s for _, s in self.spans]}


def _load(config: RuntimeConfig, value: tuple | None) -> Inflight:
    if value is None:
        return Inflight(config)
    first, last, root, closed, dropped, spans = value
    known = lambda x: None if x < 0 else x
    return Inflight(config, known(first), last, known(root), known(closed), [tuple(x) for x in json.loads(spans)], dropped)


def _save(x: Inflight) -> tuple:
    number = lambda v: -1 if v is None else v
    return number(x.first_seen), x.last_seen, number(x.root_at), number(x.closed_at), x.dropped, json.dumps(x.spans)


def _step(config: RuntimeConfig, event_time: bool):
    columns = ["trace_id", "complete_reason", "n_spans", "n_dropped", "first_seen", "closed_at", "spans"]

    def take(x: Inflight, name: str, role: str, span: str, now: int) -> tuple[Inflight, list[dict]]:
        out = []
        if x.closed_at is None and x.first_seen is not None and now >= x.due()[0]:
            at, reason = x.due()
            out.append(x.row(name, reason, at))
            x.close(at)
        if x.closed_at is not None and now >= x.forgotten_at():
            x = Inflight(config)
        if x.closed_at is not None:
            out.append({"trace_id": name, "complete_reason": "late", "n_spans": 1, "n_dropped": 0, "first_seen": now, "closed_at": now, "spans": [span]})
        else:
            x.add(role, span, now)
        return x, out

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, name = _load(config, state.get if state.exists else None), key[0]
        if state.hasTimedOut:
            if x.closed_at is not None or x.first_seen is None:
                state.remove()
                return
            at, reason = x.due()
            yield pd.DataFrame([x.row(name, reason, at)], columns=columns)
            x.close(at)
        else:
            if event_time:
                batches = [pd.concat(list(batches)).sort_values(["ms", "span_id", "role", "span"], kind="stable")]
            for rows in batches:
                out = []
                for role, span, ms in zip(rows["role"], rows["span"], rows["ms"]):
                    x, more = take(x, name, role, span, int(ms) if event_time else state.getCurrentProcessingTimeMs())
                    out += more
                yield pd.DataFrame(out, columns=columns)
        state.update(_save(x))
        at = x.due()[0] if x.closed_at is None else x.forgotten_at()
        if event_time:
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(max(1, at - state.getCurrentProcessingTimeMs()))

    return run


def assemble(deliveries: DataFrame, config: RuntimeConfig = RuntimeConfig(), event_time: bool = False, lateness: str = "0 seconds", redact: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A streaming frame of ``otel_spans`` rows → completed traces and late spans, each with its spans as JSON.

    ``redact`` changes the deliveries before anything is kept of them. The collector's prefix is ``config.prefix``, or else
    the setting's.
    """
    own = config.prefix or deliveries.sparkSession.conf.get(A.PREFIX_SETTING, "")
    own = own.rstrip(".") + "." if own else ""
    d = redact(deliveries) if redact else deliveries
    have = set(d.columns)
    members = [(f.split(":", 1)) for f in SPAN[len("struct<") : -1].split(",")]
    at = F.col("received_at").cast("timestamp")
    ids = {"span_id": canonical_id("span_id", 8)}
    span = F.to_json(F.struct(*[ids.get(c, F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in members]))
    s = d.withColumn("attrs", A.as_map("attributes")).select(canonical_id("trace_id", 16).alias("trace_id"), ids["span_id"].alias("span_id"), A.role(own).alias("role"), span.alias("span"), at.alias("at"), F.unix_millis(at).alias("ms"))
    s = s.filter("trace_id is not null and span_id is not null and at is not null")
    if event_time:
        s = s.withWatermark("at", lateness)
    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.ProcessingTimeTimeout
    return s.groupBy("trace_id").applyInPandasWithState(_step(config, event_time), OUT, STATE, "append", timeout)


def spans_of(completed: DataFrame) -> DataFrame:
    """Deliveries again, of completed traces."""
    rows = completed.filter("complete_reason <> 'late'").select("trace_id", F.explode("spans").alias("s")).select("trace_id", F.from_json("s", SPAN).alias("s")).select("trace_id", "s.*")
    return rows.withColumn("batch_id", F.lit(None).cast("bigint"))


def finish(completed: DataFrame, path: str, part: str, config: Config = Config()) -> None:
    """Project, gate and write completed traces: trajectories, completed traces and counters, each below its own ``part``.

    Counters: traces by reason of completion, late spans, spans that found no room, traces dropped by reason, traces
    projected by framework.
    """
    completed.write.mode("overwrite").parquet(f"{path}/completed/{part}")
    completed = completed.sparkSession.read.schema(OUT).parquet(f"{path}/completed/{part}")
    own = config.runtime.prefix
    fields, steps = traces.project(spans_of(completed), config.projection, own.rstrip(".") + "." if own else None)
    t = traces.trajectories(fields, steps).withColumns({"record_id": F.xxhash64(F.get_json_object("metadata", "$['otel.trace_id']")), "score": F.lit(None).cast("double"), "tools_used": F.lit(None).cast("array<string>"), "split_name": F.lit(None).cast("string"), "recorded_at": F.lit(None).cast("timestamp")})
    gated = corpus.gate(corpus.records(t), config.gate.max_spans, config.gate.require_success)
    kept = t.join(gated.filter("drop_reason is null").select("record_id"), "record_id", "left_semi")
    sinks.write_trajectories(kept.select("task_id", "intent", "app_name", "success", "spans", "metadata"), f"{path}/trajectories/{part}", "overwrite")
    count = lambda df, name, label: df.groupBy(F.lit(name).alias("name"), F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    counters = count(completed, "traces_completed", "complete_reason")
    counters = counters.unionByName(completed.agg(F.lit("spans_overflow").alias("name"), F.lit(None).cast("string").alias("label"), F.coalesce(F.sum("n_dropped"), F.lit(0)).cast("long").alias("n")))
    dropped = fields.filter("drop_reason is not null").select("drop_reason").unionByName(gated.filter("drop_reason is not null").select("drop_reason"))
    counters = counters.unionByName(count(dropped, "traces_dropped", "drop_reason")).unionByName(count(fields.filter("drop_reason is null"), "traces_projected", "framework"))
    counters.coalesce(1).write.mode("overwrite").parquet(f"{path}/counters/{part}")


def run(deliveries: DataFrame, path: str, checkpoint: str, config: Config = Config(), event_time: bool = False, tick: str | None = None, redact: Callable[[DataFrame], DataFrame] | None = None):
    """Start the stream: every ``tick`` (such as "1 second"), or once over what has landed, what is complete is finished."""
    each = lambda batch, n: finish(batch, path, f"batch={n}", config)
    w = assemble(deliveries, config.runtime, event_time, redact=redact).writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(each)
    return (w.trigger(processingTime=tick) if tick else w.trigger(availableNow=True)).start()


def run_available(deliveries: DataFrame, path: str, checkpoint: str, config: RuntimeConfig = RuntimeConfig(), event_time: bool = True) -> None:
    """Process what has landed and append completed traces to a Parquet table; called again, it goes on from its checkpoint."""
    q = assemble(deliveries, config, event_time).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    q.awaitTermination()


def open_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The states that the stream holds: ``trace_id`` and the members of ``STATE``; -1 is a time that isn't set."""
    s = spark.read.format("statestore").load(checkpoint)
    return s.select("key.*", "value.groupState.*")


def flush(spark: SparkSession, checkpoint: str, now_ms: int, config: RuntimeConfig = RuntimeConfig(), reason: str = "shutdown") -> DataFrame:
    """Completed traces out of all that are open, once the stream has ended: by their rule if it has fired by ``now_ms``, else by ``reason``."""
    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                x = _load(config, tuple(r)[1:])
                at, why = x.due()
                rows.append(x.row(r.trace_id, why, at) if at < now_ms else x.row(r.trace_id, reason, now_ms))
            yield pd.DataFrame(rows, columns=["trace_id", "complete_reason", "n_spans", "n_dropped", "first_seen", "closed_at", "spans"])

    names = [c.split(" ")[0] for c in STATE.split(", ")]
    held = open_states(spark, checkpoint).filter("closed_at < 0 and first_seen >= 0").select("trace_id", *names)
    return held.mapInPandas(close, OUT)


def stats(spark: SparkSession, checkpoint: str) -> dict:
    """Traces in flight, closed ones remembered, and the trace that has been idle longest."""
    s = open_states(spark, checkpoint)
    r = s.agg(F.sum((F.col("closed_at") < 0).cast("int")).alias("inflight"), F.sum((F.col("closed_at") >= 0).cast("int")).alias("seen"), F.min_by("trace_id", F.when(F.col("closed_at") < 0, F.struct("last_seen", "trace_id"))).alias("oldest_idle")).first()
    return {"inflight": r["inflight"] or 0, "seen": r["seen"] or 0, "oldest_idle": r["oldest_idle"]}
