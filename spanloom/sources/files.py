"""Readers of trajectories, traces, OTLP requests, benchmark spans, API specifications and catalogs.

Records of unknown shape are read as JSON text and picked apart with expressions; records that can't be parsed come to
nothing, and ``with_rejects`` counts them. Files may lie in folders at any depth.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FieldMap
from ..functions import attrs as A
from ..functions import names as N

STEP = "struct<agent_name:string,action:string,observation:string,thoughts:string>"


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record as JSON text ``rec`` with its ``file``: lines of ``*.jsonl``, the object or elements of ``*.json``."""
    def read(glob: str, whole: bool) -> DataFrame:
        t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        return t.text(path, wholetext=whole).select(F.col("value").alias("rec"), F.col("_metadata.file_path").alias("file"))

    lines = read("*.jsonl", False)
    texts = read("*.json", True).select(F.explode(A.as_list(F.col("rec"))).alias("rec"), "file")
    return lines.unionByName(texts).filter(F.trim("rec") != "")


def with_rejects(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that are JSON objects, those that aren't)."""
    ok = F.from_json("rec", "map<string,string>").isNotNull()
    return records.filter(ok), records.filter(~ok)


def _success(m: Column, f: FieldMap) -> Column:
    def truth(x: Column) -> Column:
        t = F.lower(F.trim(x))
        return F.when(t == "true", True).when(t.isin("false", "null", "", "0"), False).when(t.try_cast("double").isNotNull(), t.try_cast("double") >= 1.0).otherwise(True)

    s, c = F.element_at(m, F.lit(f.success)), F.element_at(m, F.lit(f.score))
    return F.when(s.isNotNull(), truth(s)).when(c.isNotNull(), truth(c)).otherwise(True)


def read_trajectories(spark: SparkSession, path: str, fields: FieldMap = FieldMap(), success_only: bool = False) -> DataFrame:
    """Trajectories by field map; steps may be objects or bare tool names, further members go to ``metadata``."""
    recs, _ = with_rejects(json_records(spark, path))
    m = F.col("m")
    get = lambda k: F.element_at(m, F.lit(k))
    t = recs.withColumn("m", F.from_json("rec", "map<string,string>"))
    items = F.from_json(get(fields.spans), "array<string>")

    def step(x: Column) -> Column:
        o = F.from_json(x, "map<string,string>")
        of = lambda k: F.element_at(o, F.lit(k))
        return F.when(F.ltrim(x).startswith("{"), F.struct(F.coalesce(of(fields.agent_name), F.lit("")).alias("agent_name"), of(fields.action).alias("action"), of(fields.observation).alias("observation"), of(fields.thoughts).alias("thoughts"))).otherwise(
            F.struct(F.lit("").alias("agent_name"), x.alias("action"), F.lit(None).cast("string").alias("observation"), F.lit(None).cast("string").alias("thoughts"))
        )

    taken = [fields.task_id, fields.intent, fields.spans, fields.app_name, fields.success, fields.score, fields.tools_used]
    rest = F.map_filter(m, lambda k, v: ~k.isin(*taken))
    out = t.select(
        get(fields.task_id).alias("task_id"), F.coalesce(get(fields.intent), F.lit("")).alias("intent"), F.coalesce(get(fields.app_name), F.lit("")).alias("app_name"),
        _success(m, fields).alias("success"), F.transform(F.coalesce(items, F.array().cast("array<string>")), step).alias("spans"), F.from_json(get(fields.tools_used), "array<string>").alias("tools_used"),
        F.to_json(rest).alias("metadata"), "file",
    )
    return out.filter("success") if success_only else out


#: Schema of landed deliveries.
DELIVERY = "delivery_id bigint, batch_id bigint, received_at timestamp_ntz, trace_id string, span_id string, parent_span_id string, name string, start_time_unix_nano bigint, end_time_unix_nano bigint, status_code string, attributes string, resource string, events array<string>"
SPAN_COLUMNS = ("trace_id", "span_id", "parent_span_id", "name", "start_time_unix_nano", "end_time_unix_nano", "status_code", "attributes", "resource", "events")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Spans of assembled traces (one object with ``spans`` each) or of dumps with one span a line, as deliveries."""
    recs, _ = with_rejects(json_records(spark, path))
    t = recs.withColumn("m", F.from_json("rec", "map<string,string>"))
    trace = F.element_at("m", F.lit("trace_id"))
    spans = F.coalesce(A.as_list(F.element_at("m", F.lit("spans"))), F.array("rec"))
    s = t.select(trace.alias("t"), F.explode(spans).alias("s")).withColumn("x", F.from_json("s", "map<string,string>"))
    return _deliveries(s.select(F.coalesce(F.element_at("x", F.lit("trace_id")), "t").alias("trace_id"), *[F.element_at("x", F.lit(c)).alias(c) for c in SPAN_COLUMNS[1:]]))


def _deliveries(s: DataFrame) -> DataFrame:
    nano = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)).alias(c)
    return s.select(
        F.monotonically_increasing_id().alias("delivery_id"), F.lit(None).cast("bigint").alias("batch_id"), F.lit(None).cast("timestamp_ntz").alias("received_at"), "trace_id", "span_id", "parent_span_id",
        F.coalesce("name", F.lit("")).alias("name"), nano("start_time_unix_nano"), nano("end_time_unix_nano"), F.coalesce("status_code", F.lit("UNSET")).alias("status_code"), "attributes", "resource", F.from_json("events", "array<string>").alias("events"),
    )


def any_value(v):
    """A value of an OTLP JSON request as a plain one; null if its kind isn't known."""
    if not isinstance(v, dict):
        return None
    if "stringValue" in v:
        return str(v["stringValue"])
    if "boolValue" in v:
        return bool(v["boolValue"])
    if "intValue" in v:
        return int(v["intValue"])
    if "doubleValue" in v:
        return float(v["doubleValue"])
    if "bytesValue" in v:
        return str(v["bytesValue"])
    if "arrayValue" in v:
        return [any_value(x) for x in (v["arrayValue"] or {}).get("values") or []]
    if "kvlistValue" in v:
        return key_values((v["kvlistValue"] or {}).get("values"))
    return None


def key_values(items) -> dict:
    return {i["key"]: any_value(i.get("value")) for i in items or [] if isinstance(i, dict) and i.get("key")}


STATUS = {0: "UNSET", 1: "OK", 2: "ERROR"}


def otlp_spans(request: dict) -> Iterator[tuple]:
    """Flat spans of one OTLP JSON request; ids stay as they are written."""
    for rs in request.get("resourceSpans") or []:
        resource = json.dumps(key_values((rs.get("resource") or {}).get("attributes")), ensure_ascii=False)
        for ss in rs.get("scopeSpans") or []:
            for s in ss.get("spans") or []:
                code = (s.get("status") or {}).get("code", 0)
                events = [json.dumps({"name": e.get("name", ""), "time_unix_nano": int(e.get("timeUnixNano") or 0), "attributes": key_values(e.get("attributes"))}, ensure_ascii=False) for e in s.get("events") or []]
                yield (s.get("traceId"), s.get("spanId"), s.get("parentSpanId") or None, s.get("name") or "", str(s.get("startTimeUnixNano") or 0), str(s.get("endTimeUnixNano") or 0), STATUS.get(code if isinstance(code, int) else -1, "UNSET"), json.dumps(key_values(s.get("attributes")), ensure_ascii=False), resource, json.dumps(events))


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        x |= (c & 127) << shift
        i, shift = i + 1, shift + 7
        if c < 128:
            return x, i


def _message(b: bytes) -> dict[int, list]:
    """Fields of a protobuf message: numbers and bytes by field number."""
    out: dict[int, list] = {}
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 1:
            v, i = b[i : i + 8], i + 8
        elif kind == 2:
            n, i = _varint(b, i)
            if i + n > len(b):
                raise ValueError("the message is cut off")
            v, i = b[i : i + n], i + n
        elif kind == 5:
            v, i = b[i : i + 4], i + 4
        else:
            raise ValueError(f"wire type {kind} is not supported")
        out.setdefault(tag >> 3, []).append(v)
    return out


def _proto_value(b: bytes):
    import struct

    m = _message(b)
    for field, decode in ((1, lambda v: v.decode()), (2, bool), (3, lambda v: v - (1 << 64) if v >> 63 else v), (4, lambda v: struct.unpack("<d", v)[0]), (5, lambda v: [_proto_value(x) for x in _message(v).get(1, [])]), (6, lambda v: _proto_attrs(_message(v).get(1, []))), (7, lambda v: v.hex())):
        if field in m:
            return decode(m[field][-1])
    return None


def _proto_attrs(items: list[bytes]) -> dict:
    out = {}
    for x in map(_message, items):
        if x.get(1):
            out[x[1][-1].decode()] = _proto_value(x[2][-1]) if x.get(2) else None
    return out


def otlp_proto_spans(body: bytes) -> Iterator[tuple]:
    """Flat spans of one OTLP protobuf request; raises ValueError on bad bytes."""
    import struct

    try:
        for rs in map(_message, _message(body).get(1, [])):
            resource = json.dumps(_proto_attrs(_message(rs[1][-1]).get(1, [])) if rs.get(1) else {}, ensure_ascii=False)
            for ss in map(_message, rs.get(2, [])):
                for s in map(_message, ss.get(2, [])):
                    text = lambda f: s[f][-1].decode() if s.get(f) else ""  # noqa: B023, E731
                    ident = lambda f: s[f][-1].hex() if s.get(f) else ""  # noqa: B023, E731
                    nano = lambda m, f: struct.unpack("<Q", m[f][-1])[0] if m.get(f) else 0
                    events = [json.dumps({"name": e[2][-1].decode() if e.get(2) else "", "time_unix_nano": nano(e, 1), "attributes": _proto_attrs(e.get(3, []))}, ensure_ascii=False) for e in map(_message, s.get(11, []))]
                    code = (_message(s[15][-1]).get(3) or [0])[-1] if s.get(15) else 0
                    yield (ident(1), ident(2), ident(4) or None, text(5), str(nano(s, 7)), str(nano(s, 8)), STATUS.get(code, "UNSET"), json.dumps(_proto_attrs(s.get(9, [])), ensure_ascii=False), resource, json.dumps(events))
    except (IndexError, struct.error, UnicodeDecodeError, AttributeError, TypeError) as e:
        raise ValueError("not an OTLP request") from e


_FLAT = pa.schema([(c, pa.string()) for c in SPAN_COLUMNS])
_FLAT_DDL = ", ".join(f"{c} string" for c in SPAN_COLUMNS)


def _flat(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * len(SPAN_COLUMNS))], schema=_FLAT)


def _decode_json(batches):
    for rb in batches:
        rows: list[tuple] = []
        for t in rb.column("rec").to_pylist():
            try:
                rows += list(otlp_spans(json.loads(t)))
            except (ValueError, AttributeError, TypeError):
                continue
        yield _flat(rows)


def _decode_proto(batches):
    for rb in batches:
        rows: list[tuple] = []
        for b in rb.column("content").to_pylist():
            try:
                rows += list(otlp_proto_spans(bytes(b)))
            except ValueError:
                continue
        yield _flat(rows)


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """Deliveries from landed OTLP requests: ``*.json``, ``*.jsonl`` (gzip by file name) and protobuf bodies ``*.pb``."""
    as_json = json_records(spark, path).select("rec").mapInArrow(_decode_json, _FLAT_DDL)
    bodies = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pb").load(path)
    return _deliveries(as_json.unionByName(bodies.select("content").mapInArrow(_decode_proto, _FLAT_DDL)))


def read_bodies(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deliveries, refused bodies with their status) of OTLP requests as they came: ``body``, ``content_type``, ``content_encoding``.

    What a collector answers over HTTP is a column here: 415 for another content type or encoding, 400 for a body that can't
    be inflated or read, 200 else. Types are compared without case and parameters.
    """
    plain = lambda c: F.lower(F.trim(F.substring_index(F.coalesce(F.col(c), F.lit("")), ";", 1)))
    b = bodies.select("body", plain("content_type").alias("type"), plain("content_encoding").alias("coding"))
    known = F.col("type").isin("application/json", "application/x-protobuf", "application/protobuf") & F.col("coding").isin("", "identity", "gzip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import zlib

        for rb in batches:
            out, status = [], []
            for body, kind, coding in zip(*(rb.column(c).to_pylist() for c in ("body", "type", "coding"))):
                try:
                    raw = gzip.decompress(bytes(body or b"")) if coding == "gzip" else bytes(body or b"")
                    if kind == "application/json":
                        out.append(json.dumps(json.loads(raw.decode("utf-8"))).encode())
                    else:
                        list(otlp_proto_spans(raw))
                        out.append(raw)
                    status.append(200)
                except (ValueError, OSError, EOFError, zlib.error):
                    out.append(bytes(body or b""))
                    status.append(400)
            yield pa.record_batch([pa.array(out, pa.binary()), rb.column("type"), pa.array(status, pa.int32())], names=["body", "type", "status"])

    read = b.filter(known).mapInArrow(run, "body binary, type string, status int")
    good = read.filter("status = 200")
    as_json = good.filter("type = 'application/json'").select(F.decode("body", "utf-8").alias("rec")).mapInArrow(_decode_json, _FLAT_DDL)
    as_proto = good.filter("type <> 'application/json'").select(F.col("body").alias("content")).mapInArrow(_decode_proto, _FLAT_DDL)
    refused = b.filter(~known).select("body", "type", F.lit(415).alias("status")).unionByName(read.filter("status = 400"))
    return _deliveries(as_json.unionByName(as_proto)), refused


#: Readers of trajectories by name; each takes (session, path) and returns the columns of ``read_trajectories``.
LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def load(spark: SparkSession, path: str, loader: str = "", fields: FieldMap = FieldMap(), success_only: bool = False) -> DataFrame:
    """Trajectories by a loader of one's own in ``LOADERS``, whose columns are checked, or else by ``read_trajectories``."""
    if not loader:
        return read_trajectories(spark, path, fields, success_only)
    if loader not in LOADERS:
        raise ValueError(f"no such loader: {loader!r}; there are {sorted(LOADERS)}")
    t = LOADERS[loader](spark, path)
    if missing := {"task_id", "intent", "app_name", "success", "spans", "tools_used", "metadata"} - set(t.columns):
        raise ValueError(f"loader {loader!r} lacks columns {sorted(missing)}")
    return t.filter("success") if success_only else t


def read_dataset_csv(spark: SparkSession, path: str) -> DataFrame:
    """A dataset as written in CSV with a header, in one folder per split or as a whole; types are inferred, texts may span lines."""
    return spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path)


def read_api_specs(spark: SparkSession, path: str, helpers: tuple[str, ...] = ("supervisor", "api_docs")) -> DataFrame:
    """Tools of function-calling specifications, one file per app: ``tool_name``, ``app``, ``description``, ``parameters``."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    app = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    listed = F.coalesce(A.as_list(F.when(F.ltrim("value").startswith("{"), F.get_json_object("value", "$.functions")).otherwise(F.col("value"))), F.array().cast("array<string>"))
    f = t.select(app.alias("app"), F.explode(listed).alias("f")).filter(~F.col("app").isin(*helpers))
    fn = F.coalesce(F.get_json_object("f", "$.function"), "f")
    props = F.from_json(F.get_json_object(fn, "$.parameters.properties"), "map<string,struct<type:string,description:string,enum:array<string>,items:struct<type:string>>>")
    params = F.transform(F.map_entries(props), lambda e: F.struct(e["key"].alias("name"), e["value"]["type"].alias("type"), e["value"]["description"].alias("description"), e["value"]["enum"].alias("enum"), e["value"]["items"]["type"].alias("items_type")))
    none = F.from_json(F.lit("[]"), "array<struct<name:string,type:string,description:string,enum:array<string>,items_type:string>>")
    return f.select(F.get_json_object(fn, "$.name").alias("tool_name"), "app", F.coalesce(F.get_json_object(fn, "$.description"), F.lit("")).alias("description"), F.coalesce(params, none).alias("parameters")).filter("tool_name is not null")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(tool_name, description) of a JSON object {name: description}."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return m.select(F.explode("m").alias("tool_name", "description")).withColumn("description", F.coalesce("description", F.lit("")))


def read_benchmark_spans(spark: SparkSession, path: str) -> DataFrame:
    """Exported benchmark spans, JSON lines or Parquet, with their order in the file; spans without a trace are left out."""
    if path.rstrip("/").endswith(".parquet"):
        t = spark.read.parquet(path)
        attrs = F.col("attributes") if dict(t.dtypes)["attributes"] == "string" else F.to_json("attributes")
        t = t.select("trace_id", "span_id", "name", attrs.alias("attributes"))
    else:
        m = F.from_json("rec", "map<string,string>")
        t = with_rejects(json_records(spark, path))[0].select(*[F.element_at(m, F.lit(c)).alias(c) for c in ("trace_id", "span_id", "name", "attributes")])
    return t.withColumn("position", F.monotonically_increasing_id()).filter("trace_id is not null")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Cached model results as (task_id, ranked, cost_usd, latency_ms): JSON {tasks: {id: {…}}}, or the table of ``write_results``."""
    if not path.rstrip("/").endswith(".json"):
        return spark.read.parquet(path)
    t = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.tasks"), "map<string,struct<ranked:array<string>,cost_usd:double,latency_ms:double>>").alias("m"))
    return t.select(F.explode("m").alias("task_id", "r")).select("task_id", "r.*")


def tool_names(steps: Column) -> Column:
    return F.transform(steps, lambda s: N.tool_name(s["action"]))
