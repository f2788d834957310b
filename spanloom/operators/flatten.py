"""Deeply nested span records as related flat tables that keep their parent-child links.

One depth-first visitor, driven by rules, walks each record once and emits tagged rows (``mapInArrow``, no shuffle): the
table's tag, the row's own path, its parent's path, its place and its payload as JSON. ``write_tables`` writes them
partitioned by tag, ``read_table`` reads one tag back and applies that table's schema. The rules name each table's
fields and which members of its objects are rows of which table; a table may be its own child, at any depth.

Tags and paths of the given rules (i and j count every element from 0, objects or not):

* ``message`` ``messages.i``: an object in the messages, which stand under ``gen_ai.input.messages`` or nested objects
  ``gen_ai``, ``input``, ``messages`` (dotted and nested keys may mix; the plainest spelling that holds a value wins), as
  a list, a single object, or JSON text of either;
* ``call`` ``messages.i.tool_calls.j``: an object in a message's ``tool_calls``; ``messages.i.parts.j`` and
  ``messages.i.content.j``: an object there whose ``type`` is ``tool_call`` or ``function_call``;
* ``event`` ``events.j``: an element of ``events`` that is JSON text of an object;
* ``attribute`` (``WITH_ATTRIBUTES``) ``events.j.attributes.k``, and so on downward: a member of an object or an element
  of a list, with its key and, unless it is an object or a list itself, its value.

Defined results: null, empty, cut-off or otherwise unparsable JSON yields nothing, and so does JSON of another kind. A
key that repeats in one object has its last value. Every input row counts, also repeated ones. Very long texts are
visited whole, and nesting may be as deep as the text is long: what is too deep for the ordinary parser goes through one
that keeps its own stack. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGGED = "tag string, row_id bigint, node_path string, parent_path string, place int, payload string"
_ARROW = pa.schema([("tag", pa.string()), ("row_id", pa.int64()), ("node_path", pa.string()), ("parent_path", pa.string()), ("place", pa.int32()), ("payload", pa.string())])
CALL_TYPES = ("tool_call", "function_call")
#: Every way to spell the key with dots or nesting, plainest first.
_SPELLINGS = (("gen_ai.input.messages",), ("gen_ai", "input", "messages"), ("gen_ai", "input.messages"), ("gen_ai.input", "messages"))
_BATCH = 8192


@dataclass(frozen=True)
class Child:
    """Members under ``key`` that are rows of ``table``: the list's objects, of ``types`` if given; or all ``members``."""

    key: str
    table: str
    types: tuple[str, ...] = ()
    members: bool = False


@dataclass(frozen=True)
class Table:
    """Fields by name, each with the ways to reach it, of which the first whose object is there counts; and the children.

    ``rest`` names a field for all members that no field and no child takes.
    """

    fields: dict[str, tuple[tuple[str, ...], ...]]
    children: tuple[Child, ...] = ()
    rest: str | None = None


def _plain(*names: str) -> dict[str, tuple[tuple[str, ...], ...]]:
    return {n: ((n,),) for n in names}


RULES = {
    "message": Table(_plain("role", "tool_call_id", "content"), (Child("tool_calls", "call"), Child("parts", "call", CALL_TYPES), Child("content", "call", CALL_TYPES)), rest="rest"),
    "call": Table({"call_id": (("id",),), "name": (("function", "name"), ("name",)), "arguments": (("function", "arguments"), ("arguments",)), "type": (("type",),)}),
    "event": Table(_plain("name", "time_unix_nano", "attributes")),
}
#: The same, and the events' attributes member by member, however deep.
WITH_ATTRIBUTES = RULES | {
    "event": Table(_plain("name", "time_unix_nano"), (Child("attributes", "attribute", members=True),)),
    "attribute": Table(_plain("key", "value"), (Child("value", "attribute", members=True),)),
}


def _no_constant(name: str):
    raise ValueError(name)


def parse(text):
    """The JSON value of a text, None if there is none."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return parse_deep(text)
    except (ValueError, TypeError):
        return None


def parse_deep(s: str):
    """The same with a stack of its own, for any depth."""
    skip = lambda i: json.decoder.WHITESPACE.match(s, i).end()

    def key_at(i: int) -> tuple[str, int]:
        if s[i : i + 1] != '"':
            raise ValueError(i)
        key, i = json.decoder.scanstring(s, i + 1)
        i = skip(i)
        if s[i : i + 1] != ":":
            raise ValueError(i)
        return key, skip(i + 1)

    def scalar(i: int):
        if s[i : i + 1] == '"':
            return json.decoder.scanstring(s, i + 1)
        for word, value in (("true", True), ("false", False), ("null", None)):
            if s.startswith(word, i):
                return value, i + len(word)
        m = json.scanner.NUMBER_RE.match(s, i)
        if not m:
            raise ValueError(i)
        whole, *more = m.groups()
        return (float(m[0]) if any(more) else int(whole)), m.end()

    try:
        stack: list[tuple] = []  # open objects and lists, each with the key that waits for its value
        i = skip(0)
        while True:
            c = s[i : i + 1]
            if c in ("{", "[") and c:
                box, i = ({} if c == "{" else []), skip(i + 1)
                if s[i : i + 1] != ("}" if c == "{" else "]"):
                    key, i = key_at(i) if c == "{" else (None, i)
                    stack.append((box, key))
                    continue
                value, i = box, i + 1
            else:
                value, i = scalar(i)
            while True:  # a value is complete
                i = skip(i)
                if not stack:
                    return value if i == len(s) else None
                box, key = stack[-1]
                if key is None:
                    box.append(value)
                else:
                    box[key] = value
                c = s[i : i + 1]
                if c == ",":
                    i = skip(i + 1)
                    if key is not None:
                        key, i = key_at(i)
                        stack[-1] = (box, key)
                    break
                if c != ("]" if key is None else "}"):
                    return None
                stack.pop()
                value, i = box, i + 1
    except ValueError:
        return None


def dump(v) -> str:
    """JSON text of a value of any depth."""
    try:
        return json.dumps(v, ensure_ascii=False)
    except RecursionError:
        pass
    out, stack = [], [v]  # tuples are pieces of text
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, dict) and x:
            todo = [("{",)]
            for n, (k, y) in enumerate(x.items()):
                todo += [((", " if n else "") + json.dumps(k, ensure_ascii=False) + ": ",), y]
            stack += reversed([*todo, ("}",)])
        elif isinstance(x, list) and x:
            todo = [("[",)]
            for n, y in enumerate(x):
                todo += [(", ",), y] if n else [y]
            stack += reversed([*todo, ("]",)])
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def messages_of(attributes) -> list:
    for keys in _SPELLINGS:
        x = reduce(lambda at, k: at.get(k) if isinstance(at, dict) else None, keys, attributes)
        if isinstance(x, str):
            x = parse(x)
        if isinstance(x, dict):
            return [x]
        if isinstance(x, list):
            return x
    return []


def visit(attributes: str | None, events: list | None, rules: dict[str, Table] = RULES):
    """(tag, path, parent path, place, object) of each node, depth first; the stack holds what is still to be visited."""
    stack = []
    for j, e in enumerate(events or ()):
        x = parse(e) if e else None
        if isinstance(x, dict):
            stack.append(("event", f"events.{j}", "", j, x))
    stack.reverse()
    if attributes:
        stack += [("message", f"messages.{i}", "", i, m) for i, m in enumerate(messages_of(parse(attributes))) if isinstance(m, dict)][::-1]
    while stack:
        node = stack.pop()
        yield node
        tag, path, _, _, x = node
        below = []
        for c in rules[tag].children:
            inner = x.get(c.key)
            if c.members:
                pairs = inner.items() if isinstance(inner, dict) else ((str(j), y) for j, y in enumerate(inner)) if isinstance(inner, list) else ()
                at = path if tag == c.table else f"{path}.{c.key}"  # the way down within one table needs no name
                below += [(c.table, f"{at}.{k}", path, j, {"key": k, "value": y}) for j, (k, y) in enumerate(pairs)]
            elif isinstance(inner, list):
                below += [(c.table, f"{path}.{c.key}.{j}", path, j, y) for j, y in enumerate(inner) if isinstance(y, dict) and (not c.types or y.get("type") in c.types)]
        stack += reversed(below)


def _reach(x: dict, ways: tuple[tuple[str, ...], ...]):
    for *outer, last in ways:
        for k in outer:
            x2 = x.get(k)
            if not isinstance(x2, dict):
                break
        else:
            for k in outer:
                x = x[k]
            return x.get(last)
    return None


def _payload(table: Table, x: dict) -> str:
    flat = {f: _reach(x, ways) for f, ways in table.fields.items()}
    for c in table.children:
        if c.members and c.key in flat and isinstance(flat[c.key], (dict, list)):
            flat[c.key] = None  # its members are rows
    if table.rest:
        taken = {w[0] for ways in table.fields.values() for w in ways} | {c.key for c in table.children}
        flat[table.rest] = {k: v for k, v in x.items() if k not in taken} or None
    text = {k: v if v is None or isinstance(v, (str, int)) and not isinstance(v, bool) else dump(v) for k, v in flat.items()}
    return json.dumps(text, ensure_ascii=False)


def _emit(rules: dict[str, Table]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for rb in batches:
            ids, attrs, evs = (rb.column(c).to_pylist() for c in ("row_id", "attributes", "events"))
            for row, a, e in zip(ids, attrs, evs):
                if a or e:
                    for tag, path, parent, place, x in visit(a, e, rules):
                        rows.append((tag, row, path, parent, place, _payload(rules[tag], x)))
            if len(rows) >= _BATCH:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return run


def tagged_nodes(df: DataFrame, row_id: str = "delivery_id", attributes: str = "attributes", events: str = "events", rules: dict[str, Table] = RULES) -> DataFrame:
    """All nodes of all records as tagged rows, in one pass over ``df``."""
    a, e = F.col(attributes), F.col(events)
    # what can't hold a node isn't sent to Python: the key is spelt out in the text, unless characters are escaped
    a = F.when(F.contains(a, F.lit("messages")) | F.contains(a, F.lit("\\u")), a)
    e = F.when(F.size(e) > 0, e)
    slim = df.select(F.col(row_id).cast("long").alias("row_id"), a.alias("attributes"), e.alias("events"))
    return slim.filter(F.col("attributes").isNotNull() | F.col("events").isNotNull()).mapInArrow(_emit(rules), TAGGED)


def schema_of(table: Table) -> str:
    """The payload's schema: every field is text."""
    return ", ".join(f"{f} string" for f in (*table.fields, *([table.rest] if table.rest else [])))


def write_tables(nodes: DataFrame, path: str) -> None:
    """Write tagged rows partitioned by tag."""
    nodes.write.mode("errorifexists").partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str, rules: dict[str, Table] = RULES) -> DataFrame:
    """One flat table: ``row_id`` and ``node_path`` are its key, ``row_id`` and ``parent_path`` its parent's."""
    rows = spark.read.schema(TAGGED).parquet(path).filter(F.col("tag") == tag)
    return rows.select("row_id", "node_path", "parent_path", "place", F.from_json("payload", schema_of(rules[tag])).alias("p")).select("row_id", "node_path", "parent_path", "place", "p.*")


def flat_tables(df: DataFrame, path: str, rules: dict[str, Table] = RULES, **columns: str) -> dict[str, DataFrame]:
    """All tables of ``df`` by tag, written below ``path``."""
    write_tables(tagged_nodes(df, rules=rules, **columns), path)
    return {tag: read_table(df.sparkSession, path, tag, rules) for tag in rules}
