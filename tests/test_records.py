"""Repeats, nested objects and hierarchies against plain Python on small fixtures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import dedup, flatten, hierarchy
from spanloom.storage import Scratch, drop, new_path

SPAN = "delivery_id bigint, batch_id bigint, received_at timestamp_ntz, trace_id string, span_id string, parent_span_id string, name string, start_time_unix_nano bigint, end_time_unix_nano bigint, status_code string, attributes string, resource string, events array<string>, kind string, k string"


def span(i, trace, sid, parent=None, at=0, start=0, attributes=None, events=None):
    when = None if at is None else dt.datetime(2026, 1, 1) + dt.timedelta(seconds=at)
    return (i, 0, when, trace, sid, parent, "x", start, start, "OK", attributes, None, events, "clash", "clash")


T1, T2 = "ab" * 16, "cd" * 16


def hexid(n):
    return f"{n + 4096:016x}"  # a parent of zeros means none


def surplus(spark, rows, **kw):
    return sorted(r[0] for r in dedup.surplus_deliveries(spark.createDataFrame(rows, SPAN), **kw).collect())


def test_dedup_notations_ties_nulls(spark):
    rows = [
        span(1, T1, hexid(1), at=10), span(2, T1.upper(), "0x" + hexid(1), at=5), span(3, "q6urq6urq6urq6urq6urqw==", hexid(1), at=5),
        span(4, T2, hexid(1), at=1),  # same span id, another trace
        span(5, None, hexid(1)), span(6, T1, None), span(7, T1, " "), span(8, T1, None),  # no id: never surplus
        span(9, T1, hexid(9), at=None), span(10, T1, hexid(9), at=99_999_999),  # no time: latest
        span(11, "odd id", "x"), span(12, "ODD ID ", "X"), span(13, "odd id", "y"),
    ]
    assert surplus(spark, rows) == [1, 3, 9, 12]
    assert surplus(spark, []) == []


def test_dedup_repeated_rows_and_units(spark, monkeypatch):
    rng = random.Random(3)
    rows = [span(i, T1, hexid(rng.randrange(400) if i % 3 else 7), at=rng.randrange(20 * 86_400)) for i in range(3000)]
    rows += [rows[0], rows[0]]  # wholly repeated
    best, gone = {}, []
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        gone += [r[0]] if r[4] in best else []
        best.setdefault(r[4], r[0])
    df = spark.createDataFrame(rows, SPAN).repartition(5)
    assert sorted(r[0] for r in dedup.surplus_deliveries(df).collect()) == sorted(gone)
    monkeypatch.setattr(dedup, "UNIT_ROWS", 200)
    assert sorted(r[0] for r in dedup.surplus_deliveries(df).collect()) == sorted(gone)


def test_time_buckets_hold_equal_parts():
    assert dedup.time_buckets([]) == [] and dedup.time_buckets([(5, 3), (2, 1)]) == [(2, 1), (5, 3)]
    days = [(d, 1 + d % 3) for d in range(1000)] + [(3000, 4000)]
    got = dedup.time_buckets(days)
    assert len(got) <= dedup.MAX_BUCKETS and sum(n for _, n in got) == sum(n for _, n in days)
    assert [d for d, _ in got] == sorted(d for d, _ in got) and got[0][0] == 0
    assert max(n for _, n in got) <= sum(n for _, n in days) / dedup.MAX_BUCKETS + 4000
    even = dedup.time_buckets([(d, 10) for d in range(1000)])
    assert len(even) == dedup.MAX_BUCKETS and {n for _, n in even} == {620, 630}


@pytest.mark.parametrize("days", [1, 36, 1000])
def test_the_screen_passes_few_new_keys_over_any_number_of_days(spark, days):
    df = spark.range(0, 60_000, 1, 6).select(F.lit(T1).alias("trace_id"), F.format_string("%016x", F.xxhash64("id")).alias("span_id"), F.timestamp_seconds(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(days)) * 86_400).alias("received_at"), F.col("id").alias("delivery_id"))
    again = df.filter("delivery_id < 300").withColumn("received_at", F.expr("received_at + interval 2 days")).withColumn("delivery_id", F.col("delivery_id") + 100_000)
    both = df.unionByName(again)
    _, known = dedup.screen(both, [("trace_id", 16), ("span_id", 8)], "received_at", "delivery_id", Scratch(spark, "test"))
    assert 600 <= known.count() < 600 + 0.04 * 60_000
    assert sorted(r[0] for r in dedup.surplus_deliveries(both).collect()) == [100_000 + i for i in range(300)]


def test_first_deliveries_keep_one(spark):
    rows = [span(1, T1, hexid(1), at=2), span(2, T1, hexid(1), at=1), span(3, None, None)]
    assert sorted(r["delivery_id"] for r in dedup.first_deliveries(spark.createDataFrame(rows, SPAN)).collect()) == [2, 3]


MESSAGES = [{"role": "user", "content": "hi"}, "ping", None, {"role": "assistant", "tool_calls": [None, {"id": "c1", "function": {"name": "f", "arguments": "{}"}}], "parts": [{"type": "text"}, {"type": "function_call", "name": "g"}]}, {"role": "assistant", "content": [{"type": "tool_call", "name": "h"}, {"type": "image"}]}]
EXPECTED = {"messages.0", "messages.3", "messages.3.tool_calls.1", "messages.3.parts.1", "messages.4", "messages.4.content.0"}


@pytest.mark.parametrize("attributes", [{"gen_ai.input.messages": MESSAGES}, {"gen_ai.input.messages": json.dumps(MESSAGES)}, {"gen_ai": {"input": {"messages": MESSAGES}}}, {"gen_ai": {"input": {"messages": json.dumps(MESSAGES)}}}])
def test_visitor_spellings(attributes):
    assert {n[1] for n in flatten.visit(json.dumps(attributes), None)} == EXPECTED


def test_flatten_edge_cases(spark):
    one = {"role": "user"}
    rows = [
        span(1, T1, "1", attributes=json.dumps({"gen_ai.input.messages": one})), span(2, T1, "1", attributes=json.dumps({"gen_ai.input.messages": json.dumps(one)})),
        span(3, T1, "1", attributes='{"gen_ai.input.messages": [{"role": "us'), span(4, T1, "1", attributes=None, events=['{"name": "e"}', None, '{"na', "[1]", '{"name": "z"}']),
        span(5, T1, "1", attributes="", events=[]), span(6, T1, "1", attributes='{"gen_ai.input.messages": [{"role": NaN}]}'), span(7, T1, "1", attributes='{"gen_ai.input.\\u006dessages": [{"role": "user"}]}'),
        span(8, T1, "1", attributes=json.dumps({"gen_ai.input.messages": [{"role": "user", "content": "x" * 300_000}]})),
    ]
    df = spark.createDataFrame(rows, SPAN)
    got = {(r.row_id, r.node_path) for r in flatten.tagged_nodes(df).collect()}
    assert got == {(1, "messages.0"), (2, "messages.0"), (4, "events.0"), (4, "events.4"), (7, "messages.0"), (8, "messages.0")}
    assert flatten.tagged_nodes(spark.createDataFrame([], SPAN)).count() == 0


def test_flat_tables_keep_links(spark):
    df = spark.createDataFrame([span(1, T1, "1", attributes=json.dumps({"gen_ai.input.messages": MESSAGES}))], SPAN)
    path = new_path(spark, "test")
    tables = flatten.flat_tables(df, path)
    calls = {r.node_path: r for r in tables["call"].collect()}
    assert calls["messages.3.tool_calls.1"].name == "f" and calls["messages.3.tool_calls.1"].parent_path == "messages.3"
    assert calls["messages.3.parts.1"].name == "g" and calls["messages.4.content.0"].place == 0
    assert {r.node_path for r in tables["message"].collect()} == {"messages.0", "messages.3", "messages.4"}
    drop(spark, path)


def test_deep_nesting_costs_no_row(spark):
    deep = "[" * 50_000 + "1" + "]" * 50_000
    text = '{"gen_ai.input.messages": [{"role": "user", "content": %s}, {"role": "tool", "extra": {"a": %s}, "tool_calls": [{"id": "c"}]}]}' % (deep, deep.replace("[", '{"x":').replace("]", "}"))
    got = {r.node_path: r.payload for r in flatten.tagged_nodes(spark.createDataFrame([span(1, T1, "1", attributes=text, events=['{"name": "e", "attributes": %s}' % deep])], SPAN)).collect()}
    assert set(got) == {"messages.0", "messages.1", "messages.1.tool_calls.0", "events.0"}
    assert json.loads(got["messages.0"])["content"] == deep and json.loads(got["events.0"])["attributes"] == deep
    for bad in ("[" * 50_000, deep + "]", '{"a": ' * 20_000 + "}" * 20_000, deep[:-1] + ",]"):
        assert flatten.parse(bad) is None


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\n\\u00e9", {}, [], null, true, false, {"b": {"c": [[]]}}]}', " [1 , 2 ] ", '"s"', "3", "", "{", '{"a" 1}', '{"a": 1,}', "[1 2]", "[NaN]", "[1]]", '{1: 2}', "nul", '{"a": 1, "a": 2}'])
def test_both_parsers_agree(text):
    assert flatten.parse_deep(text) == flatten.parse(text)


def test_members_of_attributes_at_every_depth(spark):
    events = [json.dumps({"name": "e", "attributes": {"a.b": 1, "r": {"n": None, "h": ["x", {"y": True}]}}}), json.dumps({"attributes": [{"key": "k"}]}), json.dumps({"attributes": 5})]
    df = spark.createDataFrame([span(1, T1, "1", attributes=None, events=events)], SPAN)
    path = new_path(spark, "test")
    rows = {(r.node_path, r.parent_path, r.key, r.value) for r in flatten.flat_tables(df, path, flatten.WITH_ATTRIBUTES)["attribute"].collect()}
    e = "events.0"
    assert rows == {
        (f"{e}.attributes.a.b", e, "a.b", "1"), (f"{e}.attributes.r", e, "r", None), (f"{e}.attributes.r.n", f"{e}.attributes.r", "n", None), (f"{e}.attributes.r.h", f"{e}.attributes.r", "h", None), (f"{e}.attributes.r.h.0", f"{e}.attributes.r.h", "0", "x"),
        (f"{e}.attributes.r.h.1", f"{e}.attributes.r.h", "1", None), (f"{e}.attributes.r.h.1.y", f"{e}.attributes.r.h.1", "y", "true"), ("events.1.attributes.0", "events.1", "0", None), ("events.1.attributes.0.key", "events.1.attributes.0", "key", "k"),
    }
    drop(spark, path)


def trees(spark, rows, **kw):
    return {(r.trace_id, r.span_id): r for r in hierarchy.hierarchies(spark.createDataFrame(rows, SPAN), **kw).collect()}


@pytest.mark.parametrize("cap", [1000, 3])
def test_hierarchy_forms_agree_with_brute_force(spark, cap):
    rng = random.Random(5)
    rows, parent = [], {}
    for n in range(120):
        p = rng.randrange(n) if n and rng.random() < 0.85 else None
        if n in (40, 41, 42):
            p = {40: 41, 41: 42, 42: 40}[n]  # a circle
        if n == 50:
            p = 50
        parent[n] = p
        rows.append(span(n, T1, hexid(n), None if p is None else hexid(p), start=rng.randrange(9)))
    rows += [span(900, T2, hexid(1), hexid(77)), span(901, T2, hexid(2), "0" * 16), span(902, T2, hexid(3), " "), span(903, None, hexid(3)), span(904, T2, hexid(1), hexid(2), at=5)]

    def climb(n):
        way = []
        while n is not None and n not in way:
            way.append(n)
            n = parent[n]
        return way if n is None else None

    got = trees(spark, rows, cap=cap, hot_rows=4)
    assert len(got) == 123
    for n in parent:
        r, way = got[T1, hexid(n)], climb(n)
        if way is None:
            assert (r.root_span_id, r.tree_depth, r.path, r.lo) == ("", -1, None, None)
        else:
            assert (r.root_span_id, r.tree_depth, r.path) == (hexid(way[-1]), len(way) - 1, "/".join(map(hexid, reversed(way))))
            below = sum(1 for m in parent if (w := climb(m)) and n in w)
            assert r.subtree_size == below
            inside = {m for m in parent if (w := climb(m)) and w[-1] == way[-1] and r.lo <= got[T1, hexid(m)].lo <= r.hi}
            assert inside == {m for m in parent if (w := climb(m)) and n in w}
    assert all(got[T2, hexid(i)].tree_depth == 0 for i in (1, 2, 3))


@pytest.mark.parametrize("few,rows_of", [(0, 10**9), (0, 0)])
def test_many_large_groups(spark, monkeypatch, few, rows_of):
    """Large groups told apart by a broadcast, or by salted joins where there are too many for one."""
    monkeypatch.setattr(hierarchy, "FEW_HEAVY", few)
    monkeypatch.setattr(hierarchy, "fits_broadcast", lambda n, b: n <= rows_of)
    rows = [span(100 * t + n, f"{t:032x}".replace("0", "a"), hexid(n), hexid(n - 1) if n else None) for t in range(1, 4) for n in range(3 * t)]
    got = trees(spark, rows, cap=4)
    assert len(got) == 18 and all(r.tree_depth == int(r.span_id, 16) - 4096 for r in got.values())


def test_hierarchy_deep_chain_and_empty(spark):
    rows = [span(n, T1, hexid(n), hexid(n - 1) if n else None) for n in range(700)]
    assert trees(spark, rows)[T1, hexid(699)].tree_depth == 699
    assert trees(spark, rows, cap=10, with_path=False)[T1, hexid(699)].tree_depth == 699
    assert trees(spark, []) == {}


def test_descendants_of_every_node_in_blocks(spark):
    rng = random.Random(8)
    parent = {n: rng.randrange(max(0, n - 3), n) if n and rng.random() < 0.97 else None for n in range(300)} | {300: 301, 301: 300, 302: 300}
    rows = [span(n, T1, hexid(n), None if p is None else hexid(p)) for n, p in parent.items()]
    t = hierarchy.hierarchies(spark.createDataFrame(rows, SPAN), with_path=False)
    want = set()
    for n in range(300):
        way, at = 0, n
        while (at := parent[at]) is not None:
            way += 1
            want.add((hexid(at), hexid(n), way))
    for block in (1, 8, 1000):
        got = [(r.ancestor_span_id, r.span_id, r.distance) for r in hierarchy.descendants(t, block=block).collect()]
        assert len(got) == len(want) and set(got) == want
    some = t.filter("tree_depth = 1").select("trace_id", "span_id")
    tops = {r.span_id for r in some.collect()}
    assert {(r.ancestor_span_id, r.span_id, r.distance) for r in hierarchy.descendants(t, some).collect()} == {x for x in want if x[0] in tops}


@pytest.mark.parametrize("cap", [1000, 3])
def test_nearest_value_above_on_trees_and_circles(spark, cap):
    rng = random.Random(9)
    parent = {n: rng.randrange(n) if n and rng.random() < 0.9 else None for n in range(60)} | {60 + i: 60 + (i + 1) % 40 for i in range(40)} | {100: 61, 101: 100, 102: 103, 103: 102}
    own = {n: f"a{n}" for n in parent if rng.random() < 0.15 and n < 60} | {75: "a75", 101: "b"}
    rows = spark.createDataFrame([("g", str(n), None if p is None else str(p), n, 0, 0, own.get(n)) for n, p in parent.items()], "g string, v string, p string, ord long, recv long, did long, own string")
    got = {r.span_id: r.nearest for r in hierarchy.solve(rows, False, cap, 4).collect()}
    for n in parent:
        at, seen = n, set()
        while at is not None and at not in own and at not in seen:
            seen.add(at)
            at = parent[at]
        assert got[str(n)] == own.get(at), n
