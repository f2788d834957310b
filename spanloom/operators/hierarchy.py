"""Parent-child links as full hierarchies: root, depth, path, subtree size and nested-set range of every node.

Method: subtree sizes are computed upward, siblings get preorder ranges by prefix sums downward, and the nested-set
ranges then tell ancestors from descendants: u is above v if ``lo(u) < lo(v) <= hi(u)`` in the same tree. Nodes that the
upward pass never finishes lie on a circle; those that the downward pass never reaches hang below one.

Two forms of the same passes, chosen by the number of rows of the group (trace):

* groups of up to ``cap`` rows are whole in one task, level by level on arrays (``mapInArrow`` after one shuffle by group);
* larger groups, however large, are spread over the cluster by node. Each round doubles the distance a node sees, so a
  tree of depth d takes log2(d) rounds upward and as many downward. A round in which the number of nodes that have not
  reached a root stays the same leaves only nodes on or below circles.

``solve`` works on any rows of links; with a column ``own`` it also gives every node its ``nearest`` value: its own, else
that of the nearest node above that has one, on circles too.

Defined results: rows without group or node id are dropped (they can't be linked). A node that came several times
counts once, with the parent and the order of its first delivery. A parent that is null, blank, all zeros or absent
makes a root; a node that is its own parent is a circle. Nodes on or below a circle have root '', depth -1, and null
path, range and size. Siblings are ordered by start, then by id. Empty input gives an empty result; other columns play
no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import canonical_id, parent_id
from ..joins import fits_broadcast, lookup
from ..storage import Scratch

GROUP_CAP = 50_000
CHUNK = 100_000
#: Large groups that may be listed in a filter.
FEW_HEAVY = 500
OUT = "trace_id string, span_id string, parent_span_id string, root_span_id string, tree_depth int, path string, lo bigint, hi bigint, subtree_size bigint, nearest string"
_ARROW = pa.schema([("trace_id", pa.string()), ("span_id", pa.string()), ("parent_span_id", pa.string()), ("root_span_id", pa.string()), ("tree_depth", pa.int32()), ("path", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("subtree_size", pa.int64()), ("nearest", pa.string())])
#: Nodes of a tree in one block of a range join.
RANGE_BLOCK = 64


def links(df: DataFrame) -> DataFrame:
    """Slim rows of ``otel_spans``: canonical ids, parent, and what orders siblings and copies."""
    return df.select(
        canonical_id("trace_id", 16).alias("g"),
        canonical_id("span_id", 8).alias("v"),
        parent_id("parent_span_id").alias("p"),
        F.coalesce(F.col("start_time_unix_nano"), F.lit(0)).cast("long").alias("ord"),
        F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(2**63 - 1)).alias("recv"),
        F.coalesce(F.col("delivery_id").cast("long"), F.lit(-(2**63))).alias("did"),
    ).filter(F.col("g").isNotNull() & F.col("v").isNotNull())


def span_links(spans: DataFrame, own: Column | None = None) -> DataFrame:
    """The same of clean spans, which are there once and have their ids in one notation."""
    cols = [F.col("trace_id").alias("g"), F.col("span_id").alias("v"), F.col("parent_span_id").alias("p"), F.coalesce(F.col("start"), F.lit(0)).cast("long").alias("ord"), F.lit(0).cast("long").alias("recv"), F.lit(0).cast("long").alias("did")]
    return spans.select(*cols, *([own.alias("own")] if own is not None else []))


def nearest_above(own: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Row whose value holds for each row: itself, or the nearest above with a value; -1 if there is none. By doubling."""
    at, jump = np.where(own, np.arange(len(own)), -1), parent.copy()
    for _ in range(max(1, int(len(own)).bit_length())):
        need = np.flatnonzero((at < 0) & (jump >= 0))
        if not len(need):
            break
        to = jump[need]
        at[need], jump[need] = at[to], jump[to]
    return at


def forest(parent: np.ndarray, tie: np.ndarray) -> dict[str, np.ndarray]:
    """Passes over whole groups: ``parent`` holds row numbers, -1 for roots; ``tie`` orders siblings.

    Depth is -1 on and below circles.
    """
    n = len(parent)
    size, left = np.ones(n, np.int64), np.bincount(parent[parent >= 0], minlength=n)
    done, front = np.zeros(n, bool), np.flatnonzero(left == 0)
    while len(front):  # upward: whoever has all children's sizes
        done[front] = True
        p = parent[front]
        has = p >= 0
        np.add.at(size, p[has], size[front][has])
        np.subtract.at(left, p[has], 1)
        p = np.unique(p[has])
        front = p[left[p] == 0]
    kids = np.flatnonzero(parent >= 0)
    kids = kids[np.lexsort((tie[kids], parent[kids]))]
    first = np.searchsorted(parent[kids], np.arange(n), "left")
    last = np.searchsorted(parent[kids], np.arange(n), "right")
    before = np.cumsum(size[kids]) - size[kids]  # prefix sums over siblings, less what precedes the first of them
    lo, depth, root = np.full(n, -1, np.int64), np.full(n, -1, np.int32), np.full(n, -1, np.int64)
    front = np.flatnonzero((parent < 0) & done)
    lo[front], depth[front], root[front] = 0, 0, front
    while len(front):  # downward: ranges of the children of the last level
        count = last[front] - first[front]
        front, count = front[count > 0], count[count > 0]
        if not len(front):
            break
        at = np.repeat(first[front], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        up, k = np.repeat(front, count), kids[at]
        lo[k] = lo[up] + 1 + before[at] - np.repeat(before[first[front]], count)
        depth[k], root[k] = depth[up] + 1, root[up]
        front = k
    return {"size": size, "lo": lo, "depth": depth, "root": root, "circle": ~done}


def _solve(t: pd.DataFrame, with_path: bool) -> pa.RecordBatch:
    t = t.sort_values(["g", "v", "recv", "did"]).drop_duplicates(["g", "v"]).reset_index(drop=True)
    g, v, p = t["g"].to_numpy(object), t["v"].to_numpy(object), t["p"].to_numpy(object)
    names = pd.Index(t["g"] + "/" + t["v"])
    parent = names.get_indexer(t["g"] + "/" + t["p"].fillna("\0"))
    parent[t["p"].isna().to_numpy()] = -1
    tie = np.empty(len(t), np.int64)
    tie[np.lexsort((np.arange(len(t)), t["ord"].to_numpy()))] = np.arange(len(t))
    f = forest(parent, tie)
    ok = f["depth"] >= 0
    path = np.full(len(t), None, object)
    if with_path:  # level by level: one concatenation of arrays for all nodes of a depth
        by_depth = np.argsort(f["depth"], kind="stable")
        for level in np.split(by_depth, np.flatnonzero(np.diff(f["depth"][by_depth])) + 1):
            if len(level) and (d := f["depth"][level[0]]) >= 0:
                path[level] = v[level] if d == 0 else path[parent[level]] + "/" + v[level]
    near = np.full(len(t), None, object)
    if "own" in t:
        own = t["own"].to_numpy(object)
        at = nearest_above(t["own"].notna().to_numpy(), parent)
        near[at >= 0] = own[at[at >= 0]]
    root = np.where(ok, v[np.maximum(f["root"], 0)], "")
    null = lambda x: pa.array(x, pa.int64(), mask=~ok)
    return pa.record_batch([pa.array(g, pa.string()), pa.array(v, pa.string()), pa.array(np.where(parent >= 0, p, None), pa.string()), pa.array(root, pa.string()), pa.array(f["depth"]), pa.array(path, pa.string()), null(f["lo"]), null(f["lo"] + f["size"] - 1), null(f["size"]), pa.array(near, pa.string())], schema=_ARROW)


def _groups(with_path: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rb in batches:  # sorted by group: a chunk ends where a group does
            t = rb.to_pandas()
            if not len(t):
                continue
            if n >= CHUNK and (cut := int((t["g"] != held[-1]["g"].iloc[-1]).to_numpy().argmax())) + int(t["g"].iloc[0] != held[-1]["g"].iloc[-1]):
                yield _solve(pd.concat([*held, t.iloc[:cut]]), with_path)
                held, n, t = [], 0, t.iloc[cut:]
            held.append(t)
            n += len(t)
        if held:
            yield _solve(pd.concat(held), with_path)

    return run


def _spread(rows: DataFrame, with_path: bool, scratch: Scratch, hot_rows: int) -> DataFrame:
    """The passes over large groups, by doubling."""
    has_own = "own" in rows.columns
    if not has_own:
        rows = rows.withColumn("own", F.lit(None).cast("string"))
    nodes = rows.groupBy("g", "v").agg(F.min_by(F.struct("p", "ord", "own"), F.struct("recv", "did")).alias("x")).select("g", "v", "x.p", "x.ord", "x.own")
    nodes = scratch.cut(nodes, "nodes")
    known = nodes.select("g", F.col("v").alias("p"), F.lit(True).alias("known"))
    linked = lookup(nodes.filter("p is not null"), known, ["g", "p"], hot_rows).select("g", "v", F.when(F.col("known"), F.col("p")).alias("p"), "ord", "own")
    base = scratch.cut(linked.unionByName(nodes.filter("p is null")), "base")

    # upward: size holds what lies less than 2^k below, jump is the ancestor 2^k above, root and depth are set once there is none
    # (near is the nearest own value within that distance)
    s = base.select("g", "v", "p", "ord", F.col("own").alias("near"), F.col("p").alias("jump"), F.when(F.col("p").isNull(), F.col("v")).alias("root"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.lit(1).cast("long").alias("size"))
    s, open_before = scratch.cut(s, "up"), None
    while True:
        n_open = s.filter("jump is not null").agg(F.count(F.lit(1)), F.sum(F.when(F.col("near").isNull() & F.lit(has_own), 1).otherwise(0))).first()
        if n_open[0] == 0 or n_open == open_before:
            break
        open_before = n_open
        below = s.filter("jump is not null").groupBy("g", F.col("jump").alias("v")).agg(F.sum("size").alias("more"))
        seen = s.select("g", F.col("v").alias("jump"), F.col("jump").alias("jump2"), F.col("root").alias("root2"), F.col("dist").alias("dist2"), F.col("near").alias("near2"))
        moved = lookup(s.filter("jump is not null"), seen, ["g", "jump"], hot_rows)
        moved = moved.select("g", "v", "p", "ord", F.coalesce("near", "near2").alias("near"), F.col("jump2").alias("jump"), F.col("root2").alias("root"), (F.col("dist") + F.col("dist2")).alias("dist"), "size")
        s = s.filter("jump is null").unionByName(moved).join(below.hint("merge"), ["g", "v"], "left")
        s = scratch.cut(s.withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more"), "up")
    circles = s.filter("root is null").select("g", "v", "p", F.lit("").alias("root"), F.lit(-1).alias("dist"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("size"), "near")

    # prefix sums over siblings, in two levels, so that one parent's children need not be in one task
    good = s.filter("root is not null")
    kids = good.filter("p is not null")
    n_kids = kids.count()
    wide = kids.repartitionByRange("g", "p", "ord", "v") if n_kids else kids
    wide = scratch.cut(wide.withColumn("part", F.spark_partition_id()), "wide")
    part_sums = wide.groupBy("g", "p", "part").agg(F.sum("size").alias("s"))
    offsets = part_sums.withColumn("ahead", F.coalesce(F.sum("s").over(Window.partitionBy("g", "p").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("g", "p", "part", "ahead")
    within = F.sum("size").over(Window.partitionBy("g", "p", "part").orderBy("ord", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = lookup(wide.withColumn("within", within), offsets, ["g", "p", "part"], hot_rows).withColumn("off", F.col("within") + F.col("ahead") + 1)
    d = placed.select("g", "v", "p", "root", "dist", "size", "near", "off").unionByName(good.filter("p is null").select("g", "v", "p", "root", "dist", "size", "near", F.lit(0).cast("long").alias("off")))

    # downward: off and path hold the sums over the last 2^k nodes of the way from the root
    path = F.col("v") if with_path else F.lit(None).cast("string")
    d = scratch.cut(d.withColumn("jump", F.col("p")).withColumn("path", path), "down")
    while d.filter("jump is not null").count():
        seen = d.select("g", F.col("v").alias("jump"), F.col("jump").alias("jump2"), F.col("off").alias("off2"), F.col("path").alias("path2"))
        moved = lookup(d.filter("jump is not null"), seen, ["g", "jump"], hot_rows)
        joined = F.concat("path2", F.lit("/"), "path")
        moved = moved.select("g", "v", "p", "root", "dist", "size", "near", (F.col("off") + F.col("off2")).alias("off"), F.col("jump2").alias("jump"), joined.alias("path"))
        d = scratch.cut(d.filter("jump is null").unionByName(moved), "down")
    trees = d.select("g", "v", "p", "root", F.col("dist").cast("int").alias("dist"), "path", F.col("off").alias("lo"), "size", "near")
    out = scratch.cut(trees.unionByName(circles), "spread")
    scratch.drop("nodes", "base", "up", "wide", "down")
    return out.select(F.col("g").alias("trace_id"), F.col("v").alias("span_id"), F.col("p").alias("parent_span_id"), F.col("root").alias("root_span_id"), F.col("dist").alias("tree_depth"), "path", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"), F.col("size").alias("subtree_size"), F.col("near").alias("nearest"))


def hierarchies(df: DataFrame, with_path: bool = True, cap: int = GROUP_CAP, hot_rows: int = 200_000) -> DataFrame:
    """One row per distinct span of ``otel_spans``-like rows."""
    # rows are counted by the ids as they are written, which are put into one notation afterwards
    sizes = df.groupBy("trace_id").count().groupBy(canonical_id("trace_id", 16).alias("g")).agg(F.sum("count").alias("count"))
    return solve(links(df), with_path, cap, hot_rows, sizes).drop("nearest")


def solve(rows: DataFrame, with_path: bool = True, cap: int = GROUP_CAP, hot_rows: int = 200_000, sizes: DataFrame | None = None) -> DataFrame:
    """The hierarchies of rows of links (``g``, ``v``, ``p``, ``ord``, ``recv``, ``did`` and perhaps ``own``).

    ``sizes`` (``g``, ``count``) are the groups' numbers of rows, where they can be had more cheaply.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hierarchy")
    sizes = rows.groupBy("g").count() if sizes is None else sizes
    heavy = sizes.filter((F.col("count") > cap) & F.col("g").isNotNull()).select("g")
    heavy = scratch.cut(heavy, "heavy")
    n_heavy = heavy.count()
    if n_heavy == 0:
        light, large = rows, None
    elif n_heavy <= FEW_HEAVY:  # a list in the filter
        ids = [r["g"] for r in heavy.collect()]
        light, large = rows.filter(~F.col("g").isin(ids)), rows.filter(F.col("g").isin(ids))
    elif fits_broadcast(n_heavy, 64):
        light, large = rows.join(F.broadcast(heavy), "g", "left_anti"), rows.join(F.broadcast(heavy), "g", "left_semi")
    else:  # salted, for the large groups' rows
        k = 64
        salted, spread = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(k))), heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("salt", F.col("salt").cast("long"))
        light, large = salted.join(spread, ["g", "salt"], "left_anti").drop("salt"), salted.join(spread, ["g", "salt"], "left_semi").drop("salt")
    out = light.repartition("g").sortWithinPartitions("g").mapInArrow(_groups(with_path), OUT)
    return out if large is None else out.unionByName(_spread(large, with_path, scratch, hot_rows))


def descendants(trees: DataFrame, of: DataFrame | None = None, block: int = RANGE_BLOCK) -> DataFrame:
    """All nodes below every node, or below the ones in ``of`` (``trace_id``, ``span_id``), by nested-set ranges.

    A tree's preorder numbers fall into blocks; a node goes to the blocks that its range covers and meets the nodes there.
    So a join key holds at most ``block`` nodes and those above them, however large the tree, and what is compared is the
    result and at most ``block`` more a node. ``trees`` is read twice: give a written table.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(block))
    top = trees.filter("lo is not null and hi > lo")
    if of is not None:
        top = top.join(of.select("trace_id", "span_id").distinct(), ["trace_id", "span_id"], "left_semi")
    top = top.select("trace_id", "root_span_id", F.col("span_id").alias("ancestor_span_id"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("tree_depth").alias("a_depth"))
    top = top.withColumn("b", F.explode(F.sequence(F.floor((F.col("a_lo") + 1) / F.lit(block)), at("a_hi"))))
    below = trees.filter("lo > 0").select("trace_id", "root_span_id", "span_id", "lo", "tree_depth", at("lo").alias("b"))
    met = below.join(top, ["trace_id", "root_span_id", "b"]).filter("lo > a_lo and lo <= a_hi")
    return met.select("trace_id", "ancestor_span_id", "span_id", (F.col("tree_depth") - F.col("a_depth")).alias("distance"))
