"""Splits that keep related records together: connected components, then shares.

Components over records that share an entity are found on the graph of entities only: one edge for each distinct
(task, app) pair. Alternating large-star and small-star steps run until the edges stay the same, a few rounds for any
diameter. Minima are aggregated map-side, and nodes with very many neighbours go through ``joins.lookup``, so a hub is
never one task's work. Lineage is cut by a written table each round.

``assign_splits`` hashes component identifiers into ranges proportional to the shares. Components that hold more than
``big_share`` of all records (at most 1 / big_share of them) would spoil the proportions and are placed first, each in
the split that lacks most; the ranges are then proportional to what is still lacking. With ``big_share`` None every
component is hashed: a component's split then depends on its identifier alone, at the price of shares that miss by as much
as the largest components hold.

Defined results: null entities connect nothing. A record without any entity is a component of its own. Repeated rows
are in one component. Empty input gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import HOT_ROWS, lookup
from ..storage import Scratch


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected(edges: DataFrame, scratch: Scratch, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``edges`` (u, v), undirected → (node, root), root being the smallest node of the component."""
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = scratch.cut(e, "edges"), None
    while (now := _state(e)) != before:
        before, n = now, 2 * now[0]  # an edge gives at most two rows in either step
        # large-star: neighbours above a node move to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = lookup(both.filter("v > u"), least, ["u"], hot_rows, n_left=n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.cut(star.filter("u <> v").distinct(), "edges")
        # small-star: neighbours below a node, and the node, move to the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        star = lookup(e, least, ["u"], hot_rows, n_left=n).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        star = star.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = scratch.cut(star.distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def record_groups(records: DataFrame, record_id: str, entities: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``record_id``, ``group_id`` (smallest record id of the component), ``n_records`` and, for each entity column c, ``n_c``."""
    scratch = Scratch(records.sparkSession, "components")
    node = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(c).cast("string"))) for i, c in enumerate(entities)]
    slim = scratch.cut(records.select(F.col(record_id).alias("rid"), *[x.alias(f"e{i}") for i, x in enumerate(node)]), "records")
    keys = [f"e{i}" for i in range(len(node))]
    first, n = F.coalesce(*keys), slim.count()
    links = [slim.select(first.alias("u"), F.col(k).alias("v")).filter("v is not null") for k in keys]
    links = scratch.cut(reduce(DataFrame.unionByName, links).distinct(), "links")
    star = connected(links, scratch, hot_rows)
    alone = links.filter("u = v").select(F.col("u").alias("node"))
    roots = scratch.cut(alone.join(star, "node", "full").select("node", F.coalesce("root", "node").alias("root")), "roots")
    of = lookup(slim.select("rid", first.alias("node")), roots, ["node"], hot_rows, n_left=n)
    of = of.select("rid", F.coalesce("root", F.concat(F.lit("-:"), F.coalesce(F.col("rid").cast("string"), F.lit("")))).alias("root"))
    of = scratch.cut(of, "of")
    sizes = of.groupBy("root").agg(F.min("rid").alias("group_id"), F.count(F.lit(1)).alias("n_records"))
    kinds = roots.groupBy("root").agg(*[F.sum(F.col("node").startswith(f"{i}:").cast("int")).cast("long").alias(f"n_{c}") for i, c in enumerate(entities)])
    per_group = sizes.join(kinds, "root", "left").fillna(0, [f"n_{c}" for c in entities])
    out = lookup(of, per_group, ["root"], hot_rows, n_left=n).drop("root").withColumnRenamed("rid", record_id)
    scratch.drop("records", "links", "edges")
    return out


def assign_splits(groups: DataFrame, targets: list[tuple[str, float]], big_share: float | None = 0.001, seed: str = "split") -> DataFrame:
    """Adds ``split``; ``groups`` is the result of ``record_groups``, ``targets`` are (split, share) pairs."""
    whole = sum(w for _, w in targets)
    n = groups.count()
    lacking = {s: w / whole * n for s, w in targets}
    big = [] if big_share is None else groups.filter(F.col("n_records") > F.lit(big_share * n)).select("group_id", "n_records").distinct().collect()  # at most 1 / big_share
    placed: dict[str, list] = {s: [] for s in lacking}
    for g in sorted(big, key=lambda r: (-r["n_records"], str(r["group_id"]))):
        s = max(lacking, key=lambda x: lacking[x])
        placed[s].append(g["group_id"])
        lacking[s] -= g["n_records"]
    rest = {s: max(0.0, x) for s, x in lacking.items()}
    total = sum(rest.values()) or 1.0
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("group_id").cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    out, upto, names = None, 0.0, [s for s in rest if rest[s] > 0] or list(rest)
    for s in names[:-1]:
        upto += rest[s] / total
        out = (F if out is None else out).when(u < upto, s)
    out = F.lit(names[-1]) if out is None else out.otherwise(names[-1])
    table = [(g, s) for s, gs in placed.items() for g in gs]
    if table:
        fixed = groups.sparkSession.createDataFrame(table, groups.select("group_id").schema.add("fixed", "string"))
        return groups.join(F.broadcast(fixed), "group_id", "left").withColumn("split", F.coalesce("fixed", out)).drop("fixed")
    return groups.withColumn("split", out)
