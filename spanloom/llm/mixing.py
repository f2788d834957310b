"""Mixing sources to target weights by pivotal dependent rounding.

The mix is as large as the shares allow: the source that runs out first, all its texts taken ``max_repeats`` times, sets
the total. Every text of a source then has the same expected number of copies; its whole part is certain, its
fractional part a probability. Pivotal rounding makes the probabilities 0 or 1: of two texts a and b, mass moves from
one to the other, weighted by their tokens, in a random direction whose chances keep both expectations, until one of
them is decided. So the tokens of a source stay what they should be but for the one text left over.

Texts that hold more than ``large_share`` of their source, at most 1 / large_share of them, are decided first, largest
first, each paired with all smaller texts of its source as one: what it gains or loses is spread over these, whose
probabilities stay equal. So no long text is the one left undecided.

The others run through a reduction tree: texts fall into blocks by the hash of their id, a block is rounded in one task and
passes on at most one undecided text; those are rounded together, up to ``fan_in`` at a time, until one per source is
left, which is rounded by its probability. Within a block texts are taken by size, largest first, so that what is left
undecided is small. The random numbers come from seed, source and block: files, partitions and lost tasks don't matter.

Defined results: texts of no tokens or of a source without a target are left out. A target source that has no tokens
gets none, and the mix is then set by the others, their shares scaled to 1. Null sources are left out. Ids needn't be
unique: rows are drawn. Empty input gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Scratch

#: Share of a source's tokens above which a text is decided by itself.
LARGE_SHARE = 0.001
#: Expected texts of a block.
BLOCK_ITEMS = 50_000
#: Undecided texts of a block up to which they are paired one after the other.
FEW = 256
_SCHEMA = "source string, id {id}, size bigint, base int, p double, extra int, block bigint"
_SURE = 1e-9


def pivot(w: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities after pivotal rounding of weights ``w``, largest first, and whether each is decided (0 or 1); one at most isn't.

    Neighbours are paired all at once, level by level, each pair deciding one of the two; the last few are paired one
    after the other.
    """
    p = p.astype(float).copy()
    p[p <= _SURE], p[p >= 1 - _SURE] = 0.0, 1.0

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        up, down = np.minimum((1 - p[a]) * w[a], p[b] * w[b]), np.minimum(p[a] * w[a], (1 - p[b]) * w[b])  # mass from b to a, from a to b
        move = np.where(rng.random(len(a)) * (up + down) < down, up, -down)
        for i, q in ((a, p[a] + move / w[a]), (b, p[b] - move / w[b])):
            p[i] = np.where(q <= _SURE, 0.0, np.where(q >= 1 - _SURE, 1.0, q))

    live = np.flatnonzero((p > 0) & (p < 1))
    while len(live) > FEW:
        n = len(live) // 2 * 2
        settle(live[0:n:2], live[1:n:2])
        live = live[(p[live] > 0) & (p[live] < 1)]
    held = live[:1]
    for i in live[1:]:
        if len(held):
            settle(held, np.array([i]))
            pair = np.array([held[0], i])
            held = pair[(p[pair] > 0) & (p[pair] < 1)][:1]
        else:
            held = np.array([i])
    return p, (p == 0) | (p == 1)


def settle_large(w: list[int], p: float, mass: float, rng: np.random.Generator) -> tuple[list[float], float]:
    """Probabilities of texts of weights ``w``, largest first, and that of all the others, whose weights sum to ``mass``.

    All begin with p. Each text in turn is paired with all that follow it as one text: one of the two becomes 0 or 1.
    """
    out, rest = [], float(mass + sum(w))
    for x in w:
        rest -= x
        if p <= _SURE or p >= 1 - _SURE or rest <= 0:
            out.append(p)  # decided together with all others, or nothing is left to pair it with
            continue
        up, down = min((1 - p) * x, p * rest), min(p * x, (1 - p) * rest)
        move = up if rng.random() * (up + down) < down else -down
        q, p = p + move / x, min(1.0, max(0.0, p - move / rest))
        out.append(0.0 if q <= _SURE else 1.0 if q >= 1 - _SURE else q)
    return out, 0.0 if p <= _SURE else 1.0 if p >= 1 - _SURE else p


def _node(seed: str, level: int, key: str):
    """Rounds one block of a source; rows are ordered by size, then by hash and id, so that their order of arrival doesn't count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        block = int(pdf[key].iloc[0])
        rng = np.random.default_rng(zlib.crc32(f"{seed}:{level}:{pdf['source'].iloc[0]}:{block}".encode()))
        p, decided = pivot(pdf["size"].to_numpy(float), pdf["p"].to_numpy(), rng)
        pdf["p"], pdf["extra"], pdf["block"] = p, np.where(decided, p, -1).astype(np.int32), block
        return pdf[["source", "id", "size", "base", "p", "extra", "block"]]

    return run


def plan(sizes: list[tuple[str, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Expected copies of each text, by source: ``sizes`` are tokens there are, ``targets`` (source, share, most repeats)."""
    have = {s: n for s, n in sizes if n}
    live = [(s, w, r) for s, w, r in targets if s in have and w and w > 0]
    whole = sum(w for _, w, _ in live)
    if not live:
        return {}
    most = min(r * have[s] / (w / whole) for s, w, r in live)
    most = most if total is None else min(most, total)
    return {s: min(float(r), w / whole * most / have[s]) for s, w, r in live}


def mix(docs: DataFrame, targets: list[tuple[str, float, int]], doc_id: str = "doc_id", source: str = "source", size: str = "n_tokens", total: float | None = None, seed: str = "mix", fan_in: int = 1000, block_items: int = BLOCK_ITEMS, large_share: float = LARGE_SHARE) -> DataFrame:
    """``source``, id, ``size`` and ``n_copies`` of every text that is drawn."""
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = docs.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), F.col(size).cast("long").alias("size")).filter("size > 0 and source is not null")
    known = scratch.cut(slim.filter(F.col("source").isin([s for s, _, _ in targets])), "sizes")
    sizes = [(r["source"], r["n"]) for r in known.groupBy("source").agg(F.sum("size").alias("n")).collect()]  # one row per target
    copies = plan(sizes, targets, total)
    id_type = slim.schema["id"].dataType.simpleString()
    schema = _SCHEMA.format(id=id_type)
    if not copies:
        return docs.sparkSession.createDataFrame([], f"source string, {doc_id} {id_type}, size bigint, n_copies int")
    edge = dict((s, max(1, int(n * large_share))) for s, n in sizes)
    by_source = lambda values, kind: F.create_map(*[x for s in copies for x in (F.lit(s), F.lit(values[s]).cast(kind))])[F.col("source")]
    rows = known.filter(F.col("source").isin(list(copies))).withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("large", F.col("size") > by_source(edge, "bigint"))
    large: dict[str, list] = {s: [] for s in copies}
    for r in rows.filter("large").select("source", "id", "size", "h").collect():  # at most 1 / large_share per source
        large[r["source"]].append(r)
    decided, undecided, p_rest = [], [], {}
    for s, mine in large.items():
        mine.sort(key=lambda r: (-r["size"], r["h"], str(r["id"])))
        base = int(copies[s])
        all_of = dict(sizes)[s]
        ps, p_rest[s] = settle_large([r["size"] for r in mine], copies[s] - base, all_of - sum(r["size"] for r in mine), np.random.default_rng(zlib.crc32(f"{seed}:large:{s}".encode())))
        for r, q in zip(mine, ps):
            (decided if q in (0.0, 1.0) else undecided).append((s, r["id"], r["size"], base, q, int(q) if q in (0.0, 1.0) else -1, -1))
    first = docs.sparkSession.createDataFrame(decided + undecided, T._parse_datatype_string(schema))
    rows = rows.filter("not large").select("source", "id", "size", "h", by_source({s: int(x) for s, x in copies.items()}, "int").alias("base"), by_source(p_rest, "double").alias("p"))
    n_of = known.groupBy("source").count().collect()  # one row per target
    blocks = F.create_map(*[F.lit(x) for r in n_of for x in (r["source"], -(-r["count"] // block_items))])[F.col("source")]
    leaves = rows.withColumn("b", F.pmod("h", blocks))
    leaf = scratch.cut(leaves.groupBy("source", "b").applyInPandas(_node(seed, 0, "b"), schema), "leaf")
    done, level = [leaf.filter("extra >= 0"), first.filter("extra >= 0")], 0
    rest = leaf.unionByName(first).filter("extra < 0")
    while rest.count() > len(copies):
        level += 1
        up = rest.withColumn("up", F.greatest(F.lit(0), F.floor(F.col("block") / F.lit(fan_in)))).withColumn("h", F.xxhash64(F.lit(seed), "id"))
        node = scratch.cut(up.groupBy("source", "up").applyInPandas(_node(seed, level, "up"), schema), f"level{level}")
        done.append(node.filter("extra >= 0"))
        rest = node.filter("extra < 0")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), "source")), 1, 12), 16, 10).cast("double") / float(16**12)
    done.append(rest.withColumn("extra", (u < F.col("p")).cast("int")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("source", F.col("id").alias(doc_id), "size", (F.col("base") + F.col("extra")).alias("n_copies")).filter("n_copies > 0")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: tokens, share reached and wanted, texts and the most copies of one."""
    per = drawn.groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("n_copies").alias("most_copies"))
    total = per.agg(F.sum("n_tokens").alias("all_tokens"))
    out = targets.join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce("n_tokens", F.lit(0))
    return out.select("source", "target_share", (n / F.col("all_tokens")).alias("share"), n.alias("n_tokens"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
