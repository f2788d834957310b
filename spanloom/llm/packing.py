"""Filling fixed-capacity containers with items: vector bin packing by the dot-product heuristic.

An item is a text's length in tokens, one segment, and its loss-bearing tokens; a container limits all three at once.
Items are dealt by hash to shards of at most ``shard_items``, packed in one task each. A shard fills one container after
the other: of the items that still fit in every dimension it takes the one whose size, weighted by what is left of each
dimension, has the largest dot product, until none fits. Items of equal size form one class, so a step looks at the
distinct sizes only.

What a shard leaves behind are its last containers, not well filled. The items of containers filled to less than
``well_filled`` go on to a next round, dealt anew to shards of the same size, as long as a round leaves at most half of
what it got; items that fill no container well stay where they are after one round.

Only an item of more tokens than a container is divided: full containers of its own, and a last piece that is packed
with the others. An item within the capacity whose loss alone exceeds the loss limit can't be placed within that limit and
isn't divided either: it gets a container of its own, named ``a-…`` like the full pieces. So every container keeps the
limit on tokens, and every container that is shared keeps all three; nothing is clipped.

Defined results: items of size 0, null or negative size need no place and aren't placed. Equal ids are told apart by
``piece`` only within a row; rows are placed one by one, repeated rows too. Null loss counts as 0, loss above the size as
the size. Empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

SHARD_ITEMS = 20_000
#: Weights of tokens and loss in the dot product; tokens are what unused space is measured in. (A segment is one for all.)
WEIGHTS = (3.0, 1.0)
PLACED = "kind string, container string, id {id}, piece int, from_token int, to_token int, loss int"


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """Container number of each item; ``limits`` are tokens, segments and loss tokens of a container.

    Every item must fit into an empty container.
    """
    cap_t, cap_s, cap_l = limits
    keys, cls = np.unique(np.stack([-tokens, -loss], 1), axis=0, return_inverse=True)  # largest first
    cls = cls.ravel()
    order = np.argsort(cls, kind="stable")
    left = np.bincount(cls, minlength=len(keys))
    nxt = np.cumsum(left) - left
    t, l = -keys[:, 0], -keys[:, 1]
    out, n = np.full(len(tokens), -1), 0
    at = np.arange(len(keys))  # classes that have items left, largest first
    ta, la = t, l
    wt, wl = WEIGHTS[0] * t / cap_t**2, WEIGHTS[1] * l / cap_l**2
    wta, wla = wt, wl
    while len(at):
        rest_t, rest_s, rest_l = cap_t, cap_s, cap_l
        while rest_s > 0 and rest_t > 0:
            i = np.searchsorted(-ta, -rest_t)  # classes from here on fit in tokens
            if i == len(ta):
                break
            score = wta[i:] * rest_t + wla[i:] * rest_l
            if la[i] > rest_l or la[i:].max() > rest_l:
                score = np.where(la[i:] <= rest_l, score, -1.0)
            j = int(score.argmax())
            if score[j] < 0:
                break
            k = at[i + j]
            # as many of this class as stay the best choice: fill with it while it fits half of what is left
            fits = min(rest_t // t[k], rest_s, rest_l // l[k] if l[k] else rest_s)
            m = min(int(left[k]), max(1, int(fits // 2)))
            out[order[nxt[k] : nxt[k] + m]] = n
            nxt[k] += m
            left[k] -= m
            rest_t, rest_s, rest_l = rest_t - m * t[k], rest_s - m, rest_l - m * l[k]
            if not left[k]:
                keep = np.ones(len(at), bool)
                keep[i + j] = False
                at, ta, la, wta, wla = at[keep], ta[keep], la[keep], wta[keep], wla[keep]
        n += 1
    return out


def _round(limits: dict[str, tuple[int, int, int]], n_round: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece"], kind="stable", na_position="first").reset_index(drop=True)
        kind, shard = pdf["kind"].iloc[0], int(pdf["shard"].iloc[0])
        size = (pdf["to_token"] - pdf["from_token"]).to_numpy()
        box = pack(size, pdf["loss"].to_numpy(), limits[kind])
        pdf["container"] = [f"{n_round}-{shard}-{b}" for b in box]
        pdf["fill"] = np.bincount(box, weights=size)[box] / limits[kind][0]
        return pdf[["kind", "container", "id", "piece", "from_token", "to_token", "loss", "fill"]]

    return run


def _loss_between(a: Column, b: Column, with_prompts: bool) -> Column:
    """Loss-bearing tokens of a text from token a up to token b: exact by the prompts' ranges, else in proportion."""
    if with_prompts:
        inside = lambda p: F.greatest(F.lit(0), F.least(p["to"], b) - F.greatest(p["from"], a))
        return b - a - F.aggregate(F.coalesce("prompts", F.slice("prompts", 1, 0)), F.lit(0), lambda s, p: s + inside(p))
    share = lambda x: F.floor(F.col("l").cast("long") * x / F.col("t"))
    return (share(b) - share(a)).cast("int")


def _shard_size(shard_items: int) -> int:
    """Expected items of a shard, so far below ``shard_items`` that chance doesn't lead above it."""
    return max(1, int(shard_items - 6 * shard_items**0.5))


def pack_items(items: DataFrame, kinds: dict[str, tuple[int, int, int]], item_id: str = "doc_id", tokens: str = "n_tokens", loss: str = "n_loss", prompts: str | None = None, shard_items: int = SHARD_ITEMS, well_filled: float = 0.97) -> DataFrame:
    """Where every item lies, for each kind of container: ``kind``, ``container``, id, ``piece``, its range of tokens, ``loss``.

    ``kinds`` are the limits (tokens, segments, loss tokens) by name; ``prompts``, a column of token ranges without loss,
    makes the loss of pieces exact, which else is taken in proportion.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    size = F.col(tokens).cast("int")
    slim = items.select(F.col(item_id).alias("id"), size.alias("t"), F.least(F.greatest(F.coalesce(F.col(loss).cast("int"), F.lit(0)), F.lit(0)), size).alias("l"), *([F.col(prompts).alias("prompts")] if prompts else [])).filter("t > 0")
    slim = scratch.cut(slim, "items")
    table = spark.createDataFrame([(k, int(c[0]), int(c[2])) for k, c in kinds.items()], "kind string, cap int, cap_l int")
    every = slim.crossJoin(F.broadcast(table))  # a few kinds
    n_pieces = F.ceil(F.col("t") / F.col("cap")).cast("int")
    pieces = every.select("*", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece"))
    pieces = pieces.withColumn("from_token", F.col("piece") * F.col("cap")).withColumn("to_token", F.least((F.col("piece") + 1) * F.col("cap"), "t"))
    pieces = pieces.withColumn("loss", F.when(n_pieces == 1, F.col("l")).otherwise(_loss_between(F.col("from_token"), F.col("to_token"), prompts is not None)))
    alone = (F.col("to_token") - F.col("from_token") == F.col("cap")) | (F.col("loss") > F.col("cap_l"))
    pieces = scratch.cut(pieces.select("kind", "id", "piece", "from_token", "to_token", "loss", alone.alias("alone"), F.monotonically_increasing_id().alias("row")), "pieces")
    cols = ["kind", "container", "id", "piece", "from_token", "to_token", "loss"]
    done = [pieces.filter("alone").withColumn("container", F.concat(F.lit("a-"), F.col("row").cast("string"))).select(cols)]
    rest, n_round, before = pieces.filter("not alone").drop("alone", "row"), 0, None
    schema = PLACED.format(id=slim.schema["id"].dataType.simpleString()) + ", fill double"
    while n_of := {r["kind"]: r["count"] for r in rest.groupBy("kind").count().collect()}:
        shards = {k: max(1, -(-n // _shard_size(shard_items))) if n > shard_items else 1 for k, n in n_of.items()}
        n_shards = F.create_map(*[F.lit(x) for kv in shards.items() for x in kv])[F.col("kind")]
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(n_round), "id", "piece"), n_shards).cast("int"))
        fullest = dealt.groupBy("kind", "shard").count().agg(F.max("count")).first()[0]
        if fullest > shard_items:  # many rows of one id: rows are dealt one by one
            dealt = scratch.cut(rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(n_round), F.monotonically_increasing_id()), n_shards).cast("int")), f"dealt{n_round}")
        dealt = dealt.repartition(sum(shards.values()), "kind", "shard")
        packed = scratch.cut(dealt.groupBy("kind", "shard").applyInPandas(_round(kinds, n_round), schema), f"round{n_round}")
        good = F.col("fill") >= well_filled
        n_left = packed.filter(~good).count()
        if max(shards.values()) == 1 or n_left == 0 or n_left > sum(n_of.values()) / 2:
            done.append(packed.select(cols))
            break
        done.append(packed.filter(good).select(cols))
        rest, n_round = packed.filter(~good).drop("container", "fill"), n_round + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("id", item_id)


def check(placed: DataFrame, kinds: dict[str, tuple[int, int, int]], item_id: str = "doc_id") -> DataFrame:
    """Per kind: items placed, and the faults: containers above a limit, ranges that don't join, items divided without need."""
    table = placed.sparkSession.createDataFrame([(k, *map(int, c)) for k, c in kinds.items()], "kind string, cap int, cap_s int, cap_l int")
    size = F.col("to_token") - F.col("from_token")
    n = lambda c: F.sum(c.cast("long"))
    box = placed.groupBy("kind", "container").agg(F.sum(size).alias("t"), F.count(F.lit(1)).alias("s"), F.sum("loss").alias("l")).join(F.broadcast(table), "kind")
    shared = F.col("s") > 1
    boxes = box.groupBy("kind").agg(F.count(F.lit(1)).alias("n_containers"), n(F.col("t") > F.col("cap")).alias("over_tokens"), n(shared & (F.col("s") > F.col("cap_s"))).alias("over_segments"), n(shared & (F.col("l") > F.col("cap_l"))).alias("over_loss"), n(F.col("s") == F.col("cap_s")).alias("at_segments"), n(shared & (F.col("l") == F.col("cap_l"))).alias("at_loss"), n(~shared & (F.col("l") > F.col("cap_l"))).alias("alone_over_loss"), (1 - F.sum("t") / F.sum("cap")).alias("unused"))
    item = placed.groupBy("kind", item_id).agg(F.min("from_token").alias("a"), F.max("to_token").alias("b"), F.sum(size).alias("t"), F.count(F.lit(1)).alias("m")).join(F.broadcast(table), "kind")
    gaps = (F.col("a") != 0) | (F.col("b") != F.col("t"))
    items = item.groupBy("kind").agg(F.count(F.lit(1)).alias("n_items"), F.sum("t").alias("n_tokens"), n(gaps).alias("gaps"), n((F.col("m") > 1) & (F.col("t") <= F.col("cap"))).alias("divided_small"))
    return items.join(boxes, "kind")
