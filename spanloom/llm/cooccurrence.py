"""Items that appear together: pair counts and how far they exceed chance, by basket collapsing.

Equal baskets (sorted arrays of distinct items) are grouped into weights first, so a basket that a third of all records
share is enumerated once. Items that can't reach ``min_count`` or ``min_share`` are left out before pairs are formed: at
most 1 / min_share times the mean basket size remain. Pairs are enumerated once per distinct basket and the weights are
summed with map-side aggregation.

Defined results: null items don't count, a repeated item counts once in its basket, empty baskets count in no figure.
Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch


def pairs(records: DataFrame, items: str, min_count: int = 1, min_share: float = 0.0) -> DataFrame:
    """``item_a`` < ``item_b``, ``n`` records, ``n_a``, ``n_b``, ``n_ab``, ``lift`` and ``conviction`` (null: infinite)."""
    scratch = Scratch(records.sparkSession, "pairs")
    basket = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))
    baskets = records.select(basket.alias("basket")).filter(F.size("basket") > 0).groupBy("basket").agg(F.count(F.lit(1)).alias("w"))
    baskets = scratch.cut(baskets, "baskets")
    total = baskets.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"))
    single = baskets.select(F.explode("basket").alias("item"), "w").groupBy("item").agg(F.sum("w").alias("k"))
    often = scratch.cut(single.crossJoin(F.broadcast(total)).filter((F.col("k") >= min_count) & (F.col("k") >= min_share * F.col("n"))), "often")
    kept = baskets.withColumn("id", F.monotonically_increasing_id()).select("id", "w", F.explode("basket").alias("item")).join(often.select("item"), "item")
    slim = kept.groupBy("id", "w").agg(F.array_sort(F.collect_list("item")).alias("b")).filter(F.size("b") > 1).groupBy("b").agg(F.sum("w").alias("w"))
    both = slim.select("b", "w", F.posexplode("b").alias("i", "item_a")).select("w", "item_a", F.explode(F.slice("b", F.col("i") + 2, F.size("b"))).alias("item_b"))
    both = both.groupBy("item_a", "item_b").agg(F.sum("w").alias("n_ab")).filter((F.col("n_ab") >= min_count))
    a = often.select(F.col("item").alias("item_a"), F.col("k").alias("n_a"), "n")
    b = often.select(F.col("item").alias("item_b"), F.col("k").alias("n_b"))
    out = both.join(a, "item_a").join(b, "item_b").filter(F.col("n_ab") >= min_share * F.col("n"))
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    miss = 1 - F.col("n_ab") / F.col("n_a")
    conviction = F.when(miss > 0, (1 - F.col("n_b") / F.col("n")) / miss)
    return out.select("item_a", "item_b", "n", "n_a", "n_b", "n_ab", lift.alias("lift"), conviction.alias("conviction"))
