"""Join helpers that stay balanced when few keys hold much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Rows of one key from which the key counts as hot.
HOT_ROWS = 200_000
#: Most bytes that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Copies of a hot key's right row where hot keys are too many to broadcast.
SALTS = 32


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def lookup(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, row_bytes: int = 256, n_left: int | None = None) -> DataFrame:
    """Left join to a table whose ``keys`` are unique.

    Keys with more than ``hot_rows`` left rows, of which there are at most ``rows / hot_rows``, are joined to a
    broadcast copy of their right rows, if that copy's size, ``row_bytes`` a row, is within BROADCAST_BYTES; the
    remaining keys go through an ordinary shuffled join. Without hot keys it is one ordinary join. Null keys
    match nothing. Where ``n_left``, the number of left rows, is known and no key can be hot, none is looked for. Where the
    hot keys' copy would be too large, their left rows get a salt and their right rows one copy per salt. The ordinary join
    is never turned into a broadcast, as its sides grow with the data.
    """
    right = right.hint("merge")
    if n_left is not None and n_left <= hot_rows:
        return left.join(right, keys, "left")
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    hot = left.filter(some).groupBy(*keys).count().filter(F.col("count") > hot_rows).drop("count")
    n = hot.count()
    if n == 0:
        return left.join(right, keys, "left")
    if not fits_broadcast(n, row_bytes):
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
        marked = hot.withColumn("_hot", F.lit(True))
        rest = [c for c, kind in left.dtypes if "map<" not in kind]  # maps have no hash
        salted = left.join(marked, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int")).otherwise(0))
        copies = right.join(marked, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), salts).otherwise(F.array(F.lit(0)))))
        return salted.drop("_hot").join(copies.drop("_hot").hint("merge"), [*keys, "_salt"], "left").drop("_salt")
    hot = hot.withColumn("_hot", F.lit(True))
    flagged = left.join(F.broadcast(hot), keys, "left")
    hot_right = right.join(F.broadcast(hot.drop("_hot")), keys, "left_semi")
    a = flagged.filter(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot_right), keys, "left")
    b = flagged.filter(F.col("_hot").isNull()).drop("_hot").join(right, keys, "left")
    return a.unionByName(b)


def asof_last(left: DataFrame, right: DataFrame, by: str, t: str, value: str, width: int) -> DataFrame:
    """Backward as-of join: each left row with the ``value`` of the last right row of its ``by`` at or before its ``t``.

    Right rows of equal ``t`` are ordered by value. Times fall into buckets of ``width``: windows run within buckets,
    and a second window over the buckets' last values carries them on, so one key's rows are spread over many tasks.
    """
    bucket = F.floor(F.col(t) / F.lit(width))
    a = left.withColumn("_b", bucket).withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    r = right.withColumn("_b", bucket).withColumn("_side", F.lit(0))
    w = Window.partitionBy(by, "_b").orderBy(t, "_side", value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = a.unionByName(r, allowMissingColumns=True).withColumn("_near", F.last(value, ignorenulls=True).over(w)).filter("_side = 1").drop(value, "_side")
    ends = r.groupBy(by, "_b").agg(F.max_by(value, F.struct(t, value)).alias("_end"))
    asked = near.filter("_near is null").select(by, "_b").distinct().withColumn("_end", F.lit(None).cast(right.schema[value].dataType)).withColumn("_ask", F.lit(1))
    v = Window.partitionBy(by).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_ask", F.lit(0)).unionByName(asked).withColumn("_far", F.last("_end", ignorenulls=True).over(v)).filter("_ask = 1").select(by, "_b", "_far")
    return near.join(carried, [by, "_b"], "left").withColumn(value, F.coalesce("_near", "_far")).drop("_b", "_near", "_far")


def next_in_order(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds the ``value`` of the next row of the group in ``order``, null for its last.

    Rows are sorted into ranges; windows run within a range, and the first value of each group that crosses into the next
    range, at most one per border, is joined back: a group may hold any share of the rows.
    """
    parts = Scratch(df.sparkSession, "next").cut(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_part", *group).orderBy(*order)
    firsts = parts.groupBy("_part", *group).agg(F.min(F.struct(*order, F.col(value).alias("_v")))["_v"].alias("_v"))
    across = firsts.withColumn("_over", F.lead("_v").over(Window.partitionBy(*group).orderBy("_part"))).filter("_over is not null").drop("_v")
    keys = ["_part", *group]
    j = parts.withColumn(out, F.lead(value).over(w)).join(F.broadcast(across), keys, "left")  # one row per border at most
    return j.withColumn(out, F.coalesce(out, "_over")).drop("_part", "_over")
