"""Records of evaluation splits that also appear, exactly or almost, in the training split.

Canonicalised texts (case, punctuation and blanks normalised to a set of words) are hashed; records of equal hash form
one class. Evaluation hashes are joined with training hashes, which gives the exact overlaps. For the near ones, the
classes of either side are joined on hashed words of their prefixes: with the words of all classes in one fixed order,
rarest first, two sets whose Jaccard similarity reaches t must share one of the first n - ceil(t n) + 1 words of each;
every candidate is then verified on the whole sets, so nothing is lost and nothing is approximate. The join key holds
the training set's size too, which splits frequent words; what is still frequent is split by blocks on either side. The
order comes from word counts over all classes, in a table
of fixed size (2^18 counters) that is broadcast.

What comes out are pairs of classes with their numbers of records (``class_overlaps``), tasks with theirs
(``task_overlaps``), counts (``report``), or, where they are asked for, all pairs of records (``overlaps``).

Defined results: a text without words, null or empty, matches nothing. Records in neither side play no part. Repeated
records match each for itself. Whole texts count, however long. Empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import words
from ..joins import fits_broadcast, lookup
from ..storage import Scratch

_SLOTS = 1 << 18
#: Rows of a key on one side of a join that stay together.
BLOCK = 2_000


def _slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % _SLOTS


def _key(word: str) -> int:
    """64 bits for a word: equal words meet, and words that happen to share a key only add a candidate."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _prefixes(counts, t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for rb in batches:
            h, sizes, tokens, common = [], [], [], []
            for key, w in zip(rb.column("h").to_pylist(), rb.column("wset").to_pylist()):
                n = len(w)
                k = n - -(-t.numerator * n // t.denominator) + 1
                for x in sorted(w, key=lambda x: (often[_slot(x)], x))[:k]:
                    h.append(key), sizes.append(n), tokens.append(_key(x)), common.append(bool(often[_slot(x)] > BLOCK))
            yield pa.record_batch([pa.array(h, pa.binary()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.int64()), pa.array(common, pa.bool_())], names=["h", "n", "token", "common"])

    return run


def joined(a: DataFrame, b: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """The inner join on ``keys``; a key with more than ``block`` rows on a side is split into blocks of them.

    A block of the one side meets every block of the other in a task of its own, so that no task forms more than
    ``block`` ** 2 pairs of a key.
    """
    na, nb = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na")), b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"))
    wide = na.filter(F.col("_na") > block).join(nb, keys).unionByName(nb.filter(F.col("_nb") > block).join(na.filter(F.col("_na") <= block), keys).select(*keys, "_na", "_nb"))
    wide = Scratch(a.sparkSession, "wide").cut(wide, "keys")
    n = wide.count()
    if n == 0:
        return a.join(b, keys)
    wide = F.broadcast(wide) if fits_broadcast(n, 128) else wide
    parts = lambda c: F.coalesce(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
    mine = lambda df, c: F.pmod(F.xxhash64(*df.columns), parts(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    left = a.join(wide, keys, "left").withColumn("_i", mine(a, "_na")).withColumn("_j", every("_nb")).drop("_na", "_nb")
    right = b.join(wide, keys, "left").withColumn("_j", mine(b, "_nb")).withColumn("_i", every("_na")).drop("_na", "_nb")
    return left.join(right, [*keys, "_i", "_j"]).drop("_i", "_j")


def word_classes(records: DataFrame, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (all columns and ``h``) and classes (``h``, ``wset``, ``in_train``, ``in_eval``, ``size``); ``records`` has ``train`` boolean."""
    wset = F.array_sort(F.array_distinct(words(text)))
    rows = records.withColumn("wset", wset).filter(F.size("wset") > 0).withColumn("h", F.unhex(F.md5(F.array_join("wset", " "))))
    rows = scratch.cut(rows, "rows")
    classes = rows.groupBy("h").agg(F.first("wset").alias("wset"), F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval"), F.count(F.lit(1)).alias("size"))
    return rows.drop("wset"), scratch.cut(classes, "classes")


def matching_classes(classes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(``h_train``, ``h_eval``) of all classes whose similarity reaches ``threshold``, ``exact`` if the words are the same."""
    spark, t = classes.sparkSession, Fraction(str(threshold))
    same = classes.filter("in_train and in_eval").select(F.col("h").alias("h_train"), F.col("h").alias("h_eval"), F.lit(True).alias("exact"))
    counts = np.zeros(_SLOTS, np.int64)
    slots = classes.select(F.explode("wset").alias("w")).select(F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(_SLOTS)).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 2^18 rows
    counts[slots["slot"].to_numpy(int)] = slots["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    pre = scratch.cut(classes.select("h", "wset").mapInArrow(_prefixes(shared, t), "h binary, n int, token bigint, common boolean"), "prefixes")
    side = classes.select("h", "in_train", "in_eval")
    pre = pre.join(side, "h")
    train = pre.filter("in_train").select("token", "n", F.col("h").alias("h_train"), "common")
    least, most = F.ceil(F.col("n") * t.numerator / t.denominator - 1e-9), F.floor(F.col("n") * t.denominator / t.numerator + 1e-9)
    ev = pre.filter("in_eval").select("token", F.col("h").alias("h_eval"), "common", F.explode(F.sequence(least.cast("int"), most.cast("int"))).alias("n"))
    # only words that many classes have can be hot keys; a prefix holds the rarest, so these are few
    of = lambda d, common: d.filter(F.col("common") == common).drop("common")
    met = of(train, False).join(of(ev, False), ["token", "n"])
    if not pre.filter("common").isEmpty():
        met = met.unionByName(joined(of(train, True), of(ev, True), ["token", "n"]))
    cand = met.filter("h_train <> h_eval").select("h_train", "h_eval").distinct()
    a = classes.select(F.col("h").alias("h_train"), F.col("wset").alias("wa"))
    b = classes.select(F.col("h").alias("h_eval"), F.col("wset").alias("wb"))
    inter = F.size(F.array_intersect("wa", "wb"))
    union = F.size("wa") + F.size("wb") - inter
    near = cand.join(a, "h_train").join(b, "h_eval").filter(inter * t.denominator >= union * t.numerator)
    return scratch.cut(same.unionByName(near.select("h_train", "h_eval", F.lit(False).alias("exact"))), "matching")


def _sides(records: DataFrame, split: Column) -> DataFrame:
    s = F.lower(F.btrim(split, F.lit(" \t\r\n ")))
    return records.withColumn("split", s).filter(F.col("split").isin("train", "validation", "test")).withColumn("train", F.col("split") == "train")


def overlaps(records: DataFrame, record_id: str = "record_id", task: str = "task", text: str = "intent", split: str = "split_name", threshold: float = 0.7) -> DataFrame:
    """``record_a`` < ``record_b``: pairs of a training and an evaluation record of one task or of texts that match."""
    scratch = Scratch(records.sparkSession, "overlap")
    slim = records.select(F.col(record_id).alias("rid"), F.col(task).alias("task"), F.col(text).alias("text"), F.col(split).alias("split"))
    rows = scratch.cut(_sides(slim, F.col("split")).drop("split"), "slim")
    members, classes = word_classes(rows.select("rid", "text", "train"), "text", scratch)
    match = matching_classes(classes, threshold, scratch)
    tr = members.filter("train").select(F.col("rid").alias("a"), F.col("h").alias("h_train"))
    ev = members.filter("not train").select(F.col("rid").alias("b"), F.col("h").alias("h_eval"))
    plain = lambda a, b, keys: a.join(b, keys)
    meet = plain if classes.filter(F.col("size") > BLOCK).isEmpty() else joined
    by_text = meet(meet(match.select("h_train", "h_eval"), tr, ["h_train"]).select("a", "h_eval"), ev, ["h_eval"]).select("a", "b")
    known = rows.filter("task is not null")
    meet = plain if known.groupBy("task").count().filter(F.col("count") > BLOCK).isEmpty() else joined
    by_task = meet(known.filter("train").select("task", F.col("rid").alias("a")), known.filter("not train").select("task", F.col("rid").alias("b")), ["task"]).select("a", "b")
    return by_text.unionByName(by_task).select(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b")).distinct()


def class_overlaps(records: DataFrame, record_id: str = "record_id", text: str = "intent", split: str = "split_name", threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, membership): classes of equal words that match between training and evaluation, once per pair.

    Pairs have the smallest record of either class on its side, its number of records there and whether the words are the
    same; membership has ``record_id``, ``class_id`` (the smallest record of the class and side) and ``train``.
    """
    scratch = Scratch(records.sparkSession, "overlap")
    slim = records.select(F.col(record_id).alias("rid"), F.col(text).alias("text"), F.col(split).alias("split"))
    members, classes = word_classes(_sides(slim, F.col("split")).select("rid", "text", "train"), "text", scratch)
    sides = scratch.cut(members.groupBy("h", "train").agg(F.min("rid").alias("class_id"), F.count(F.lit(1)).alias("n")), "sides")
    of = lambda train, name: sides.filter(F.col("train") == train).select(F.col("h").alias(f"h_{name}"), F.col("class_id").alias(f"class_{name}"), F.col("n").alias(f"n_{name}"))
    match = matching_classes(classes, threshold, scratch)
    pairs = match.join(of(True, "train"), "h_train").join(of(False, "eval"), "h_eval").select("class_train", "class_eval", "n_train", "n_eval", "exact")
    membership = lookup(members.select("rid", "h", "train"), sides.select("h", "train", "class_id"), ["h", "train"]).select(F.col("rid").alias(record_id), "class_id", "train")
    return pairs, membership


def task_overlaps(records: DataFrame, task: str = "task", split: str = "split_name") -> DataFrame:
    """Tasks on both sides with their numbers of records in training and in evaluation."""
    sides = _sides(records.select(F.col(task).alias("task"), F.col(split).alias("split")), F.col("split")).filter("task is not null")
    per = sides.groupBy("task").agg(F.sum(F.col("train").cast("long")).alias("n_train"), F.sum((~F.col("train")).cast("long")).alias("n_eval"))
    return per.filter("n_train > 0 and n_eval > 0")


def report(records: DataFrame, record_id: str = "record_id", task: str = "task", text: str = "intent", split: str = "split_name", source: str = "source", threshold: float = 0.7) -> DataFrame:
    """Per evaluation split and source: rows, and those whose text a training row has exactly or almost, or whose task it has.

    Rows that are alike in split, source, class and task are counted once, by their number.
    """
    scratch = Scratch(records.sparkSession, "overlap")
    slim = records.select(F.col(record_id).alias("rid"), F.col(task).alias("task"), F.col(text).alias("text"), F.col(split).alias("split"), F.col(source).alias("source"))
    rows = scratch.cut(_sides(slim, F.col("split")), "slim")
    _, classes = word_classes(rows.select("rid", "text", "train"), "text", scratch)
    match = matching_classes(classes, threshold, scratch).groupBy(F.col("h_eval").alias("h")).agg(F.max("exact").alias("exact"), F.max(~F.col("exact")).alias("near"))
    wset = F.array_sort(F.array_distinct(words("text")))
    ev = rows.filter("not train").withColumn("h", F.when(F.size(wset) > 0, F.unhex(F.md5(F.array_join(wset, " ")))))
    ev = scratch.cut(ev.groupBy("split", "source", "h", "task").agg(F.count(F.lit(1)).alias("w")), "counted")
    tasks = task_overlaps(rows, split="split").select("task", F.lit(True).alias("has_task"))
    flags = lookup(lookup(ev, match, ["h"]), tasks, ["task"])
    n = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), F.col("w")).otherwise(0))
    anyway = F.coalesce("exact", F.lit(False)) | F.coalesce("near", F.lit(False)) | F.coalesce("has_task", F.lit(False))
    return flags.groupBy("split", "source").agg(F.sum("w").alias("n_rows"), n(F.col("exact")).alias("n_exact"), n(F.col("near")).alias("n_near"), n(F.col("has_task")).alias("n_same_task"), n(anyway).alias("n_any"))
