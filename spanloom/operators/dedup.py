"""Messages delivered more than once: exactly one copy of each is kept.

A Bloom filter per time bucket of arrival screens out the identifiers that are certainly new; only possible repeats
are compared exactly, and only with what the buckets that know them hold.

1. *Buckets.* Days of arrival are joined to at most ``MAX_BUCKETS`` time buckets of about equal numbers of rows, so a row
   is tested against as many filters, and false positives add up over as many, whether the data span a week or years.
   Each bucket's filter is sized by its own rows.
2. *Unit pass* (``mapInArrow``, no shuffle). A unit is a run of up to ``UNIT_ROWS`` rows of one input partition. Copies
   inside a unit are settled there on their whole keys, so a key that holds a third of all rows leaves at most one
   representative per unit. For each time bucket the unit emits its part of that bucket's filter, and the
   representatives.
3. *Filters.* A filter is divided into shards by hash; in its shard a key has 4 bits in one word of 64. The units' parts
   are merged into ``once`` (bits that any unit set) and ``twice`` (bits that two or more units set), so that a row's own
   bits are no evidence. Parts travel in sparse form where that is smaller.
4. *Screen.* Representatives meet the filters of their shard, broadcast if their size, which is known, allows it. A
   bucket knows a row if, in its own bucket, ``twice`` or, in another, ``once`` has all four bits. No false negatives.
5. *Exact check.* Representatives that no bucket knows are new. The others are stored by time bucket with the first
   delivery of each key there; a row is looked up, by its whole key, in its own bucket and in the earlier ones that know
   it, and is surplus if one of these holds an earlier delivery.

Defined results: rows without one of the ids are never surplus. Null arrival times count as the latest, null delivery
ids as the smallest. Of rows equal in key, time and delivery id one is kept and the others are surplus. Empty input
gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_id
from ..joins import fits_broadcast
from ..storage import Scratch

UNIT_ROWS = 1_000_000
MAX_BUCKETS = 16
BITS_PER_KEY = 24
#: Words that a filter has in one shard, at most.
WORDS = 64
_LAST = 2**63 - 1
_FIRST = -(2**63)
_NEVER = 2**40

_UNIT = "kind tinyint, bucket int, shard int, word int, mask bigint, k binary, recv bigint, did bigint, words array<bigint>"
_UNIT_ARROW = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("shard", pa.int32()), ("word", pa.int32()), ("mask", pa.int64()), ("k", pa.binary()), ("recv", pa.int64()), ("did", pa.int64()), ("words", pa.list_(pa.int64()))])
SURPLUS, REP, BITS = 0, 1, 2


def _key(columns: list[tuple[str, int]]) -> Column:
    """The ids' bytes; for ids in no known notation a digest as long."""
    n = sum(b for _, b in columns)
    ids = [canonical_id(c, b) for c, b in columns]
    text = F.concat(*ids)  # null if any is null
    plain = F.lit(True)
    for i, (_, b) in zip(ids, columns):
        plain = plain & i.rlike(f"^[0-9a-f]{{{2 * b}}}$")
    digest = F.substring(F.concat(F.sha2(F.concat_ws("\u0001", *ids), 256), F.sha2(F.concat_ws("\u0002", *ids), 256)), 1, 2 * n)
    return F.when(text.isNotNull(), F.unhex(F.when(plain, text).otherwise(digest)))


def _fixed(col: pa.Array, n: int) -> np.ndarray:
    """A binary column of fixed length as rows of bytes."""
    col = col.cast(pa.binary())
    buf, at = col.buffers()[2], np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
    return np.frombuffer(buf, np.uint8)[at[0] : at[-1]].reshape(-1, n)


def time_buckets(per_day: list[tuple[int, int]], most: int = MAX_BUCKETS) -> list[tuple[int, int]]:
    """(first day, rows) of each bucket: consecutive days joined until a bucket has its part of the rows."""
    whole, out = sum(n for _, n in per_day), []
    seen = 0
    for day, n in sorted(per_day):
        if not out or seen >= whole * len(out) / most:
            out.append((day, 0))
        out[-1] = (out[-1][0], out[-1][1] + n)
        seen += n
    return out


def _units(n_shards: int, n_words: list[int], n_key: int):
    """``n_words`` are the words of each bucket's filter in one shard."""
    pad = -n_key % 8

    def emit(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        n = t.num_rows
        if not n:
            return
        col = {c: t.column(c).chunk(0) for c in t.column_names}
        k = _fixed(col["k"], n_key)
        words = np.ascontiguousarray(np.pad(k, ((0, 0), (0, pad)))).view(np.uint64)
        h, recv, did, bucket = (col[c].to_numpy(zero_copy_only=False) for c in ("h", "recv", "did", "bucket"))
        order = np.lexsort((did, recv, *words.T))
        w = words[order]
        first = np.ones(n, bool)
        first[1:] = (w[1:] != w[:-1]).any(axis=1)
        rep, surplus = order[first], order[~first]
        hu = h[rep].view(np.uint64)
        b = bucket[rep].astype(np.int32)
        block = ((hu >> np.uint64(34)) % np.uint64(n_shards)).astype(np.int32)
        place = ((hu >> np.uint64(24)) & np.uint64(1023)).astype(np.int32)
        word = place % np.array(n_words, np.int32)[b]
        mask = np.zeros(len(rep), np.uint64)
        for i in range(4):
            mask |= np.uint64(1) << ((hu >> np.uint64(6 * i)) & np.uint64(63))

        def batch(kind: int, m: int, **cols) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(m, kind, np.int8)) if f.name == "kind" else cols[f.name] if f.name in cols else pa.nulls(m, f.type) for f in _UNIT_ARROW], schema=_UNIT_ARROW)

        if len(surplus):
            yield batch(SURPLUS, len(surplus), did=pa.array(did[surplus]))
        yield batch(REP, len(rep), bucket=pa.array(b), shard=pa.array(block), word=pa.array(place), mask=pa.array(mask.view(np.int64)), k=col["k"].cast(pa.binary()).take(pa.array(rep)), recv=pa.array(recv[rep]), did=pa.array(did[rep]))
        # this unit's words, one row each; shards that are well filled go out whole
        o = np.lexsort((word, block, b))
        at = np.flatnonzero(np.r_[True, (np.diff(b[o]) != 0) | (np.diff(block[o]) != 0) | (np.diff(word[o]) != 0)])
        m = np.bitwise_or.reduceat(mask[o], at).view(np.int64)
        wb, wk, ww = b[o][at], block[o][at], word[o][at]
        start = np.flatnonzero(np.r_[True, (np.diff(wb) != 0) | (np.diff(wk) != 0)])
        size = np.diff(np.r_[start, len(wb)])
        whole = size >= np.maximum(8, np.array(n_words)[wb[start]] // 2)
        thin = np.repeat(~whole, size)
        if thin.any():
            yield batch(BITS, int(thin.sum()), bucket=pa.array(wb[thin]), shard=pa.array(wk[thin]), word=pa.array(ww[thin]), mask=pa.array(m[thin]))
        if whole.any():
            full = np.zeros((int(whole.sum()), WORDS), np.int64)
            full[np.repeat(np.cumsum(whole) - 1, size)[~thin], ww[~thin]] = m[~thin]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, full.size + 1, WORDS, dtype=np.int32)), pa.array(full.ravel()))
            yield batch(BITS, len(full), bucket=pa.array(wb[start][whole]), shard=pa.array(wk[start][whole]), words=lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rb in batches:
            held.append(rb)
            n += rb.num_rows
            if n >= UNIT_ROWS:
                yield from emit(held)
                held, n = [], 0
        if held:
            yield from emit(held)

    return run


_FILTER = "bucket int, shard int, once array<bigint>, twice array<bigint>"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by bucket and shard → filters; state is one shard of one bucket."""
    cur, once, twice, out = None, None, None, []

    def flush() -> pa.RecordBatch:
        cols = [pa.array([o[i] for o in out], pa.int32()) for i in (0, 1)] + [pa.array([o[i].view(np.int64) for o in out], pa.list_(pa.int64())) for i in (2, 3)]
        return pa.record_batch(cols, names=["bucket", "shard", "once", "twice"])

    for rb in batches:
        b, k = (rb.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "shard"))
        word, mask = (rb.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("word", "mask"))
        lists = rb.column("words")
        whole = lists.is_valid().to_numpy(zero_copy_only=False)
        flat, nth = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS).view(np.uint64), np.cumsum(whole) - 1
        mask = mask.view(np.uint64)
        at = np.flatnonzero(np.r_[True, (np.diff(b) != 0) | (np.diff(k) != 0)]) if len(b) else []
        for s, e in zip(at, [*at[1:], len(b)]):
            key = (int(b[s]), int(k[s]))
            if key != cur:
                if cur is not None:
                    out.append((*cur, once, twice))
                cur, once, twice = key, np.zeros(WORDS, np.uint64), np.zeros(WORDS, np.uint64)
            thin = ~whole[s:e]
            if thin.any():
                # words of several units: those of equal rank touch each word once
                tw, tm = word[s:e][thin], mask[s:e][thin]
                o = np.argsort(tw, kind="stable")
                tw, tm = tw[o], tm[o]
                new = np.r_[True, np.diff(tw) != 0]
                rank = np.arange(len(tw)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                for r in range(rank.max() + 1):
                    w, m = tw[rank == r], tm[rank == r]
                    twice[w] |= once[w] & m
                    once[w] |= m
            for i in np.flatnonzero(whole[s:e]):
                x = flat[nth[s + i]]
                twice |= once & x
                once |= x
        if len(out) >= 2000:
            yield flush()
            out = []
    if cur is not None:
        out.append((*cur, once, twice))
    if out:
        yield flush()


def screen(df: DataFrame, ids: list[tuple[str, int]], received: str, delivery: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(units' rows, representatives that some bucket knows: ``bucket``, ``k``, ``recv``, ``did``, ``named``)."""
    n_key = sum(b for _, b in ids)
    micros = F.unix_micros(F.col(received).cast("timestamp"))
    day = F.coalesce(F.floor(micros / F.lit(86_400_000_000)), F.lit(_NEVER))
    slim = df.select(_key(ids).alias("k"), F.coalesce(micros, F.lit(_LAST)).alias("recv"), F.coalesce(F.col(delivery).cast("long"), F.lit(_FIRST)).alias("did"), day.alias("day"))
    per_day = [(r["day"], r["count"]) for r in df.select(day.alias("day")).groupBy("day").count().collect()]  # one row per day
    buckets = time_buckets(per_day) or [(0, 0)]
    most = max(n for _, n in buckets)
    n_shards = max(1, -(-most * BITS_PER_KEY // (64 * WORDS)))
    n_words = [max(1, min(WORDS, -(-n * BITS_PER_KEY // (64 * n_shards)))) for _, n in buckets]
    bucket = sum(((F.col("day") >= F.lit(d)).cast("int") for d, _ in buckets[1:]), F.lit(0))
    keyed = slim.filter(F.col("k").isNotNull()).select("k", "recv", "did", bucket.alias("bucket"), F.xxhash64("k").alias("h"))
    units = scratch.cut(keyed.mapInArrow(_units(n_shards, n_words, n_key), _UNIT), "units", ["kind"])
    bits = units.filter(F.col("kind") == BITS).select("bucket", "shard", "word", "mask", "words")
    filters = bits.repartition("bucket", "shard").sortWithinPartitions("bucket", "shard").mapInArrow(_merge, _FILTER)
    by_shard = filters.groupBy("shard").agg(F.collect_list(F.struct("bucket", "once", "twice")).alias("fs"))  # at most MAX_BUCKETS, of 64 words twice
    if fits_broadcast(n_shards, 16 * WORDS * len(buckets)):
        by_shard = F.broadcast(scratch.cut(by_shard, "filters"))
    reps = units.filter(F.col("kind") == REP).select("bucket", "shard", "word", "mask", "k", "recv", "did")
    sizes = F.array(*map(F.lit, n_words))

    def knows(f: Column) -> Column:
        at = F.pmod(F.col("word"), F.get(sizes, f["bucket"]))
        bits_of = F.when(f["bucket"] == F.col("bucket"), F.get(f["twice"], at)).otherwise(F.get(f["once"], at))
        return bits_of.bitwiseAND(F.col("mask")) == F.col("mask")

    named = F.transform(F.filter("fs", knows), lambda f: f["bucket"])
    return units, reps.join(by_shard, "shard").select("bucket", "k", "recv", "did", named.alias("named")).filter(F.size("named") > 0)


def surplus_deliveries(df: DataFrame, ids: list[tuple[str, int]] | None = None, received: str = "received_at", delivery: str = "delivery_id") -> DataFrame:
    """Delivery ids of all rows but the first delivered of each key; ``ids`` are columns with their lengths in bytes."""
    scratch = Scratch(df.sparkSession, "dedup")
    units, known = screen(df, ids or [("trace_id", 16), ("span_id", 8)], received, delivery, scratch)
    stored = known.groupBy("bucket", "k", "recv", "did").agg(F.count(F.lit(1)).alias("m"), F.first("named").alias("named"))
    stored = scratch.cut(stored, "stored")
    first = stored.groupBy("bucket", "k").agg(F.min(F.struct("recv", "did")).alias("first")).withColumnRenamed("bucket", "b")
    earlier = F.filter("named", lambda b: b < F.col("bucket"))
    asked = stored.select("bucket", "k", "recv", "did", "m", F.explode(F.array_append(earlier, F.col("bucket"))).alias("b"))
    found = asked.join(first, ["b", "k"]).groupBy("k", "recv", "did").agg(F.first("m").alias("m"), F.min("first").alias("first"))
    kept = (F.col("first") == F.struct("recv", "did")).cast("int")
    across = found.withColumn("m", (F.col("m") - kept).cast("int")).filter("m > 0").select(F.explode(F.array_repeat("did", F.col("m"))).alias("did"))
    within = units.filter(F.col("kind") == SURPLUS).select("did")
    return across.unionByName(within).select(F.when(F.col("did") != _FIRST, F.col("did")).alias(delivery))


def first_deliveries(df: DataFrame, delivery: str = "delivery_id", **kw) -> DataFrame:
    """``df`` without its surplus rows; ``delivery`` must be unique. Rows lacking an id stay."""
    gone = surplus_deliveries(df, delivery=delivery, **kw).filter(F.col(delivery).isNotNull())
    return df.join(gone, delivery, "left_anti")
