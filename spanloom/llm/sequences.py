"""Frequent subsequences across many sequences, gaps allowed, by bitmap sequence mining.

Positions of each name in each record are bit vectors (64 positions a word). A pattern's bitmap holds the positions at
which it can end; a step extends it by setting all bits after the first and intersecting with the next name's bitmap
(shift-and-intersect). Blocks of records are mined depth-first; records whose bitmap is nonzero show the pattern, and an
entity shows it if one of its records does.

Supports are global: patterns of length k+1 are counted in every block, for those candidates of which both parts of
length k are frequent, the counts are summed, and the frequent ones go back as the next level's prefixes. Only frequent
patterns reach the driver. There are at most m / min_share of them at a level, m being the mean number of distinct
subsequences an entity shows, so their number doesn't grow with the data.

Records of one entity are sorted together; an entity that a block border may cut, and one whose records are spread
because it has very many, is not counted in the block: the block emits (pattern, entity) pairs for it, which are
counted distinct. Equal sequences of one entity are collapsed first.

Defined results: entities null or blank don't count, neither for support nor as distinct entities. Steps without a name
are skipped. Null or empty arrays show nothing, but their entity counts as an entity. Sequences of any length are mined
whole. Empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

BLOCK_WORDS = 16_384
#: Distinct sequences from which an entity's records are spread over tasks.
HOT_ENTITY = 20_000
_COUNTS = "pattern array<int>, entity string, n bigint"
_ARROW = pa.schema([("pattern", pa.list_(pa.int32())), ("entity", pa.string()), ("n", pa.int64())])


class Block:
    """Bit vectors of a block of records, sorted by entity."""

    def __init__(self, entity: np.ndarray, loose: np.ndarray, flat: np.ndarray, offsets: np.ndarray, n_items: int):
        n = len(entity)
        length = np.diff(offsets)
        self.words = max(1, -(-int(length.max(initial=0)) // 64))
        new = np.r_[True, entity[1:] != entity[:-1]] if n else np.zeros(0, bool)
        self.task = np.cumsum(new) - 1
        self.names = entity[new]
        self.loose = np.zeros(len(self.names), bool)
        np.logical_or.at(self.loose, self.task, loose)
        if n:
            self.loose[[0, -1]] = True  # the block's border may cut them
        rec = np.repeat(np.arange(n), length)
        pos = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], length)
        self.bits = np.zeros((n_items, self.words, n), np.uint64)
        np.bitwise_or.at(self.bits, (flat, pos // 64, rec), np.uint64(1) << (pos % 64).astype(np.uint64))

    def after(self, x: np.ndarray) -> np.ndarray:
        """Bits after the first set bit of each record; x is words × records, no record being zero."""
        one = np.uint64(1)
        low = x & (~x + one)
        tail = ~(low | (low - one))
        if self.words == 1:
            return tail
        first = (x != 0).argmax(axis=0)
        at = np.arange(self.words)[:, None]
        return np.where(at > first, np.uint64(2**64 - 1), np.where(at == first, tail, np.uint64(0)))

    def count(self, tree: dict, out: list) -> None:
        """Supports of the extensions in ``tree``: {name: subtree or array of candidate names}."""
        stack = []
        for item, sub in tree.items():
            x = self.bits[item]
            recs = np.flatnonzero((x != 0).any(axis=0))
            if len(recs):
                stack.append(((item,), recs, x[:, recs], sub))
        while stack:
            prefix, recs, x, sub = stack.pop()
            after = self.after(x)
            if isinstance(sub, dict):
                for item, s in sub.items():
                    y = after & self.bits[item][:, recs]
                    hit = (y != 0).any(axis=0)
                    if hit.any():
                        stack.append(((*prefix, item), recs[hit], y[:, hit], s))
                continue
            tasks = self.task[recs]
            start = np.flatnonzero(np.r_[True, np.diff(tasks) != 0])
            loose = self.loose[tasks[start]]
            for part in np.array_split(sub, max(1, len(sub) * len(recs) * self.words // 4_000_000)):
                hit = ((after[None] & self.bits[part][:, :, recs]) != 0).any(axis=1)
                shown = np.logical_or.reduceat(hit, start, axis=1)
                n = shown[:, ~loose].sum(axis=1)
                for i in np.flatnonzero(n):
                    out.append(((*prefix, int(part[i])), None, int(n[i])))
                if loose.any():
                    names = self.names[tasks[start][loose]]
                    for i, j in zip(*np.nonzero(shown[:, loose])):
                        out.append(((*prefix, int(part[i])), names[j], 1))


def _level(tree: dict, n_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, widest = [], 0, 1

        def mine() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            seq = t.column("seq").chunk(0)
            out: list = []
            Block(t.column("entity").to_numpy(), t.column("loose").to_numpy(), seq.flatten().to_numpy(), seq.offsets.to_numpy(), n_items).count(tree, out)
            for i in range(0, len(out), 50_000):
                p, e, n = zip(*out[i : i + 50_000])
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip((p, e, n), _ARROW)], schema=_ARROW)

        for whole in batches:
            at = 0
            while at < whole.num_rows:
                rb = whole.slice(at, 2048)
                at += rb.num_rows
                widest = max(widest, -(-int(np.diff(rb.column("seq").offsets.to_numpy()).max(initial=0)) // 64))
                held.append(rb)
                size += rb.num_rows
                if size * widest >= BLOCK_WORDS:
                    yield from mine()
                    held, size, widest = [], 0, 1
        if size:
            yield from mine()

    return run


def _tree(prefixes: list[tuple], ext: dict[tuple, list[int]]) -> dict:
    """Prefixes as nested dictionaries, at whose ends stand the candidate names."""
    root: dict = {}
    for p in prefixes:
        cand = ext.get(p[1:], [])
        if not cand:
            continue
        at = root
        for x in p[:-1]:
            at = at.setdefault(x, {})
        at[p[-1]] = np.array(cand)
    return root


def frequent_sequences(records: DataFrame, entity: str, names: str, min_len: int = 3, max_len: int = 6, min_entities: int = 4, min_share: float = 0.01, hot_entity: int = HOT_ENTITY) -> DataFrame:
    """``pattern`` array<string> and ``n_entities`` of every frequent series; ``names`` is an array column in order."""
    spark = records.sparkSession
    scratch = Scratch(spark, "sequences")
    rows = records.select(F.nullif(F.btrim(F.col(entity).cast("string")), F.lit("")).alias("entity"), F.col(names).alias("names")).filter("entity is not null")
    rows = scratch.cut(rows.groupBy("entity", "names").agg(F.lit(1).alias("one")).drop("one"), "rows")
    n_entities = rows.select("entity").distinct().count()
    least = max(min_entities, math.ceil(min_share * n_entities - 1e-9))
    singles = rows.select("entity", F.explode("names").alias("name")).filter("name is not null").distinct().groupBy("name").count().filter(F.col("count") >= least)
    found = sorted((r["name"], r["count"]) for r in singles.collect())
    schema = "pattern array<string>, n_entities bigint"
    items = [x for x, _ in found]
    if not items:
        return spark.createDataFrame([], schema)
    coded = rows.select("entity", _encode(items)("names").alias("seq"))
    coded = scratch.cut(coded.filter(F.size("seq") >= min_len).distinct(), "encoded")
    hot = coded.groupBy("entity").count().filter(F.col("count") > hot_entity).select("entity", F.lit(True).alias("hot"))
    hot = scratch.cut(hot, "hot")
    n_hot = hot.count()
    if n_hot:
        coded = coded.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(64)))
        spread = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
        coded = coded.join(spread, ["entity", "salt"], "left").select("entity", "seq", F.coalesce("hot", F.lit(False)).alias("loose"), F.when(F.col("hot"), F.col("salt")).otherwise(F.lit(0)).alias("salt"))
    else:
        coded = coded.select("entity", "seq", F.lit(False).alias("loose"), F.lit(0).cast("long").alias("salt"))
    coded = scratch.cut(coded.repartition("entity", "salt").sortWithinPartitions("entity").drop("salt"), "coded")
    scratch.drop("rows", "encoded")

    levels = {1: {(i,): n for i, (_, n) in enumerate(found)}}
    for k in range(1, max_len):
        last = list(levels[k])
        ext: dict[tuple, list[int]] = {}
        if k == 1:
            ext[()] = list(range(len(items)))
        for p in last if k > 1 else ():
            ext.setdefault(p[:-1], []).append(p[-1])
        tree = _tree(last, ext)
        if not tree:
            break
        counts = coded.mapInArrow(_level(tree, len(items)), _COUNTS)
        # a written table, so that the blocks are mined once for both kinds of rows
        counts = scratch.cut(counts.groupBy("pattern", "entity").agg(F.sum("n").alias("n")), "counts")
        whole = counts.filter("entity is null").select("pattern", "n")
        loose = counts.filter("entity is not null").select("pattern", F.lit(1).cast("long").alias("n"))
        total = whole.unionByName(loose).groupBy("pattern").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        levels[k + 1] = {tuple(r["pattern"]): r["n"] for r in total.collect()}
        scratch.drop("counts")
        if not levels[k + 1]:
            break
    scratch.drop("coded", "hot")
    out = [([items[i] for i in p], n) for k, level in levels.items() if min_len <= k <= max_len for p, n in level.items()]
    return spark.createDataFrame(out, schema)


def _encode(items: list[str]):
    """Names as numbers; names that aren't frequent are left out."""
    code = {x: i for i, x in enumerate(items)}

    @F.pandas_udf("array<int>")
    def encode(col: pd.Series) -> pd.Series:
        return col.map(lambda a: [] if a is None else [c for c in map(code.get, a) if c is not None])

    return encode
