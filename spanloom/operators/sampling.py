"""Positives, negative sampling and group splits. Every random choice is a hash of seed and decision, so results don't
depend on partitioning or on retried tasks. Negatives are drawn as places in the sorted catalog, from which the excluded
tools' places are left out by arithmetic. A small catalog, whose size is checked, travels as one broadcast array and the
draw needs no shuffle; from a larger one the places are looked up by joins, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DatasetConfig
from ..joins import fits_broadcast, lookup
from ..storage import Scratch
from . import ranking


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, also where the body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(seed: str, decision: Column, what) -> Column:
    text = F.concat(F.lit(seed + ":"), decision, F.lit(":"), what if isinstance(what, Column) else F.lit(str(what)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _places(n_pool: Column, seed: str, decision: Column, n) -> Column:
    """Places of n tools in a pool of ``n_pool``, without replacement, or of all if there are fewer; each equally probable.

    The pool, turned by a random offset, is cut into n parts of equal size, and one place is drawn from each: n + 1 hashes
    a decision, whatever the pool's size.
    """
    m = n_pool.cast("bigint")
    k = F.least(n.cast("bigint") if isinstance(n, Column) else F.lit(n).cast("bigint"), m)
    off = _number(seed, decision, "off")
    edge = lambda j: (j * m / k).cast("bigint")
    at = lambda j: F.pmod(off + edge(j) + F.pmod(_number(seed, decision, j.cast("string")), edge(j + 1) - edge(j)), m)
    return F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), at)).otherwise(F.array().cast("array<bigint>"))


def _drawn(pool: Column, seed: str, decision: Column, n) -> Column:
    """The tools of an array at such places."""
    return F.transform(_places(F.size(pool), seed, decision, n), lambda p: F.get(pool, p.cast("int")))


def _around(places: Column, taken: Column) -> Column:
    """Places in the pool → places in the catalog, ``taken`` being the sorted places that the pool lacks."""
    return F.transform(places, lambda p: F.aggregate(taken, p, lambda at, t: F.when(t <= at, at + 1).otherwise(at)))


def random_negatives(decisions: DataFrame, catalog: DataFrame, key: str, exclude: str, n: int | Column = 3, seed: str = "neg", column: str = "negatives") -> DataFrame:
    """Adds n tools of the catalog without ``exclude``, or as many as there are.

    ``key`` tells decisions apart. Null and unknown tools in ``exclude`` exclude nothing; a null array is empty.
    """
    names = catalog.select("tool").filter("tool is not null").distinct()
    size = names.count()
    k, gone = F.col(key).cast("string"), F.array_distinct(F.coalesce(F.col(exclude), F.array().cast("array<string>")))
    if fits_broadcast(size, 128):
        d = decisions.crossJoin(F.broadcast(names.agg(F.array_sort(F.collect_list("tool")).alias("_names"))))  # one row
        d = d.withColumn("_taken", F.array_sort(F.filter(F.transform(gone, lambda t: F.array_position("_names", t) - 1), lambda p: p >= 0)))
        at = _around(_places(F.lit(size) - F.size("_taken"), seed, k, n), F.col("_taken"))
        return d.withColumn("_at", at).withColumn(column, F.transform("_at", lambda p: F.get("_names", p.cast("int")))).drop("_names", "_taken", "_at")
    scratch = Scratch(decisions.sparkSession, "negatives")
    placed = scratch.cut(ranking.prefix_sums(names.withColumn("one", F.lit(1)), "tool", "one", "place").select("tool", F.col("place").cast("bigint").alias("place")), "catalog")
    d = scratch.cut(decisions.withColumn("_row", F.monotonically_increasing_id()), "decisions")
    taken = lookup(d.select("_row", F.explode(gone).alias("tool")), placed, ["tool"]).groupBy("_row").agg(F.array_sort(F.collect_list("place")).alias("_taken"))
    d = d.join(taken, "_row", "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<bigint>")))
    d = scratch.cut(d.withColumn("_at", _around(_places(F.lit(size) - F.size("_taken"), seed, k, n), F.col("_taken"))), "drawn")
    drawn = lookup(d.select("_row", F.posexplode("_at").alias("j", "place")), placed, ["place"]).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("j", "tool"))).alias("_x"))
    out = d.join(drawn, "_row", "left").withColumn(column, F.coalesce(F.transform("_x", lambda x: x["tool"]), F.array().cast("array<string>")))
    return out.drop("_row", "_taken", "_at", "_x")


def _words() -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.nullif("description", F.lit("")), "tool")), r"\s+"), lambda w: w != ""))


def like_baskets(baskets: DataFrame, catalog: DataFrame, co_occurrence: DataFrame, few: int, most: int | None, scratch: Scratch) -> DataFrame:
    """For each distinct set of tools (``_b``, ``tools``): ``_co``, the first ``few`` tools used together with it, by use; ``_like``,
    those that are neither in the set nor used together with it, by shared words.

    Words in common are counted once per set; at most ``most`` tools are kept (None: all), those without a word in common
    last and by name. With a catalog that may be broadcast tools count by their place, and only those open to a set are
    looked at; with a larger one by their name, and an inverted index of the descriptions leads to those with a word in common.
    """
    names = scratch.cut(catalog.filter("tool is not null").groupBy("tool").agg(F.first(_words()).alias("words")), "words")
    n_names = names.count()
    small = fits_broadcast(n_names, 512)
    all_names = names.agg(F.array_sort(F.collect_list("tool")).alias("_names"))
    if small:
        coded = names.join(F.broadcast(all_names.select(F.posexplode("_names").alias("code", "tool"))), "tool")
    else:
        coded = names.withColumn("code", F.col("tool"))
    kind = "array<int>" if small else "array<string>"
    known = co_occurrence.join(coded.select(F.col("tool").alias("tool_b"), "code"), "tool_b")
    ranked = known.groupBy(F.col("tool_a").alias("tool")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("n_together", "code")))).alias("x")).select("tool", F.transform("x", lambda x: x["code"]).alias("co"))
    n_tools = baskets.agg(F.coalesce(F.sum(F.size("tools")), F.lit(0))).first()[0]
    each = lookup(lookup(baskets.select("_b", F.explode("tools").alias("tool")), coded, ["tool"], n_left=n_tools), ranked, ["tool"], n_left=n_tools)
    none, empty = F.array().cast("array<string>"), F.array().cast(kind)
    sets = each.groupBy("_b").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("words", none)))).alias("_words"), F.collect_list("code").alias("_own"), F.array_sort(F.collect_list(F.struct("tool", F.coalesce("co", empty).alias("co")))).alias("x"))
    sets = sets.select("_b", "_words", "_own", F.array_except(F.array_distinct(F.flatten(F.transform("x", lambda x: x["co"]))), "_own").alias("_co"))
    sets = baskets.select("_b").join(sets, "_b", "left").select("_b", F.coalesce("_words", none).alias("_words"), F.coalesce("_own", empty).alias("_own"), F.coalesce("_co", empty).alias("_co"))
    sets = scratch.cut(sets, "sets")
    best = Window.partitionBy("_b").orderBy(F.desc("n"), "tool")

    def first(score: DataFrame) -> DataFrame:
        top = score.withColumn("r", F.row_number().over(best))
        top = (top if most is None else top.filter(F.col("r") <= most)).groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("r", "tool"))).alias("x")).select("_b", F.transform("x", lambda x: x["tool"]).alias("_like"))
        return scratch.cut(sets.drop("_words").join(top, "_b", "left").withColumn("_like", F.coalesce("_like", none)), "liked")

    if small:
        every = F.sequence(F.lit(0), F.lit(n_names - 1)) if n_names else empty
        mine = sets.select("_b", "_words", F.explode(F.array_except(every, F.concat("_own", "_co"))).alias("code"))
        got = first(mine.join(F.broadcast(coded), "code").select("_b", "tool", F.size(F.array_intersect("words", "_words")).alias("n")))
        used = F.transform(F.slice("_co", 1, few), lambda p: F.get("_names", p))
        return got.crossJoin(F.broadcast(all_names)).select("_b", used.alias("_co"), "_like")
    index = names.select("tool", F.explode("words").alias("word")).groupBy("word").agg(F.collect_list("tool").alias("of"))
    n_words = sets.agg(F.coalesce(F.sum(F.size("_words")), F.lit(0))).first()[0]
    shared = lookup(sets.select("_b", F.explode("_words").alias("word")), index, ["word"], n_left=n_words).select("_b", F.explode("of").alias("tool"), F.lit(1).alias("n"))
    out = sets.select("_b", F.explode(F.concat("_own", "_co")).alias("tool"), F.lit(None).cast("int").alias("n"))  # these are out of the question
    score = shared.unionByName(out).groupBy("_b", "tool").agg(F.sum("n").alias("n"), F.max(F.col("n").isNull()).alias("out")).filter("not out")
    got = first(score)
    # where words don't suffice, the first names that are neither in the set nor found already
    lacks = F.lit(True) if most is None else F.size("_like") < most
    longest = got.filter(lacks).agg(F.max(F.size("_own") + F.size("_co") + F.size("_like"))).first()[0]
    done = got.select("_b", F.slice("_co", 1, few).alias("_co"), "_like")
    if longest is None:
        return done
    n_first = n_names if most is None else longest + most
    head = names.select("tool").orderBy("tool").limit(n_first).agg(F.array_sort(F.collect_list("tool")).alias("_first"))  # no longer than the longest row's own arrays
    more = F.array_except("_first", F.concat("_own", "_co", "_like"))
    like = F.concat("_like", more) if most is None else F.when(lacks, F.slice(F.concat("_like", more), 1, most)).otherwise(F.col("_like"))
    return got.crossJoin(F.broadcast(head)).select("_b", F.slice("_co", 1, few).alias("_co"), like.alias("_like"))


def hard_negatives(tasks: DataFrame, catalog: DataFrame, app_tools: DataFrame, co_occurrence: DataFrame, key: str = "record_id", n: int = 10, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), seed: str = "neg", column: str = "negatives") -> DataFrame:
    """Adds n tools like the positives in ``tools``: of the same app, used together with them, alike in description; then random.

    Quotas are max(1, int(n * weight)) for the first two and the rest for likeness. A rest below 0 keeps all but as many of
    the last. Tools ranked by use together count as seen by the likeness stage even beyond their quota. What depends on the
    set of tools alone is found once per distinct set.
    """
    a, c = max(1, int(n * weights[0])), max(1, int(n * weights[1]))
    s = n - a - c
    scratch, none = Scratch(tasks.sparkSession, "hard"), F.array().cast("array<string>")
    d = scratch.cut(tasks.withColumn("_b", F.md5(F.array_join("tools", "\u0001"))), "tasks")
    baskets = scratch.cut(d.groupBy("_b").agg(F.first("tools").alias("tools")), "baskets")
    liked = scratch.cut(like_baskets(baskets, catalog, co_occurrence, a + c, a + s if s >= 0 else None, scratch), "like")
    apps = app_tools.select("app", F.explode("tools").alias("tool")).join(catalog.select("tool").distinct(), "tool", "left_semi").groupBy("app").agg(F.array_sort(F.collect_list("tool")).alias("_app"))
    n_rows = d.count()
    d = lookup(lookup(d, liked, ["_b"], n_left=n_rows), apps, ["app"], n_left=n_rows)
    k = F.col(key).cast("string")
    d = d.withColumn("_same", _let(F.array_except(F.coalesce("_app", none), F.col("tools")), lambda pool: _drawn(pool, seed + ":app", k, a)))
    like = F.array_except("_like", "_same")
    like = F.slice(like, 1, F.lit(s) if s >= 0 else F.greatest(F.lit(0), F.size(like) + s))
    d = d.withColumn("_hard", F.concat("_same", F.slice(F.array_except("_co", "_same"), 1, c), like)).withColumn("_used", F.concat("tools", "_hard"))
    d = random_negatives(d.drop("_b", "_app", "_co", "_like", "_same"), catalog, key, "_used", F.greatest(F.lit(0), F.lit(n) - F.size("_hard")), seed + ":fill", "_fill")
    return d.withColumn(column, F.slice(F.concat("_hard", "_fill"), 1, n)).drop("_hard", "_used", "_fill")


def mixed_negatives(tasks: DataFrame, catalog: DataFrame, app_tools: DataFrame, co_occurrence: DataFrame, key: str = "record_id", n: int = 10, hard_ratio: float = 0.5, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), seed: str = "neg") -> DataFrame:
    """max(1, int(n * hard_ratio)) hard negatives and random ones for the rest."""
    h = min(n, max(1, int(n * hard_ratio)))
    d = hard_negatives(tasks, catalog, app_tools, co_occurrence, key, h, weights, seed, "_h").withColumn("_used", F.concat("tools", "_h"))
    return random_negatives(d, catalog, key, "_used", n - h, seed + ":mix").withColumn("negatives", F.concat("_h", "negatives")).drop("_h", "_used")


Sampler = Callable[..., DataFrame]
#: Samplers by name; each takes (tasks, catalog, app_tools, co_occurrence, key, n, config) and adds ``negatives``.
SAMPLERS: dict[str, Sampler] = {
    "random": lambda t, cat, apps, co, key, n, c: random_negatives(t, cat, key, "tools", n, c.seed),
    "hard": lambda t, cat, apps, co, key, n, c: hard_negatives(t, cat, apps, co, key, n, tuple(c.weights), c.seed),
    "mixed": lambda t, cat, apps, co, key, n, c: mixed_negatives(t, cat, apps, co, key, n, c.hard_ratio, tuple(c.weights), c.seed),
}


def negatives(tasks: DataFrame, catalog: DataFrame, app_tools: DataFrame, co_occurrence: DataFrame, n: int, config: DatasetConfig = DatasetConfig(), key: str = "record_id") -> DataFrame:
    """Adds ``negatives`` by the sampler that the settings name; samplers of one's own are added to ``SAMPLERS``."""
    name = config.sampler.lower().strip()
    if name not in SAMPLERS:
        raise ValueError(f"no such sampler: {config.sampler!r}; there are {sorted(SAMPLERS)}")
    return SAMPLERS[name](tasks, catalog, app_tools, co_occurrence, key, n, config)


def pointwise(rows: DataFrame, positives: str, keep: list[str]) -> DataFrame:
    """One row per candidate: the tools in ``positives`` with label 1, those in ``negatives`` with label 0."""
    both = F.concat(F.transform(positives, lambda t: F.struct(t.alias("tool_name"), F.lit(1).alias("label"))), F.transform("negatives", lambda t: F.struct(t.alias("tool_name"), F.lit(0).alias("label"))))
    return rows.select(*keep, F.explode(both).alias("c")).select(*keep, "c.tool_name", "c.label")


def _first_groups(rows: DataFrame, group: str, wanted: Callable[[int], int], seed: str) -> DataFrame:
    """(group, ``first``): whether a group is among the first ``wanted(groups)`` in hash order.

    The cut is found on a histogram of 2^16 hash ranges, then exactly within one range: no global sort in one task.
    """
    g = rows.select(group).filter(F.col(group).isNotNull()).distinct().withColumn("h", F.md5(F.concat(F.lit(seed + ":"), F.col(group).cast("string"))))
    g = g.withColumn("b", F.conv(F.substring("h", 1, 4), 16, 10).cast("int"))
    hist = g.groupBy("b").count().orderBy("b").collect()  # at most 2^16 rows
    n, seen, cut = wanted(sum(r["count"] for r in hist)), 0, -1
    for r in hist:
        if seen + r["count"] > n:
            cut = r["b"]
            break
        seen += r["count"]
    rank = F.row_number().over(Window.orderBy("h", group))
    edge = g.filter(F.col("b") == cut).withColumn("first", rank <= n - seen)
    rest = g.filter(F.col("b") != cut).withColumn("first", F.lit(cut < 0) | (F.col("b") < cut))
    return edge.unionByName(rest).select(group, "first")


def group_split(rows: DataFrame, group: str, test_share: float = 0.2, seed: str = "split") -> DataFrame:
    """(group, part): ceil(share * groups) groups in hash order go to 'test', the others to 'train'."""
    cut = _first_groups(rows, group, lambda n: -(-n * round(test_share * 10**6) // 10**6), seed)
    return cut.select(group, F.when(F.col("first"), "test").otherwise("train").alias("part"))


def random_groups(rows: DataFrame, group: str, n: int, seed: str = "subset") -> DataFrame:
    """n groups, each equally probable, or all if there are fewer."""
    return _first_groups(rows, group, lambda _: n, seed).filter("first").select(group)


def group_kfold(rows: DataFrame, group: str, n_splits: int = 5, big_share: float = 0.001, seed: str = "fold") -> DataFrame:
    """(group, fold): balanced folds of whole groups.

    Groups above ``big_share`` of all rows, at most 1 / big_share of them, go one by one, largest first, to the lightest
    fold; the many small ones follow by hash into ranges that fill up what each fold lacks.
    """
    sizes = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    big = sizes.filter(F.col("n") > big_share * total).collect()
    load, fixed = [0] * n_splits, []
    for r in sorted(big, key=lambda r: (-r["n"], str(r[group]))):
        f = load.index(min(load))
        load[f] += r["n"]
        fixed.append((r[group], f))
    lack = [max(0.0, total / n_splits - x) for x in load]
    whole, upto, fold = sum(lack) or 1.0, 0.0, None
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(group).cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    for f in range(n_splits - 1):
        upto += lack[f] / whole
        fold = (F if fold is None else fold).when(u < upto, f)
    fold = F.lit(0) if fold is None else fold.otherwise(n_splits - 1)
    if not fixed:
        return sizes.select(group, fold.cast("int").alias("fold"))
    table = rows.sparkSession.createDataFrame(fixed, sizes.select(group).schema.add("_f", "integer"))
    return sizes.join(F.broadcast(table), group, "left").select(group, F.coalesce("_f", fold).cast("int").alias("fold"))
