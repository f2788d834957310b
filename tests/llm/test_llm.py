"""Operators for training data against brute force on small fixtures."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from spanloom.llm import components, cooccurrence, mixing, mojibake, overlap, packing, sequences, tokens


def subsequences(seq, lo, hi):
    return {tuple(seq[i] for i in c) for n in range(lo, hi + 1) for c in itertools.combinations(range(len(seq)), n)}


@pytest.mark.parametrize("hot,words", [(20_000, 16_384), (3, 8)])
def test_sequences_brute_force(spark, monkeypatch, hot, words):
    rng = random.Random(1)
    rows = [(f"e{min(rng.randrange(40), 25)}", [rng.choice("abcdef") for _ in range(rng.randrange(9))]) for _ in range(150)]
    rows += [(None, ["a", "b", "c"]), (" ", ["a", "b", "c"]), ("e1", None), ("e99", []), ("e3", ["a", None, "b", "c"])]
    monkeypatch.setattr(sequences, "BLOCK_WORDS", words)
    got = {tuple(r.pattern): r.n_entities for r in sequences.frequent_sequences(spark.createDataFrame(rows, "e string, s array<string>"), "e", "s", 3, 5, 4, 0.3, hot_entity=hot).collect()}
    shown: dict = {}
    entities = {e for e, _ in rows if e and e.strip()}
    for e, s in rows:
        if e and e.strip():
            for p in subsequences([x for x in s or [] if x], 3, 5):
                shown.setdefault(p, set()).add(e)
    least = max(4, math.ceil(0.3 * len(entities)))
    assert got == {p: len(es) for p, es in shown.items() if len(es) >= least} and got


def test_sequences_long_records(spark):
    seq = ["x"] * 70 + ["a"] + ["x"] * 70 + ["b"] + ["x"] * 5 + ["c"]
    rows = [(f"e{i}", seq) for i in range(4)] + [("e9", ["c", "b", "a"])]
    got = {tuple(r.pattern) for r in sequences.frequent_sequences(spark.createDataFrame(rows, "e string, s array<string>"), "e", "s", 3, 3).collect()}
    assert ("a", "b", "c") in got and ("x", "x", "x") in got and ("c", "b", "a") not in got
    assert sequences.frequent_sequences(spark.createDataFrame([], "e string, s array<string>"), "e", "s").count() == 0


def test_pairs(spark):
    rows = [(["a", "b", "a", None],), (["b", "a"],), (["a"],), ([],), (None,), (["c", "b"],)]
    df = spark.createDataFrame(rows, "items array<string>")
    got = {(r.item_a, r.item_b): (r.n, r.n_a, r.n_b, r.n_ab, r.lift) for r in cooccurrence.pairs(df, "items").collect()}
    assert got == {("a", "b"): (4, 3, 3, 2, 2 * 4 / 9), ("b", "c"): (4, 3, 1, 1, 4 / 3)}
    assert {(r.item_a, r.item_b) for r in cooccurrence.pairs(df, "items", min_count=2).collect()} == {("a", "b")}
    assert cooccurrence.pairs(df.limit(0), "items").count() == 0


@pytest.mark.parametrize("hot", [200_000, 3])
def test_components(spark, hot):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, f"t{rng.randrange(60)}"]), rng.choice([None, "a0", f"a{rng.randrange(30)}"])) for i in range(120)] + [(500 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(60)]
    got = {r.rid: r for r in components.record_groups(spark.createDataFrame(rows, "rid long, task string, app string"), "rid", ["task", "app"], hot_rows=hot).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, t, a in rows:
        for e in (("t", t), ("a", a)):
            if e[1]:
                up[find(("r", i))] = find(e)
    groups: dict = {}
    for i, t, a in rows:
        groups.setdefault(find(("r", i)), []).append((i, t, a))
    for g in groups.values():
        for i, _, _ in g:
            assert got[i].group_id == min(x[0] for x in g) and got[i].n_records == len(g)
            assert got[i].n_app == len({a for _, _, a in g if a}) and got[i].n_task == len({t for _, t, _ in g if t})


def test_splits_keep_groups_and_shares(spark):
    rows = [(i, i if i >= 300 else 0, 300 if i < 300 else 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "rid long, group_id long, n_records long")
    out = components.assign_splits(df, [("test", 0.1), ("train", 0.8), ("validation", 0.1)]).toPandas()
    assert len(out) == 3000 and out.groupby("group_id")["split"].nunique().max() == 1
    share = out["split"].value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02


def bag(text):
    return set(re.findall(r"[^\W_]+", (text or "").lower()))


def test_overlaps_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(160):
        base = [rng.choice(vocab) for _ in range(rng.randrange(1, 9))] if i < 60 or rng.random() < 0.3 else list(rows[rng.randrange(50)][2].split())
        if rng.random() < 0.5:
            base[rng.randrange(len(base))] = rng.choice(vocab)
        rows.append((i, rng.choice([None, f"t{rng.randrange(50)}"]), rng.choice([" ", ", ", "  "]).join(base).upper() if i % 5 == 0 else " ".join(base), rng.choice(["train", "Train ", "TEST", "validation", None]), "s"))
    rows += [(900, None, None, "train", "s"), (901, None, "", "test", "s"), (902, None, "?!", "train", "s"), (903, None, "?!", "test", "s"), (904, None, "a " * 5000, "train", "s"), (905, None, "A!", "test", "s")]
    df = spark.createDataFrame(rows, "record_id long, task string, intent string, split_name string, source string")
    want = set()
    side = lambda s: None if not s else "train" if s.strip().lower() == "train" else "eval"
    for x, y in itertools.combinations(rows, 2):
        if {side(x[3]), side(y[3])} == {"train", "eval"}:
            a, b = bag(x[2]), bag(y[2])
            if (x[1] and x[1] == y[1]) or (a and b and 10 * len(a & b) >= 7 * len(a | b)):
                want.add((x[0], y[0]))
    assert {tuple(r) for r in overlap.overlaps(df).collect()} == want
    rep = overlap.report(df).toPandas()
    assert rep["n_any"].sum() == len({b if side(dict((r[0], r[3]) for r in rows)[b]) == "eval" else a for a, b in want})


def test_hot_keys_of_a_join_are_split(spark):
    a = spark.createDataFrame([(1, i) for i in range(60)] + [(2, i) for i in range(5)] + [(3, 1), (None, 1)], "k int, a int")
    b = spark.createDataFrame([(1, i) for i in range(37)] + [(2, i) for i in range(50)] + [(4, 1), (None, 2)], "k int, b int")
    for block in (8, 1000):
        got = sorted(tuple(r) for r in overlap.joined(a, b, ["k"], block).collect())
        assert got == sorted((1, x, y) for x in range(60) for y in range(37)) + sorted((2, x, y) for x in range(5) for y in range(50))


def test_classes_and_members_stand_for_all_pairs(spark):
    texts = ["Find the order now", "find, the order NOW!", "find the order", "other thing here", None, " ", "now order the find"]
    rows = [(i, f"t{i % 3}" if i % 4 else None, texts[i % 7], ("train", "test", "Validation ", None)[i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, task string, intent string, split_name string")
    pairs, members = overlap.class_overlaps(df)
    m = members.toPandas()
    inside = {True: {}, False: {}}
    for r in m.itertuples():
        inside[r.train].setdefault(r.class_id, []).append(r.record_id)
    out = set()
    for r in pairs.collect():
        assert r.n_train == len(inside[True][r.class_train]) and r.n_eval == len(inside[False][r.class_eval]) and r.class_train == min(inside[True][r.class_train])
        out |= {(min(x, y), max(x, y)) for x in inside[True][r.class_train] for y in inside[False][r.class_eval]}
    tasks = {r.task: (r.n_train, r.n_eval) for r in overlap.task_overlaps(df).collect()}
    side = lambda s: None if not s else "train" if s.strip().lower() == "train" else "eval"
    assert tasks == {t: n for t in ("t0", "t1", "t2") if all(n := tuple(sum(r[1] == t and side(r[3]) == s for r in rows) for s in ("train", "eval")))}
    by_task = {(min(x[0], y[0]), max(x[0], y[0])) for x in rows for y in rows if x[1] and x[1] == y[1] and side(x[3]) == "train" and side(y[3]) == "eval"}
    assert {tuple(r) for r in overlap.overlaps(df).collect()} == out | by_task


LIMITS = {"s": (100, 12, 60), "l": (250, 50, 250)}


def test_packing_covers_and_fits(spark):
    rng = random.Random(5)
    rows = [(i, t := rng.choice([0, 3, 17, 40, 90, 260, rng.randrange(1, 120)]), rng.choice([0, t // 2, t])) for i in range(2500)] + [(None, 5, None), (7, 20, 20), (8, None, 1), (9, 30, 99), (10, 30, -4)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, n_loss int")
    got = packing.pack_items(df, LIMITS, shard_items=400).toPandas()
    want_loss = sum(min(max(l or 0, 0), t) for _, t, l in rows if t)
    for kind, (cap, seg, loss) in LIMITS.items():
        g = got[got["kind"] == kind]
        size = g["to_token"] - g["from_token"]
        assert size.sum() == sum(t for _, t, _ in rows if t) and g["loss"].sum() == want_loss
        per = g.assign(size=size).groupby("container").agg({"size": "sum", "doc_id": "size", "loss": "sum"})
        shared = per[per["doc_id"] > 1]
        assert per["size"].max() <= cap and shared["doc_id"].max() <= seg and shared["loss"].max() <= loss
        assert ((shared["loss"] == loss) | (shared["doc_id"] == seg)).any()  # limits that bind
        assert 0 <= g["loss"].min() and (g["loss"] <= size).all()
        divided = g.groupby("doc_id").size()
        assert all(divided.get(i, 0) == -(-t // cap) for i, t, _ in rows[:2500] if t and i not in (7, 8, 9, 10))
    assert packing.pack_items(df.limit(0), {"s": (10, 5, 10)}).count() == 0
    assert packing.pack_items(df.filter("doc_id is null"), LIMITS).count() == 2  # fewer items than kinds are placed too
    faults = packing.check(packing.pack_items(df.filter("doc_id > 10"), LIMITS), LIMITS).collect()
    assert all(r.over_tokens + r.over_segments + r.over_loss + r.gaps + r.divided_small == 0 for r in faults)


def test_loss_of_pieces_is_exact_and_never_clipped(spark):
    df = spark.createDataFrame([(1, 50, 50, []), (2, 30, 30, []), (3, 250, 200, [(0, 20), (90, 120)]), (4, 20, 8, [(0, 12)])], "doc_id long, n_tokens int, n_loss int, prompts array<struct<from:int,to:int>>")
    got = packing.pack_items(df, {"k": (100, 10, 20)}, prompts="prompts").toPandas()
    loss = {(r.doc_id, r.piece): r.loss for r in got.itertuples()}
    assert loss == {(1, 0): 50, (2, 0): 30, (3, 0): 70, (3, 1): 80, (3, 2): 50, (4, 0): 8}
    assert got.groupby("container")["loss"].sum().max() == 80 and len(set(got["container"])) == 6


def test_items_that_fill_badly_stay_in_their_shards(spark, monkeypatch):
    """Items of 0.55 of the capacity never fill a container: one round, and no task with more than its share."""
    seen = []
    monkeypatch.setattr(packing, "_round", lambda limits, n, real=packing._round: seen.append(n) or real(limits, n))
    df = spark.createDataFrame([(i, 55, 0) for i in range(3000)] + [(9, 55, 0)] * 700, "doc_id long, n_tokens int, n_loss int")
    got = packing.pack_items(df, {"k": (100, 10, 100)}, shard_items=400).toPandas()
    assert seen == [0] and len(got) == 3700 == len(set(got["container"]))
    shard = got["container"].str.split("-").str[1]
    assert shard.nunique() >= 10 and shard.value_counts().max() <= 400


def test_dot_products_against_first_fit_decreasing():
    rng = np.random.default_rng(3)
    t = rng.integers(1, 100, 1500)
    loss = (t * rng.choice([0.3, 1.0], 1500)).astype(int)
    box = packing.pack(t, loss, (128, 6, 110))
    used = [(np.bincount(box, weights=x)) for x in (t, np.ones(1500), loss)]
    assert all(u.max() <= c for u, c in zip(used, (128, 6, 110)))
    free: list = []
    for i in np.argsort(-t, kind="stable"):
        j = next((j for j, f in enumerate(free) if f[0] >= t[i] and f[1] >= 1 and f[2] >= loss[i]), None)
        if j is None:
            free.append([128, 6, 110])
            j = len(free) - 1
        free[j] = [free[j][0] - t[i], free[j][1] - 1, free[j][2] - loss[i]]
    assert box.max() + 1 <= len(free) * 1.02


def test_mixing_shares_and_caps(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("aaaaabbc"), rng.randrange(1, 50)) for i in range(6000)] + [(1, None, 5), (2, "z", 5), (3, "a", None), (4, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").repartition(7)
    targets = [("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.2, 5), ("gone", 0.1, 3)]
    got = mixing.mix(df, targets, fan_in=3, block_items=300).toPandas()
    t = (got["size"] * got["n_copies"]).groupby(got["source"]).sum()
    share = t / t.sum()
    assert all(abs(share[s] - w / 0.9) < 0.001 for s, w in (("a", 0.3), ("b", 0.4), ("c", 0.2)))
    most = got.groupby("source")["n_copies"].max()
    assert all(most[s] <= r for s, _, r in targets[:3]) and set(got["source"]) == {"a", "b", "c"}
    other = mixing.mix(df.repartition(3, "n_tokens"), targets, fan_in=3, block_items=300).toPandas()
    drawn = lambda g: sorted(zip(g["source"], g["doc_id"], g["size"], g["n_copies"]))
    assert drawn(got) == drawn(other)  # partitions don't matter
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_a_long_text_among_few_spoils_no_share(spark):
    rows = [(i, "a", 40 + i % 7) for i in range(200)] + [(900, "a", 900)] + [(1000 + i, "b", 10) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    for seed in "pqrs":
        got = mixing.mix(df, [("a", 0.3, 1), ("b", 0.7, 1)], seed=seed).toPandas()
        t = (got["size"] * got["n_copies"]).groupby(got["source"]).sum()
        assert abs(t["a"] / t.sum() - 0.3) < 0.005


def test_rounding_keeps_sums_and_expectations():
    rng = np.random.default_rng(1)
    w, p = np.sort(rng.integers(1, 50, 700))[::-1].astype(float), rng.random(700)
    total, hits = float((w * p).sum()), np.zeros(700)
    for seed in range(400):
        q, decided = mixing.pivot(w, p, np.random.default_rng(seed))
        assert (~decided).sum() <= 1 and abs((w * q).sum() - total) < 1e-6 and set(q[decided]) <= {0.0, 1.0}
        hits += q
    assert np.abs(hits / 400 - p).max() < 5 * 0.5 / 20  # expectation of each text over seeds: five standard errors at most
    assert mixing.pivot(w[:0], p[:0], rng)[1].all()


def test_large_texts_are_settled_against_the_rest():
    w, hits, after = [900, 300, 120, 5], np.zeros(4), []
    for seed in range(2000):
        q, rest = mixing.settle_large(w, 0.3, 4000, np.random.default_rng(seed))
        assert abs(np.dot(w, q) + 4000 * rest - 0.3 * (4000 + sum(w))) < 1e-6 and set(q) <= {0.0, 1.0}
        hits += q
        after.append(rest)
    assert np.abs(hits / 2000 - 0.3).max() < 0.05 and abs(np.mean(after) - 0.3) < 0.01
    assert mixing.settle_large([10], 0.4, 0, np.random.default_rng(0)) == ([0.4], 0.4) and mixing.settle_large([], 0.4, 9, None) == ([], 0.4)
    q, rest = mixing.settle_large([50, 5], 0.5, 5, np.random.default_rng(1))  # the rest can't make up for it
    assert abs(np.dot([50, 5], q) + 5 * rest - 30) < 1e-9


CLEAN = ["Die Prüfung läuft über Nacht, größere Läufe später.", "A execução terminou sem conclusão.", "Запрос остался без ответа до вечера.", "如果置信度低，就交给更大的模型。", "We don’t retry when the berth is late…", "Çağrı ağacı beklenenden daha derin çıktı.", "Łączny koszt wyniósł 43 zł."]
MEANT = ["Â, Ê, Î, Ô, Û ; Ã, Õ ; ª º", "╔══╗ ║25║ ▒▒░▓", "Keys: ¬ ¨ ´ ¸ ¯ ¦ § ƒ Š š Ž ž", "Tom &amp; Jerry", "plain text"]


def restorer():
    counts = np.zeros(mojibake.SLOTS, np.float32)
    for t in (CLEAN + MEANT) * 40:
        np.add.at(counts, mojibake._slots(mojibake._codes(t)), 1)
    return mojibake.Restorer(counts)


@pytest.mark.parametrize("text,enc", [(t, e) for t in CLEAN for e in ("cp1252", "cp437", "mac_roman", "latin-1")])
def test_round_trip_of_utf8(text, enc):
    try:
        bad = text.encode().decode(enc)
    except UnicodeDecodeError:
        pytest.skip("has no such form")
    got, n = restorer().text(bad)
    assert n >= 1 and got == text


@pytest.mark.parametrize("text,wrote,read", [(CLEAN[2], "cp1251", "cp1252"), (CLEAN[2], "koi8_r", "cp1251"), (CLEAN[3], "gbk", "latin-1"), (CLEAN[5], "cp1254", "cp1252"), (CLEAN[6], "cp1250", "cp1252")])
def test_round_trip_of_single_bytes(text, wrote, read):
    got, n = restorer().text(text.encode(wrote).decode(read))
    assert n >= 1 and got == text


def test_double_and_entity_and_lost():
    r = restorer()
    assert r.text(CLEAN[1].encode().decode("cp1252").encode().decode("cp1252")) == (CLEAN[1], 1)
    assert r.text(CLEAN[1].encode().decode("cp1252").replace("Ã", "&Atilde;")) == (CLEAN[1], 1)
    assert r.text("Z�gert")[1] == 1 and r.text(None) == (None, 0) and r.text("") == ("", 0)


@pytest.mark.parametrize("text", CLEAN + MEANT)
def test_meant_characters_stay(text):
    assert restorer().text(text) == (text, 0)


def test_restore_keeps_ids(spark):
    rows = [(i, t) for i, t in enumerate((CLEAN + MEANT) * 30)] + [(5000, CLEAN[0].encode().decode("cp1252")), (5001, None), (5002, ""), (5003, CLEAN[0].encode().decode("cp1252"))]
    got = {r.doc_id: r.restored for r in mojibake.restore(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5000: CLEAN[0], 5003: CLEAN[0]}
    assert mojibake.restore(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts(spark):
    long = "word " * 60_000
    texts = [None, "", "hello world", "user: what is it\nassistant: a thing\n", long, "é\nuser: ça va ?\n\n  bien", "a" + " " * 5000 + "b", " " * 3000, "\n" * 2500 + "user: x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.token_counts(df, with_prompts=True).collect()}
    other = {r.doc_id: r for r in tokens.token_counts(df, tokenizer="/opt/tokenizers/byte_bpe_50k.json", with_prompts=True).collect()}
    assert {i: tuple(r) for i, r in got.items()} == {i: tuple(r) for i, r in other.items()}  # one vocabulary, two libraries
    assert (got[0].n_tokens, got[1].n_tokens, got[2].n_tokens, got[2].n_loss) == (0, 0, 2, 2)
    assert 0 < got[3].n_loss < got[3].n_tokens and got[3].prompts[0]["from"] == 0
    assert all(r.n_loss == r.n_tokens - sum(p["to"] - p["from"] for p in r.prompts) for r in got.values())
    assert got[4].n_tokens > 60_000 - 2 and got[8].n_loss == got[8].n_tokens - 3


def test_blanks_that_the_pattern_cannot_take_at_once():
    with open(tokens.DEFAULT_TOKENIZER, "rb") as f:
        encode = tokens._starts(f.read(), tokens.DEFAULT_TOKENIZER, tokens.WORD_PATTERN)
    assert encode("a" + " " * 2_000_000 + "b")[0] == 2_000_001
    assert encode(" " * 2_000_000)[0] == 2_000_000 and encode("")[0] == 0
