"""Operators for training data do the whole job."""

import numpy as np
import pytest
from test_llm import CLEAN, restorer

from spanloom.llm import mojibake

UPPER = "РЕЕСТР СТРОК 75: ГРАФ, СБОЙ, РЯД, ЦЕХ, ЭТАП, ЯРУС, ХОД, УЗЕЛ"


@pytest.mark.parametrize("text", ["It’s late", "据X", "次尝试仍然超时（见R", "，就交给更大的模型（见Q"])
def test_ascii_taken_as_a_second_byte_comes_back(text):
    bad = text.encode().decode("gbk")
    assert bad != text and restorer().text(bad) == (text, 1)


@pytest.mark.parametrize("text", [UPPER, "¥300", "‾"])
def test_no_ascii_out_of_meant_characters(text):
    r = restorer()
    np.add.at(r.counts, mojibake._slots(mojibake._codes(UPPER)), 40)
    assert r.text(text) == (text, 0)
    assert mojibake._swallows([None, ("cp1252", "utf-8")]) and not mojibake._swallows([("cp866", "gbk")])


@pytest.mark.parametrize("copies", [8, 9])
def test_frequent_garbling_is_searched(copies):
    bad = CLEAN[2].encode("cp1251").decode("cp1252")
    r = restorer()
    np.add.at(r.counts, mojibake._slots(mojibake._codes(bad)), copies)
    r = mojibake.Restorer(r.counts)
    assert max(r.pairs.of(bad)) <= 14  # the model finds it usual
    assert r.text(bad) == (CLEAN[2], 1)


def test_copies_of_a_passage_are_damped(spark):
    rows = [(i, "Ñëå." if i < 64 else f"Ж. no {i}") for i in range(66)] + [(70, None), (71, "ascii")]
    n = mojibake.pair_counts(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    at = lambda pair: n[mojibake._slots(mojibake._codes(pair))[1]]
    assert at("Ñë") == 7 and at("Ж.") == 2


def test_planted_passages_come_back():
    """Clean passages, garbled in many ways; the bound on states and the prior weights change nothing."""
    rng = np.random.default_rng(2)
    ways = [("utf-8", e) for e in ("cp1252", "latin-1", "mac_roman", "cp437", "gbk")] + [("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("gbk", "latin-1")]
    plants = []
    for _ in range(400):
        text, (wrote, read) = CLEAN[rng.integers(len(CLEAN))], ways[rng.integers(len(ways))]
        try:
            plants.append((text, text.encode(wrote).decode(read), wrote))
        except UnicodeError:
            continue
    plants = [p for p in plants if p[0] != p[1]]
    counts = restorer().counts
    got = [[r.text(bad)[0] for _, bad, _ in plants] for r in (mojibake.Restorer(counts), mojibake.Restorer(counts, limits=mojibake.Limits(states=None)), mojibake.Restorer(counts, weights={}))]
    assert got[0] == got[1]
    for texts in got:
        assert np.mean([t == text for t, (text, _, wrote) in zip(texts, plants) if wrote == "utf-8"]) > 0.98
        assert np.mean([t == text for t, (text, _, wrote) in zip(texts, plants) if wrote != "utf-8"]) > 0.8


def test_what_cannot_be_restored_is_reported():
    r = restorer()
    assert r.text("lost \ufffd here") == ("lost \ufffd here", 1) and r.text("a\x85b")[1] == 1
